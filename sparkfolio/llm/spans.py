"""Substring deduplication by sliding spans of sentences."""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: A run has at least so many consecutive sentences and so many words.
RUN_SENTENCES, RUN_WORDS = 3, 24
#: A sentence of more words counts as several: it is cut before each word whose hash is the least of NEAR words on either
#: side, so that a passage is cut alike wherever it stands, and pieces of more than LONG_PIECE words are cut by count.
LONG_SENTENCE, NEAR, LONG_PIECE = 12, 2, 24
#: Runs that a task compares among themselves before they move.
BATCH_RUNS = 50_000
RUN_COLUMNS = ["doc_id", "version", "pos", "len", "last", "later", "run", "rest"]
#: A sentence ends after one of these marks before white space, or at a line's end.
#: The pattern begins with the white space, which is rare, and looks back from there.
END = re.compile(r"\s(?:(?<=[.!?…。！？]\s)\s*|(?<=\n)\n*)")
#: A word with the white space before it.
WORD = re.compile(r"\s*\S+")


def cuts(words: list[str], long: list[tuple[int, int]]) -> list[list[int]]:
    """For each long sentence, given by its place in a text's words, where among its words its pieces begin: chosen by the words around, then by count."""
    import xxhash

    sizes = [hi - lo for lo, hi in long]
    first = np.cumsum([0, *sizes[:-1]])
    own = np.fromiter(map(xxhash.xxh32_intdigest, itertools.chain.from_iterable(words[lo:hi] for lo, hi in long)), dtype=np.int64, count=sum(sizes))
    h = own * 31
    h[1:] += own[:-1] * 17
    h &= 0xFFFFFFFF
    h[first] = own[first]
    # sentences lie NEAR places apart, so that none sees the words of another
    at = np.arange(len(own)) + NEAR * np.repeat(np.arange(1, len(long) + 1), sizes)
    around = np.full(len(own) + NEAR * (len(long) + 1), 1 << 40)
    around[at] = h
    least = np.ones(len(own), dtype=bool)
    for d in range(1, NEAR + 1):
        least &= (h < around[at - d]) & (h <= around[at + d])
    least[first] = False
    chosen, out, k = [*np.flatnonzero(least).tolist(), len(own)], [], 0
    for begin, size in zip(first.tolist(), sizes, strict=True):
        starts = [0]
        while chosen[k] < begin + size:
            i = chosen[k] - begin
            starts += [*range(starts[-1] + LONG_PIECE, i, LONG_PIECE), i]
            k += 1
        out.append([*starts, *range(starts[-1] + LONG_PIECE, size, LONG_PIECE)])
    return out


def parsed(text: str | None) -> tuple[list[tuple[int, int, int]], list[str]]:
    """(begin, end, words) of the sentences of a text, and all its words in lower case; long sentences come in pieces, blank ones not at all."""
    out, text, at, done, held = [], text or "", 0, 0, []
    words, ends = text.lower().split(), list(itertools.accumulate(map(len, WORD.findall(text))))
    for stop, after in [*(m.span() for m in END.finditer(text)), (len(text), len(text))]:
        upto = bisect.bisect_right(ends, stop, done)
        if upto > done:
            held.append((at, stop, done, upto))
        at, done = after, upto
    long = [(lo, hi) for _, _, lo, hi in held if hi - lo > LONG_SENTENCE]
    pieces = iter(cuts(words, long) if long else ())
    for begin, stop, lo, hi in held:
        if hi - lo <= LONG_SENTENCE:
            out.append((begin, stop, hi - lo))
            continue
        starts = next(pieces)
        for i, j in zip(starts, [*starts[1:], hi - lo], strict=True):
            end = ends[lo + j - 1]
            out.append((begin, end, j - i))
            begin = end
    return out, words


def sentences(text: str | None) -> list[tuple[int, int, int]]:
    """(begin, end, words) of the sentences of a text; long ones come in pieces, blank ones not at all."""
    return parsed(text)[0]


def runs(text: str | None) -> tuple[list[int], list[int], np.ndarray]:
    """Runs of a text: their first sentences, their lengths in sentences, and the halves of their 128-bit hashes.

    From each sentence on, the shortest run with enough sentences and words;
    so a run depends on nothing before it; besides, the shortest that ends with
    the text. A text too short for one is one run.
    """
    import xxhash

    found, words = parsed(text)
    if not found:
        return [], [], np.zeros((0, 2), dtype=np.int64)
    total = np.array([0, *itertools.accumulate(n for _, _, n in found)])
    places = total.tolist()
    low = [" ".join(words[i:j]).encode("utf-8", "surrogatepass") for i, j in itertools.pairwise(places)]
    begin = np.arange(len(found))
    end = np.maximum(np.searchsorted(total, total[:-1] + RUN_WORDS, side="left"), begin + RUN_SENTENCES)
    whole = end <= len(found)
    last = max(0, min(len(found) - RUN_SENTENCES, int(np.searchsorted(total, total[-1] - RUN_WORDS, side="right")) - 1))
    more = [] if whole.any() and end[whole][-1] == len(found) else [last]
    begin, end = np.append(begin[whole], more).astype(int), np.append(end[whole], [len(found)] * len(more)).astype(int)
    hashes = b"".join([xxhash.xxh3_128_digest(b"\n".join(low[b:e])) for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
    return begin.tolist(), (end - begin).tolist(), np.frombuffer(hashes, dtype=np.int64).reshape(-1, 2)


def settled(ids: list, versions: list, pos: list, lens: list, last: list, hashes: list) -> pa.RecordBatch:
    """Rows of all_runs for some texts' runs: of equal runs only the first still has to be compared with those of other batches."""
    h, none = np.concatenate(hashes), np.array([i is None for i in ids])
    at = [np.array([i or 0 for i in ids], dtype=np.int64), np.array(versions, dtype=np.int64), np.array(pos, dtype=np.int64)]
    keys = [h[:, 0], h[:, 1], none, *at]
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    equal = np.logical_and.accumulate([np.append(False, k[1:] == k[:-1]) for k in keys])
    # the last row of equal has the repeated rows, one of which is enough
    order, later, keys = order[~equal[-1]], equal[1][~equal[-1]], [k[~equal[-1]] for k in keys]
    run, rest, none, own, version, place = keys
    # a later run meets no other: it is dealt out by its text and place
    run, rest = np.where(later, version ^ own * 0x9E3779B97F4A7C1, run), np.where(later, place, rest)
    some = [pa.array(np.array(x, dtype=t)[order]) for x, t in ((lens, np.int32), (last, bool))]
    return pa.RecordBatch.from_arrays([pa.array(own, mask=none), pa.array(version), pa.array(place.astype(np.int32)), *some, pa.array(later), pa.array(run), pa.array(rest)], names=RUN_COLUMNS)


def all_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, version, pos, len, last, later, run, rest): a row for every run of every text.

    ``version`` is a hash of the text, ``last`` says that the run ends with it;
    run and rest are a hash of the run. ``later`` runs are known to repeat one
    that comes before, from among the BATCH_RUNS and more that are read
    together; so a run that very many texts share is met once a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, versions, pos, lens, last, hashes = [], [], [], [], [], []
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), batch.column("text"), strict=True)
            for doc_id, version, text in rows:
                p, k, h = runs(text.as_py())
                size = max(map(sum, zip(p, k, strict=True)), default=0)
                ids += [doc_id] * len(p)
                versions += [version] * len(p)
                pos += p
                lens += k
                last += [i + j == size for i, j in zip(p, k, strict=True)]
                hashes.append(h)
                if len(ids) >= BATCH_RUNS:
                    yield settled(ids, versions, pos, lens, last, hashes)
                    ids, versions, pos, lens, last, hashes = [], [], [], [], [], []
        if ids:
            yield settled(ids, versions, pos, lens, last, hashes)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").mapInArrow(run, "doc_id long, version long, pos int, len int, last boolean, later boolean, run long, rest long")


def repeated_sentences(found: DataFrame) -> DataFrame:
    """(doc_id, version, size, gone) of every text with runs: how many sentences it has, and those runs of it that are repeated and not the first of their kind, null without any.

    The first of equal runs is that with the least (doc_id, version, pos), so
    runs are ranked so where their hashes meet, those apart that are known to
    be later ones: all of them move once, as narrow rows, and only the later ones and the texts' last ones, which say
    how many sentences there are, move on to their texts. Runs are told apart
    by 128 bits, whose chance agreement is left out of account. Rows of the same doc_id
    and text tie, so they are all first.
    """
    place = W.partitionBy("run", "rest", "later").orderBy(F.col("doc_id").isNull(), "doc_id", "version", "pos")
    ranked = found.withColumn("later", F.col("later") | (F.rank().over(place) > 1)).where("later or last")
    gone = F.collect_set(F.when(F.col("later"), F.struct("pos", "len")))
    size = F.max(F.when(F.col("last"), F.col("pos") + F.col("len"))).cast("long")
    return ranked.groupBy("doc_id", "version").agg(size.alias("size"), F.when(F.size(gone) > 0, F.array_sort(gone)).alias("gone"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with text cleaned, n_sentences and n_removed.

    Every sentence covered by a non-first repeated run is cut out with the
    white space before it; all else stays as it is, byte for byte. Rows with
    the same doc_id and text count as one text, so they keep their passages.
    Null text stays null with no sentences, a null doc_id comes after all
    others, of ties in doc_id the text with the least hash is first; texts of
    any length are judged as a whole; extra columns stay, but n_sentences and
    n_removed are replaced; an empty table stays empty.
    """
    texts = stored(repeated_sentences(all_runs(docs)).withColumnsRenamed({"doc_id": "of_id", "version": "of_version"}), "texts")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = rows.join(texts, F.col("row.doc_id").cast("long").eqNullSafe(F.col("of_id")) & (F.xxhash64("row.text") == F.col("of_version")), "left")

    @F.pandas_udf("text string, n_removed long")
    def clean(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, spans in zip(texts, gone, strict=True):
            if spans is None:
                out.append((None, 0))
                continue
            found, bad, kept, at = sentences(text), set(), [], 0
            for s in spans:
                bad.update(range(s["pos"], s["pos"] + s["len"]))
            for i, (_, e, _) in enumerate(found):
                if i not in bad:
                    kept.append(text[at:e])
                at = e
            out.append(("".join([*kept, text[at:]]) if len(bad) < len(found) else "", len(bad)))
        return pd.DataFrame(out, columns=["text", "n_removed"])

    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    cleaned = joined.select("row", "size", F.col("gone").isNull().alias("whole"), clean(F.when(F.col("gone").isNotNull(), F.col("row.text")), "gone").alias("made"))
    text = F.when(F.col("whole"), F.col("row.text")).otherwise(F.col("made.text"))
    return cleaned.select(*rest, text.alias("text"), F.coalesce("size", F.lit(0)).alias("n_sentences"), "made.n_removed")
