"""Best-fit packing of tokenised documents into sequences of one length.

The lengths of all pieces are counted into a histogram, at most one entry per
length whatever the corpus' size. Its configuration linear program (how often
to use each way of filling a sequence) is solved by multiplicative weights: a
knapsack by dynamic programming prices the best filling for the current
weights, and what it covers loses weight. The solution is rounded, what is left
is solved again, and the plan says which sequences each length's pieces go to.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Multiplicative-weights rounds for each solution, and the step by which covered lengths lose weight.
ROUNDS, STEP = 60, 0.5
#: Fillings that are worth this share of the best one count as priced out by the same weights.
NEAR = 0.999
#: Shares of the linear program's solution that are rounded; the one that gives the fewest sequences counts.
SHARES = (1.0, 0.5)
#: Offsets of pieces are broadcast up to so many numbers; beyond it they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


class Encoder:
    """Token ids by the file of a byte-level tokenizer of the ``tokenizers`` library.

    The library's own way costs some 900 CPU seconds a GB. Texts of plain
    letters and punctuation go through ``tiktoken`` with the same vocabulary
    and pattern, a quarter of that; all others, in which the two could tell
    characters apart differently or which are beyond the latter's stack, don't.
    """

    #: Characters outside Latin letters and common dashes, quotes and signs, or very long white space.
    OTHER = re.compile(r"[^\x00-\u024f\u2010-\u2027\u20ac]|\s{1000}")
    #: Very long white space shows in every 500th character.
    WIDE = re.compile(r"\s\s")
    #: The same pre-tokens as ``tokens.PATTERN``, without stepping back in runs of letters, digits or signs.
    PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # control strings in texts are ordinary text
        control = self.tokenizer.get_added_tokens_decoder()
        # a byte-level vocabulary writes a byte as its character if that can be seen, the other bytes as the next ones from U+0100
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(0x100) if b not in seen)}
        ranks = {bytes(byte_of[c] for c in token): n for token, n in self.tokenizer.get_vocab().items() if n not in control}
        self.plain = Encoding("plain", pat_str=self.PRETOKENS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def other(self, text: str) -> bool:
        """Whether OTHER is in the text, which isn't read twice where all its characters are of Latin-1."""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return bool(self.OTHER.search(text))
        return bool(self.WIDE.search(text[::500])) and bool(self.OTHER.search(text))

    def __call__(self, text: str) -> np.ndarray:
        if self.other(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        return np.frombuffer(array("i", self.plain(text)), dtype=np.int32)


@functools.cache
def encoder(name: str) -> Encoder:
    from pyspark import SparkFiles

    return Encoder(SparkFiles.get(name))


class Fillings:
    """Ways of filling a sequence of ``room`` with lengths of a histogram, priced by a knapsack.

    A filling is a row of numbers of pieces by length; ``lengths`` descend.
    """

    def __init__(self, lengths: np.ndarray, room: int):
        self.lengths, self.room = lengths, room

    def priced(self, prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each length the best filling that holds it, and its worth.

        One table serves them all: ``worth[r]`` is the best worth of room r, by
        dynamic programming over r, and ``last[r]`` a length it ends with.
        """
        lengths, room = self.lengths, self.room
        worth, last = np.zeros(room + 1), np.full(room + 1, -1)
        first = np.searchsorted(-lengths, -np.arange(room + 1), side="left")  # lengths[first[r]:] fit into r
        for r in range(int(lengths[-1]), room + 1):
            at = first[r]
            gains = prices[at:] + worth[r - lengths[at:]]
            best = int(gains.argmax())
            if gains[best] > worth[r - 1]:
                worth[r], last[r] = gains[best], at + best
            else:
                worth[r], last[r] = worth[r - 1], -1
        each = np.arange(len(lengths))
        filled = np.zeros((len(lengths), len(lengths)), dtype=np.int16)
        filled[each, each] = 1
        left = room - lengths
        while (live := left > 0).any():
            took = last[left]
            taken = live & (took >= 0)
            filled[each[taken], took[taken]] += 1
            left = np.where(taken, left - lengths[took], np.where(live, left - 1, left))
        return filled, filled @ prices


def solve(lengths: np.ndarray, counts: np.ndarray, room: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fillings, how often the linear program uses each, and a lower bound on the number of sequences.

    Weights begin as the lengths' shares of a sequence. In each round the
    fillings that are worth (nearly) the most by the present weights cover a
    share of the pieces, and each length loses weight by what was covered of
    it. Any weights, divided by the worth of the best filling, bound the number
    of sequences from below.
    """
    maker, weights, bound = Fillings(lengths, room), lengths / room, 0.0
    used: dict[bytes, float] = {}
    covered = np.zeros(len(lengths))
    for _ in range(rounds):
        filled, worth = maker.priced(weights)
        bound = max(bound, float(counts @ weights / worth.max()))
        near = np.array(list({row.tobytes(): row for row in filled[worth >= NEAR * worth.max()]}.values()))
        # as often as its scarcest length allows, shared among the fillings that want it
        asked = near.sum(axis=0)
        share = np.where(near > 0, counts / np.maximum(asked, 1), np.inf).min(axis=1)
        for row, often in zip(near, share):
            used[row.tobytes()] = used.get(row.tobytes(), 0.0) + float(often)
        step = (near * share[:, None]).sum(axis=0) / counts
        covered += step
        weights = weights * np.exp(-STEP * step)
    rows = np.array([np.frombuffer(k, dtype=np.int16) for k in used])
    often = np.array(list(used.values()))
    # the scarcest length of each filling decides by how much it was used too often
    reach = np.where(rows > 0, covered, np.inf).min(axis=1)
    return rows, often / np.maximum(reach, 1e-9), bound


def fullest(lengths: list[int], left: list[int], room: int) -> dict[int, int]:
    """Pieces that are left, by place in the descending ``lengths``, that fill ``room`` most, the largest of them first.

    Sums that can be reached are the bits of one whole number; the numbers
    before each length are kept to find the pieces again.
    """
    reached, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i, (length, n) in enumerate(zip(lengths, left)):
        if length > room or not n:
            continue
        before = reached
        for _ in range(min(n, room // length)):
            wider = (reached | reached << length) & mask
            if wider == reached:
                break
            reached = wider
        steps.append((i, length, before))
        if reached >> room:
            break
    total, held = reached.bit_length() - 1, {}
    for i, length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total, n = total - length, n + 1
        if n:
            held[i] = n
    return held


def _rounded(lengths: np.ndarray, counts: np.ndarray, room: int, share: float, first: tuple) -> list[tuple[int, dict[int, int]]]:
    left, made = counts.copy(), []

    def take(held: dict[int, int], often: int) -> None:
        often = min(often, *(int(left[i]) // n for i, n in held.items()))
        if often > 0:
            for i, n in held.items():
                left[i] -= often * n
            made.append((often, {int(lengths[i]): n for i, n in held.items()}))

    open_, (rows, often) = np.arange(len(lengths)), first
    while True:
        before = left.sum()
        often = share * often
        for i in np.argsort(-often, kind="stable"):
            if often[i] < 1:
                break
            take({int(open_[j]): int(rows[i, j]) for j in np.nonzero(rows[i])[0]}, int(often[i]))
        open_ = np.nonzero(left)[0]
        if left.sum() > 0.9 * before or not open_.size:
            break
        rows, often, _ = solve(lengths[open_], left[open_], room)
    sizes = lengths.tolist()
    for i in range(len(sizes)):
        while left[i]:
            rest = left.tolist()
            rest[i] -= 1
            held = fullest(sizes, rest, room - sizes[i])
            held[i] = held.get(i, 0) + 1
            take(held, int(left[i]))
    return made


def plan(counts: dict[int, int], room: int) -> tuple[list[tuple[int, dict[int, int]]], float]:
    """[(number of sequences, {length: pieces in each})] covering each length's count, and a lower bound on their number.

    The linear program's fillings are taken as often as it uses them, rounded
    down; what is left is solved again while that places a tenth of it. The
    rest, some sequences a length, goes by the largest piece and what fills up
    its sequence most.
    """
    lengths = np.array(sorted((n for n in counts if counts[n]), reverse=True), dtype=np.int64)
    if not lengths.size:
        return [], 0.0
    numbers = np.array([counts[n] for n in lengths], dtype=np.int64)
    rows, often, bound = solve(lengths, numbers, room)
    made = [_rounded(lengths, numbers, room, share, (rows, often)) for share in SHARES]
    return min(made, key=lambda m: sum(n for n, _ in m)), bound


def tokenised(docs: DataFrame, room: int, path: str, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, nth): stored pieces; part is the task that made a piece, nth counts its pieces of that length."""
    spark = docs.sparkSession
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, seen = encoder(name), TaskContext.get().partitionId(), np.zeros(room + 1, dtype=np.int64)
        for batch in batches:
            docs_of, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 64):  # so that an Arrow batch of ids stays small
                doc, piece, start, length, nth, values = [], [], [], [], [], []
                for i in range(at, min(at + 64, batch.num_rows)):
                    ids = np.append(encode(texts[i].as_py() or ""), np.int32(end_id))
                    values.append(ids)
                    begin = 0
                    for p in range(-(-len(ids) // room)):
                        end = begin + ((len(ids) - 1) % room + 1 if p == 0 else room)
                        doc.append(i), piece.append(p), start.append(begin), length.append(end - begin), nth.append(seen[end - begin])
                        seen[end - begin] += 1
                        begin = end
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
                columns = [docs_of.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64())]
                columns += [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values))), pa.array([part] * len(doc), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "part", "nth"])

    schema = "doc_id long, piece int, start long, length long, ids array<int>, part int, nth long"
    return stored(docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, schema), "pieces")


def placed(pieces: DataFrame, room: int) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed into as few sequences of ``room`` as the plan finds.

    A piece's rank among those of its length is its nth in its part plus what
    earlier parts have; ranks fill the plan's sequences in order. Only the
    histogram, at most ``room`` numbers, comes to the driver.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = counts.pop(room, 0)  # full ones are sequences of their own
    made, _ = plan(counts, room)
    # slots: pieces of a length by rank go to runs of equal sequences
    runs: dict[int, list[tuple[int, int, int, int]]] = {room: [(0, 0, 1, 0)]}
    filled: Counter[int] = Counter()
    sequence = whole
    for often, held in made:
        offset = 0
        for length, n in held.items():
            runs.setdefault(length, []).append((filled[length], sequence, n, offset))
            filled[length] += often * n
            offset += length * n
        sequence += often
    tables = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows)) for length, rows in runs.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sizes, ranks = length.to_numpy(), rank.to_numpy()
        sequence_id, offset = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
        for size in np.unique(sizes):
            own = np.nonzero(sizes == size)[0]
            begins, sequences, many, places = tables[int(size)]
            run = np.searchsorted(begins, ranks[own], side="right") - 1
            nth = ranks[own] - begins[run]
            sequence_id[own] = sequences[run] + nth // many[run]
            offset[own] = places[run] + nth % many[run] * size
        return pd.DataFrame({"sequence_id": sequence_id, "offset": offset})

    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = stored(by_part.select("part", "length", earlier.alias("earlier")), "ranks")
    small = before.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    ranked = pieces.join(F.broadcast(before) if small else before, ["part", "length"])
    found = ranked.withColumn("place", place("length", (F.col("earlier") + F.col("nth")).alias("rank")))
    return found.select("doc_id", "piece", "start", "length", "ids", F.col("place.sequence_id").alias("sequence_id"), F.col("place.offset").alias("offset"))


def pack_documents(docs: DataFrame, room: int = 1024, path: str = TOKENIZER, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every document's tokens and an end token, packed.

    Only documents of more than ``room`` tokens are cut, into pieces of
    ``room`` but the first. Null and empty texts are their end token alone; null
    ids and repeated rows are documents of their own; equal lengths are told
    apart by their place in the input; very long texts are encoded whole and
    cut. Further columns aren't read, whatever their names; an empty table
    gives no rows.
    """
    return placed(tokenised(docs, room, path, end_id), room)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed pieces put together; a sequence holds ``room`` tokens at most."""
    pieces = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id", "length")))
    whole = packed.groupBy("sequence_id").agg(pieces.alias("pieces"))
    return whole.select("sequence_id", F.flatten("pieces.ids").alias("ids"), F.col("pieces.doc_id").alias("doc_ids"), F.col("pieces.length").alias("lengths"))
