"""Substring search by positional trigram postings: a phrase is where its grams stand at its offsets, no text is read.

A posting is (gram, id, dl, places): the gram as one whole number made of three
code points, the unit's number of grams, and the places in the lower-cased text
at which the gram begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import stored

#: Bits of a code point.
BITS = 21
SCHEMA = "gram long, id long, dl long, places array<int>"
#: Characters of texts worked on at once in a task; a longer text is worked on alone.
AT_ONCE = 1_000_000


def gram(three: str) -> int:
    a, b, c = map(ord, three)
    return a << 2 * BITS | b << BITS | c


def _of_texts(ids: list[int], lengths: list[int], texts: list[str], only: np.ndarray | None = None) -> pa.RecordBatch:
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64) for t in texts]
    sizes = np.array([max(len(p) - 2, 0) for p in points])
    keys = np.concatenate([(p[:-2] << 2 * BITS) | (p[1:-1] << BITS) | p[2:] for p in points if len(p) > 2] or [np.zeros(0, dtype=np.int64)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if only is not None:
        held = np.isin(keys, only)
        keys, owner, place = keys[held], owner[held], place[held]
    order = np.lexsort((place, keys, owner))
    keys, owner, place = keys[order], owner[order], place[order].astype(np.int32)
    begins = np.nonzero(np.append(True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))[0] if len(keys) else np.zeros(0, dtype=np.int64)
    offsets = pa.array(np.append(begins, len(keys)).astype(np.int32))
    owned = [pa.array(np.array(x, dtype=np.int64)[owner[begins]]) for x in (ids, lengths)]
    return pa.RecordBatch.from_arrays([pa.array(keys[begins]), *owned, pa.ListArray.from_arrays(offsets, pa.array(place))], ["gram", "id", "dl", "places"])


def postings(units: DataFrame, only: list[int] | None = None) -> DataFrame:
    """(gram, id, dl, places) of units (id, text) whose ids are different; texts below three characters have none. ``only`` names the grams that are wanted."""
    wanted = None if only is None else np.array(sorted(only), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some, held = [], 0
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if some and held + len(row[2]) > AT_ONCE:
                    yield _of_texts(*map(list, zip(*some)), wanted)
                    some, held = [], 0
                some.append(row)
                held += len(row[2])
            if some:
                yield _of_texts(*map(list, zip(*some)), wanted)

    return units.where("id is not null and text is not null").select(F.col("id").cast("long"), size(F.col("text")), F.lower("text").alias("text")).mapInArrow(run, SCHEMA)


def size(text: Column) -> Column:
    """A text's number of grams."""
    return F.greatest(F.length(F.coalesce(text, F.lit(""))) - 2, F.lit(0)).cast("long")


def cover(phrase: str) -> list[tuple[int, int]]:
    """(offset, gram) of the grams that hold every character of a phrase of three or more: each third one and the last."""
    last = len(phrase) - 3
    return [(i, gram(phrase[i : i + 3])) for i in sorted({*range(0, last + 1, 3), last})]


def of_phrases(units: DataFrame, phrases: list[str]) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) as of an index, but with the phrases' grams only, of all units: what a search of texts that aren't indexed needs, in one pass over them."""
    only = sorted({g for p in phrases if len(p) >= 3 for _, g in cover(p.lower())})
    stats = units.agg(F.count(F.lit(1)).alias("n"), F.avg(size(F.col("text"))).alias("avgdl"))
    return stored(postings(units, only), "grams"), stored(stats, "grams-stats")


def hits(index: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, id, dl, n): how often each phrase, by its place in the list, is found without overlaps.

    Only the postings of the phrases' grams are read. Places less their
    grams' offsets are met per phrase and unit in one aggregation, a list of as
    many places as the phrase has grams; what all of them share begins a hit.
    """
    wanted = [(i, offset, g) for i, p in enumerate(phrases) if len(p) >= 3 for offset, g in cover(p.lower())]
    if not wanted:
        return index.where("false").select(F.lit(0).alias("phrase"), "id", "dl", F.lit(0).cast("long").alias("n"))
    spark = index.sparkSession
    uses = spark.createDataFrame(wanted, "phrase int, offset int, gram long")
    needs = F.create_map(*[F.lit(x) for i, p in enumerate(phrases) if len(p) >= 3 for x in (i, len(cover(p.lower())))])
    sizes = F.create_map(*[F.lit(x) for i, p in enumerate(phrases) if len(p) >= 3 for x in (i, len(p.lower()))])
    met = index.where(F.col("gram").isin(sorted({g for _, _, g in wanted}))).join(F.broadcast(uses), "gram")
    begins = F.transform("places", lambda p: p - F.col("offset"))
    both = met.select("phrase", "id", "dl", begins.alias("begins")).groupBy("phrase", "id").agg(F.max("dl").alias("dl"), F.collect_list("begins").alias("every")).where(F.size("every") == needs[F.col("phrase")])
    common = F.aggregate(F.slice("every", 2, F.greatest(F.size("every") - 1, F.lit(1))), F.element_at("every", 1), lambda a, b: F.array_intersect(a, b))
    # array_intersect keeps the order of the first, and places ascend
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("until"))
    counted = F.aggregate(
        "common", start, lambda a, p: F.when(p >= a["until"], F.struct((a["n"] + 1).alias("n"), (p + sizes[F.col("phrase")]).alias("until"))).otherwise(a), lambda a: a["n"]
    )
    return both.select("phrase", "id", "dl", common.alias("common")).select("phrase", "id", "dl", counted.alias("n")).where("n > 0")


def scored(index: DataFrame, stats: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, id, score): BM25 of each phrase of three characters or more; ``stats`` is one row (n, avgdl) of units and their grams."""
    from .retrieval import K1, B, idf_of

    found = hits(index, phrases)
    df = found.groupBy("phrase").agg(F.count(F.lit(1)).alias("df"))  # as many rows as phrases
    rows = found.withColumnRenamed("n", "tf").join(F.broadcast(df), "phrase").withColumns({c: stats.select(c).scalar() for c in ("n", "avgdl")})
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.select("phrase", "id", (idf_of(F.col("n"), F.col("df")) * tf).alias("score"))


def phrase_scores(index: DataFrame, stats: DataFrame, phrases: list[str]) -> DataFrame:
    """(id, score): the sum of the phrases' scores."""
    return scored(index, stats, phrases).groupBy("id").agg(F.sum("score").alias("score"))


def keyword_scores(index: DataFrame, stats: DataFrame, query: str) -> DataFrame:
    """(id, score): BM25 of the whole query, lifted above all scores of its single terms; the postings are read once for both."""
    terms = X.split_terms(query)
    rows = scored(index, stats, [query, *(terms if len(terms) > 1 else [])])
    whole, parts = F.max(F.when(F.col("phrase") == 0, F.col("score") + 1e6)), F.sum(F.when(F.col("phrase") > 0, F.col("score")))
    return rows.groupBy("id").agg(F.coalesce(whole, parts).alias("score"))
