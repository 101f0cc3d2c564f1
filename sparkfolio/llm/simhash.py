"""SimHash near-duplicates by anchor-point covering, and similar shingle sets by an exact prefix-filter join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, quoted, removed, row_key, scratch, stored
from .components import connected_components

#: Fingerprints link at this many differing bits or fewer.
THRESHOLD = 3
#: Shingles are hashed and counted in pieces of this many.
PIECE = 65536
#: Texts are similar from this share of common shingles on.
SIMILAR = 0.8
#: Shingles met in more than one of about SAMPLE texts come last in the common order of shingles; at most COMMON of them are told apart.
SAMPLE, COMMON = 8192, 16384
#: Keys that the prefixes of similar sets have in common, at least: they are longer by as many less one, so that texts that meet by chance at a key or two aren't compared.
SHARED = 6
#: Bits of a set's sketch: each shingle flips one, so sets differ in at least as many shingles as sketches in bits.
SKETCH = 512


def shingle_hashes(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles of a text, in order, in pieces."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    joined, n = b" ".join(w), max(1, len(w) - words + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        a, b = begins[lo:hi].tolist(), (ends[lo + words - 1 : hi + words - 1] if len(w) >= words else ends[-1:]).tolist()
        yield np.array([xxhash.xxh64_intdigest(joined[i:j], 42) for i, j in zip(a, b, strict=True)], dtype=np.uint64)


def print_of(pieces: list[np.ndarray]) -> int:
    """64-bit SimHash of shingle hashes, as a signed integer; 0 without any."""
    n, ones = sum(map(len, pieces)), np.zeros(64, dtype=np.int64)
    for h in pieces:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of the word shingles of a text, as a signed integer."""
    return print_of(list(shingle_hashes(text, words)))


def set_of(pieces: list[np.ndarray]) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *pieces]))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the numbers of shingles in SKETCH classes, as longs."""
    classes = (shingles >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=SKETCH) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def prefix(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float, shared: int = 1) -> np.ndarray:
    """The first of the sorted ``shingles`` in the common order (by count, then hash), so many that two sets with a similarity of ``least`` have ``shared`` in both their prefixes, or all that they have in common if that is less."""
    n = len(shingles)
    if not n:
        return shingles
    size = min(n, n - math.ceil(least * n - 1e-9) + shared)
    if not len(common):
        return shingles[:size]
    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
    return shingles[np.argsort(np.where(common[at] == shingles, counts[at], 0), kind="stable")[:size]]


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """``docs`` with fp, the fingerprint of its text."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    return docs.withColumn("fp", fp("text"))


def anchors(half: np.ndarray, number: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Anchors within distance 2 of 32-bit words: (indices, keys, home).

    The anchors are the code words of the perfect Hamming code on 31 bits
    (parity checks: the bits' numbers 1..31), times a free bit. Its covering
    radius is 1, so each word has a home anchor within 1.
    """
    low, base = half & np.int64(0x7FFFFFFF), (half & np.int64(0x80000000)) | np.int64(number << 32)
    syndrome = np.zeros(len(half), dtype=np.int64)
    for j in range(1, 32):
        syndrome ^= ((low >> np.int64(j - 1)) & 1) * j
    home = np.where(syndrome > 0, low ^ (np.int64(1) << np.maximum(syndrome - 1, 0)), low)
    everyone = np.arange(len(half))
    yield everyone, base | home, True
    yield everyone, (base ^ np.int64(0x80000000)) | home, False
    for j in range(1, 32):
        k = syndrome ^ j
        at = np.nonzero((syndrome > 0) & (k > j))[0]
        yield at, base[at] | (low[at] ^ np.int64(1 << (j - 1)) ^ (np.int64(1) << (k[at] - 1))), False


def replicate(distinct: DataFrame, home_only: bool) -> DataFrame:
    """(anchor, fp, rep) for each anchor a fingerprint (fp, rep) is replicated to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, reps = batch.column("fp").to_numpy(), batch.column("rep").to_numpy()
            unsigned = fps.view(np.uint64)
            for number, half in enumerate(((unsigned & np.uint64(0xFFFFFFFF)).astype(np.int64), (unsigned >> np.uint64(32)).astype(np.int64))):
                for at, keys, home in anchors(half, number):
                    if len(at) and (home or not home_only):
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[at]), pa.array(reps[at])], names=["anchor", "fp", "rep"])

    return distinct.select("fp", "rep").mapInArrow(run, "anchor long, fp long, rep long")


def links(distinct: DataFrame) -> DataFrame:
    """All pairs (a, b) of representatives whose fingerprints differ in 1 to 3 bits.

    Of 3 differing bits one half of the 64 has at most 1. In that half the
    pair's smaller fingerprint lies within the covering radius 1 of its home
    anchor, the other within 1 + 1 = 2 of the same anchor, to which it is
    replicated: about 17 anchors a half. Comparing homes with replicas at each
    anchor meets every link; the distance is part of the join's condition, so
    only links leave it.
    """
    home = replicate(distinct, True).select("anchor", F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    near = replicate(distinct, False).select("anchor", F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    close = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= THRESHOLD
    return home.join(near, (home["anchor"] == near["anchor"]) & (F.col("fp_a") < F.col("fp_b")) & close).select("a", "b")


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the commonest shingles of a bounded sample of texts.

    They only order the shingles, so that few texts meet at one: whatever the
    sample, the join over prefixes in that order misses nothing.
    """

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([set_of(list(shingle_hashes(t, words))).view(np.int64) for t in texts], dtype="object")

    rows = docs.select(F.xxhash64("text").alias("version"), "text")
    some = rows.where(F.pmod("version", F.lit(max(1, docs.count() // SAMPLE))) == 0)
    held = some.select("version", shingles("text").alias("held")).dropDuplicates(["version"])
    often = held.select(F.explode_outer("held").alias("h")).where("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    found = often.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()
    hashes, counts = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], counts[order]


def prints_and_sets(docs: DataFrame, words: int, least: float, under: str | None = None) -> DataFrame:
    """(key, doc_id, version, fp, shape, n, keys, bits) of each row.

    ``version`` is a hash of the text, ``shape`` one of its set of shingles
    (null without any), ``n`` their number, ``keys`` the set's prefix and ``bits`` its sketch.
    """
    import xxhash

    common, counts = common_shingles(docs, words)

    @F.pandas_udf("fp long, shape long, n long, keys array<long>, bits array<long>")
    def made(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            pieces = list(shingle_hashes(t, words))
            held = set_of(pieces)
            shape = xxhash.xxh3_64_intdigest(held.tobytes()) - 2**63 if len(held) else None
            rows.append((print_of(pieces), shape, len(held), prefix(held, common, counts, least, SHARED).view(np.int64), sketch(held)))
        return pd.DataFrame(rows, columns=["fp", "shape", "n", "keys", "bits"]).astype({"shape": "Int64"})

    return stored(docs.select("key", "doc_id", F.xxhash64("text").alias("version"), made("text").alias("m")).select("key", "doc_id", "version", "m.*"), "prints", under)


def near_sketches(one: Column, other: Column, n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m shingles may have that similarity by their sketches: they differ in as many shingles as bits, or more."""
    bits = reduce(lambda p, q: p + q, [F.bit_count(F.get(one, i).bitwiseXOR(F.get(other, i))) for i in map(F.lit, range(SKETCH // 64))])
    return bits <= (n + m) * F.lit((1 - least) / (1 + least)) + F.lit(1e-6)


def alike(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, least: float, under: str | None = None) -> DataFrame:
    """Those of the ``pairs`` (a, b: versions) whose texts have at least that share of common shingles: each that the sketches allow is compared as a whole."""

    @F.pandas_udf("boolean")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        out, last, held = [], None, np.zeros(0, dtype=np.uint64)
        for x, y in zip(a, b, strict=True):
            if y != last:
                last, held = y, set_of(list(shingle_hashes(y, words)))
            mine = set_of(list(shingle_hashes(x, words)))
            common = len(np.intersect1d(mine, held, assume_unique=True))
            out.append(bool(common >= least * (len(mine) + len(held) - common)))
        return pd.Series(out, dtype="bool")

    slim = sets.select("version", "n", "bits")
    both = pairs.join(slim.toDF("a", "n_a", "bits_a"), "a").join(slim.toDF("b", "n_b", "bits_b"), "b")
    pairs = stored(both.where(near_sketches(F.col("bits_a"), F.col("bits_b"), F.col("n_a"), F.col("n_b"), least)).select("a", "b"), "pairs", under)
    wanted = pairs.select(F.col("a").alias("version")).union(pairs.select(F.col("b").alias("version"))).distinct()
    own = docs.select(F.xxhash64("text").alias("version"), "text").join(wanted, "version", "left_semi")
    texts = stored(own.dropDuplicates(["version"]), "candidates", under)
    ones = texts.select(F.col("version").alias("a"), F.col("text").alias("text_a"))
    others = texts.select(F.col("version").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.join(ones, "a").join(others, "b").where(compare("text_a", "text_b")).select("a", "b"), "similar", under)


def lengths_fit(n: Column, m: Column, least: float) -> Column:
    """Whether sets of n and m shingles can have that similarity."""
    return F.least(n, m) >= F.greatest(n, m) * F.lit(least) - F.lit(1e-6)


def slack(n: Column, m: Column, i: Column, j: Column, least: float) -> Column:
    """How far a key in common, at the places i and j of sets of n and m shingles, lies behind the last place for the first one of similar sets.

    What sets have in common comes, in the common order, from their first
    common shingle on. They have to share least / (1 + least) of both sizes, so
    only so many places may lie before it in either, one more before the
    second common shingle, and so on.
    """
    share = F.ceil((n + m) * F.lit(least / (1 + least)) - F.lit(1e-6))
    return F.greatest(i - n, j - m) + share


def sharing(met: DataFrame, least: float) -> DataFrame:
    """Those pairs (a, b) of rows (a, b, n, m, late: the slack), one for each key in common, whose keys in common are as many, and as early, as those of similar sets."""
    share = F.ceil((F.col("n") + F.col("m")) * F.lit(least / (1 + least)) - F.lit(1e-6))
    early = [F.when(share > k, (F.col("late") <= k).cast("int")).otherwise(SHARED) for k in range(SHARED)]
    counted = met.groupBy("a", "b").agg(*[F.sum(e).alias(f"early_{k}") for k, e in enumerate(early)])
    return counted.where(reduce(lambda x, y: x & y, [F.col(f"early_{k}") > k for k in range(SHARED)])).select("a", "b")


def similar_links(docs: DataFrame, prints: DataFrame, known: DataFrame, words: int, least: float, under: str | None = None) -> DataFrame:
    """Links (a, b) of doc_ids whose components are those of ``known`` and of all pairs of texts that are similar.

    Texts with one set of shingles are one. Similar sets have SHARED keys of
    their prefixes in common, so every pair that can be similar meets at so
    many. First each text is compared with those that come first at as many of
    its keys: the texts with the fewest shingles of their own, which the
    others are most like. Then all pairs are compared that share as many keys and
    aren't in one component yet and whose sketches allow it. A key counts for
    texts only that have it early enough to be similar: of a group of near
    copies those that are too different meet at none. Keys are counted
    in narrow rows; texts are moved for what is left. So a group of n near copies makes n pairs a
    key, but no two texts are left out that nothing links.
    """
    sets = stored(
        prints.where("doc_id is not null and shape is not null")
        .groupBy("shape")
        .agg(F.min("doc_id").alias("lead"), F.min("version").alias("version"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("bits").alias("bits")),
        "sets",
        under,
    )
    copies = prints.where("doc_id is not null").join(sets.select("shape", "lead"), "shape").where("doc_id <> lead").select(F.col("doc_id").alias("a"), F.col("lead").alias("b"))
    at_key = W.partitionBy("key").orderBy("pos", "version")
    met = stored(
        sets.select("version", F.col("n").cast("int").alias("n"), F.posexplode_outer("keys").alias("pos", "key"))
        .withColumns({"first": F.first("version").over(at_key), "first_n": F.first("n").over(at_key), "first_pos": F.first("pos").over(at_key), "more": F.lead("pos").over(at_key)})
        .where((F.col("version") != F.col("first")) | F.col("more").isNotNull())
        .select("key", "version", "n", "pos", "first", "first_n", "first_pos"),
        "met",
        under,
    )
    leads = sets.select("version", "lead")

    def named(pairs: DataFrame) -> DataFrame:
        ends = pairs.join(leads.toDF("a", "lead_a"), "a").join(leads.toDF("b", "lead_b"), "b")
        return ends.select(F.col("lead_a").alias("a"), F.col("lead_b").alias("b"))

    late = slack(F.col("n"), F.col("first_n"), F.col("pos"), F.col("first_pos"), least)
    stars = met.where((F.col("version") != F.col("first")) & lengths_fit(F.col("n"), F.col("first_n"), least) & (late < SHARED))
    good = alike(sharing(stars.select(F.col("version").alias("a"), F.col("first").alias("b"), "n", F.col("first_n").alias("m"), late.alias("late")), least), sets, docs, words, least, under)
    joined = cut(connected_components(known.union(copies).union(named(good))))
    place = sets.select("version", "lead").join(joined, F.col("lead") == F.col("node"), "left").select("version", F.coalesce("component", "lead").alias("c"))
    placed = stored(met.select("key", "version", "n", "pos").join(place, "version"), "placed", under)
    open_keys = stored(placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key"), "open", under)
    apart = stored(placed.join(open_keys, "key"), "apart", under)
    ones = apart.select("key", F.col("version").alias("b"), F.col("n").alias("m"), F.col("pos").alias("pos_b"), F.col("c").alias("d"))
    late = slack(F.col("n"), F.col("m"), F.col("pos"), F.col("pos_b"), least)
    meeting = apart.withColumnRenamed("version", "a").join(ones, "key").where((F.col("d") < F.col("c")) & lengths_fit(F.col("n"), F.col("m"), least) & (late < SHARED))
    pairs = sharing(meeting.select("a", "b", "n", "m", late.alias("late")), least)
    rest = alike(pairs.join(good.union(good.select("b", "a")), ["a", "b"], "left_anti"), sets, docs, words, least, under)
    return joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(named(rest))


def placed(docs: DataFrame, words: int, similar: float | None, under: str | None = None) -> DataFrame:
    """(key, doc_id, fp, component_id) per row of ``docs`` (doc_id, text); ``key`` tells different rows apart."""
    rows = docs.select("doc_id", "text", row_key(docs, "doc_id", "text").alias("key"))
    prints = cut(fingerprints(rows, words).select("key", "doc_id", "fp")) if similar is None else prints_and_sets(rows, words, similar, under)
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    found = links(groups.where("rep is not null"))
    if similar is not None:
        own = prints.where("doc_id is not null").select("doc_id", "fp").distinct().join(groups, "fp").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = similar_links(rows.drop("key"), prints, found.union(own), words, similar, under)
    found = connected_components(found)
    named = groups.join(found, groups["rep"] == found["node"], "left").select(F.col("fp").alias("group_fp"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, prints["fp"] == named["group_fp"]).select("key", "doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", similar: float | None = None) -> DataFrame:
    """One row per row of ``docs``: (key, fp, component_id).

    Equal fingerprints are one node whose representative is their least key,
    found with map-side combine; links are searched between distinct
    fingerprints only, so copies make no pairs. component_id is the least key
    that can be reached over links. With ``similar`` texts that share at least
    so much of their shingles are linked too, which 3 bits of 64 don't reach:
    all such pairs count, of every text of a key.
    Null and blank texts have fingerprint 0 and link like any other; a null key
    takes its group's component and is no representative (a group without keys
    has a null component); repeated rows stay; extra columns are left out; an
    empty table gives no rows. Very long texts are hashed in pieces.
    """
    rows = docs.select(docs[key].cast("long").alias("doc_id"), docs["text"])
    return placed(rows, words, similar).select(F.col("doc_id").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similar: float | None = SIMILAR) -> DataFrame:
    """The rows of ``docs``, with their columns, without near-duplicates: of each component the smallest doc_id stays.

    Of repeated rows of that doc_id one stays. Rows without a doc_id go if
    their component has one; where none has, one row of each different text
    stays. Null, blank and very long texts are treated as in
    ``near_duplicates``; extra columns stay whatever their names; an empty
    table stays empty.
    """
    slim = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    under = scratch(docs.sparkSession, "near")
    found = placed(slim, words, similar, under)
    gone = stored(found.where("component_id is not null and not doc_id <=> component_id").select(F.col("key").alias("gone_key")).distinct(), "gone")
    removed(docs.sparkSession, under)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = rows.select("row", row_key(rows, "doc_id", "text").alias("key"))
    return rows.join(gone, F.col("key") == F.col("gone_key"), "left_anti").dropDuplicates(["key"]).select("row.*")


def hex_print(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
