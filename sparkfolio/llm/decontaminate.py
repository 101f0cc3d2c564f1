"""Benchmark decontamination by a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, row_key

#: Words in a window.
WINDOW = 10
#: Words of a window's beginning that the scan looks up before it compares whole windows.
PREFIX = 3
#: The set of windows is broadcast only up to this count (some 100 MB); beyond it narrow rows are joined by a shuffle. Both give the same rows.
MAX_BROADCAST = 1_000_000
#: ASCII characters that are neither digits nor lower-case letters separate words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def norm_words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_remove(F.split(low, GAP), "")


def _gram(n: int):
    """Hash of the n words from place i on, given the words' hashes."""
    return lambda hashes: F.transform(hashes, lambda x, i: F.xxhash64(F.lit(n), x, *[F.get(hashes, i + j) for j in range(1, n)]))


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items: (text, len, prefix, item_ids). An item shorter than a window, but not empty, is one window."""
    w = F.col("w")
    n = F.size(w)
    return (
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), norm_words(F.col("text")).alias("w"))
        .where(n > 0)
        .select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1)), lambda i: F.slice(w, i, window))).alias("g"))
        .groupBy(F.array_join("g", " ").alias("text"), F.size("g").alias("len"), F.transform(F.slice("g", 1, PREFIX), lambda x: F.xxhash64(x)).alias("first"))
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )


def _lookups(docs: DataFrame, wanted: DataFrame, prefixes: list[int], keys: tuple[str, ...], broadcast: bool) -> DataFrame:
    """(key, doc_id, w, n_words, nth, copies): a row for every place whose prefix is wanted, and one with nth 0 for every document.

    With a broadcast set all happens in one pass. Else only (key, nth, prefix)
    is shuffled to the set; what is found is gathered per text and joined back.
    """
    h = F.col("h")
    rows = docs.select(row_key(docs, *keys).alias("key"), docs["doc_id"], docs["text"])
    if not broadcast:
        rows = rows.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    marker = F.xxhash64(F.lit("marker"))
    hashed = rows.select("key", "doc_id", "copies", norm_words(F.col("text")).alias("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    grams = [_gram(n)(h) for n in prefixes]
    if broadcast:
        spread = hashed.withColumn("grams", F.concat(F.array(marker), *grams) if grams else F.array(marker))
        spread = spread.select("key", "doc_id", "copies", "w", F.size("w").cast("long").alias("n_words"), F.posexplode_outer("grams").alias("nth", "prefix"))
        return spread.join(F.broadcast(wanted.union(docs.sparkSession.range(1).select(marker.alias("prefix")))), "prefix", "left_semi").drop("prefix")
    places = hashed.withColumn("grams", F.concat(*grams) if grams else F.array().cast("array<bigint>")).select("key", F.posexplode_outer("grams").alias("nth", "prefix"))
    found = places.where("prefix is not null").join(wanted, "prefix", "left_semi").groupBy(F.col("key").alias("found_key")).agg(F.collect_list(F.col("nth") + 1).alias("places"))
    joined = hashed.join(found, F.col("key") == F.col("found_key"), "left")
    every = F.concat(F.array(F.lit(0)), F.coalesce("places", F.array().cast("array<int>")))
    return joined.select("key", "doc_id", "copies", "w", F.size("w").cast("long").alias("n_words"), F.explode_outer(every).alias("nth"))


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, keys: tuple[str, ...] = ("doc_id", "text"), most: int = MAX_BROADCAST) -> DataFrame:
    """One row per different row of ``docs``: key, doc_id, n_words, copies, hits (array of (pos, len)), item_ids.

    Every word position's short prefix is looked up in the hash set of window
    prefixes; for the few that are found, whole windows are compared as text,
    so each hit is verified. Rows of a table are told apart by doc_id and text;
    equal rows are counted in ``copies``. Null or empty text: no words. Null
    ids of documents stay null, null item_ids count as the empty string. The
    set is broadcast up to ``most`` windows, else joined by a shuffle. Long
    texts cost in proportion to their words, ties and repeated passages or
    items give one hit per window, extra columns are left out. An empty table
    of items hits nothing, one of documents gives no rows.
    """
    table = windows(items, window)
    shape = table.agg(F.count(F.lit(1)).alias("n"), F.collect_set("len").alias("lens")).first()
    lens = sorted(shape["lens"])
    broadcast = shape["n"] <= most
    near = F.broadcast if broadcast else (lambda x: x)
    prefixes = sorted({min(PREFIX, n) for n in lens})
    table = table.withColumn("prefix", F.xxhash64(F.size("first"), *[F.get("first", F.lit(j)) for j in range(PREFIX)]))
    scan = _lookups(docs, table.select("prefix").distinct(), prefixes, keys, broadcast)
    texts = table.select(F.col("text").alias("found"), F.col("item_ids"))
    place = F.expr("cast((nth - 1) % greatest(n_words, 1) as int)")
    tries = F.filter(
        F.transform(F.array(*[F.lit(int(n)) for n in lens]).cast("array<int>"), lambda k: F.when((F.col("nth") > 0) & (F.col("pos") + k <= F.col("n_words")), F.struct(F.col("pos").alias("pos"), k.alias("len")))),
        lambda x: x.isNotNull(),
    )
    hits = (
        scan.withColumn("pos", place)
        .withColumn("span", F.explode(F.when(F.col("nth") == 0, F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).alias("len")))).otherwise(tries)))
        .withColumn("found", F.when(F.col("nth") > 0, F.array_join(F.slice("w", F.col("span.pos") + 1, F.col("span.len")), " ")))
        .select("key", "doc_id", "n_words", "copies", "span", "found")
        .join(near(texts), "found", "left")
        .where((F.col("span.pos") < 0) | F.col("item_ids").isNotNull())
    )
    hit = F.col("span.pos") >= 0
    return (
        hits.groupBy("key")
        .agg(
            F.any_value("doc_id").alias("doc_id"),
            F.any_value("n_words").alias("n_words"),
            F.sum(F.when(~hit, F.col("copies"))).alias("copies"),
            F.array_sort(F.collect_set(F.when(hit, F.col("span")))).alias("hits"),
            F.collect_set("item_ids").alias("lists"),
        )
        .withColumn("item_ids", F.array_sort(F.array_distinct(F.flatten("lists"))))
        .drop("lists")
    )


def covered(hits: Column) -> Column:
    """Words inside any of the sorted spans (pos, len)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(acc["end"], s["pos"]))).cast("long").alias("n"),
        F.greatest(acc["end"], s["pos"] + s["len"]).cast("int").alias("end"),
    )
    return F.aggregate(hits, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("int").alias("end")), step)["n"]


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with their columns.

    Null and empty texts stay, as do null ids; repeated rows stay or go
    together; ties don't matter; texts of any length are read as a whole; extra
    columns stay whatever their names. Without items all rows stay, an empty
    table stays empty.
    """
    leaks = find_leaks(docs, items, window).where(F.size("hits") > 0).select(F.col("key").alias("leak_key"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), row_key(docs, "doc_id", "text").alias("row_key"))
    return rows.join(leaks, F.col("row_key") == F.col("leak_key"), "left_anti").select("row.*")
