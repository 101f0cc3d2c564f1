"""Quality rules and a hashed n-gram log-likelihood ratio between trusted and raw text."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, sealed, stored, words

WHITE = " \t\n\x0b\x0c\r"
#: Labelled documents whose ids are broadcast; more are joined by a shuffle. Both give the same rows.
MOST_BROADCAST = 1_000_000
#: Values among which one of a given rank is found at once; more are narrowed down by bins first.
MOST_SORTED, BINS = 100_000, 4096


@dataclass(frozen=True)
class Quality:
    """Parameters of the rules.

    ``words`` and ``pairs`` are the buckets of hashed 1-grams and 2-grams. A
    threshold rejects at most the share ``lost`` of the trusted documents that
    weren't counted.
    """

    words: int = 16384
    pairs: int = 16384
    smoothing: float = 1.0
    lost: float = 0.005


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def base_columns(docs: DataFrame) -> DataFrame:
    """Add the rule columns and ``u``, the hashes of the words.

    Windows of three words are repeated only if their hashes are. Where some
    are, the windows are sorted by two hashes and place, so that equal ones
    stand together; neighbours are compared word by word, and the words covered
    are counted from the sorted places. All of it stays in the row.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    x = docs.withColumn("w", words(F.col("text")))
    x = x.withColumns(
        {
            "u": F.transform("w", lambda w: F.xxhash64(w)),
            "n_words": F.size("w").cast("long"),
            "word_chars": F.length(F.array_join("w", "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": duplicate_lines(F.col("text")),
        }
    )
    u, w = F.col("u"), F.col("w")
    three = lambda c, i: [F.get(c, i), F.get(c, i + 1), F.get(c, i + 2)]
    x = x.withColumn("h", F.transform(F.slice(u, 1, F.greatest(F.size(u) - 2, F.lit(0))), lambda v, i: F.xxhash64(*three(u, i))))
    h = F.col("h")
    placed = F.transform(h, lambda v, i: F.struct(v.alias("v"), F.hash(*three(w, i)).alias("z"), i.alias("i")))
    x = x.withColumn("s", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(placed)).otherwise(F.slice(placed, 1, 0))).drop("h")
    s = F.col("s")

    def same(a: Column, b: Column) -> Column:
        hashes = (a["v"] == b["v"]) & (a["z"] == b["z"])
        return hashes & reduce(lambda p, q: p & q, [c == d for c, d in zip(three(w, a["i"]), three(w, b["i"]), strict=True)])

    x = x.withColumn("p", F.filter(s, lambda e, k: F.coalesce(same(e, F.get(s, k - 1)), F.lit(False)) | F.coalesce(same(e, F.get(s, k + 1)), F.lit(False)))).drop("s", "w")
    x = x.withColumn("p", F.sort_array(F.transform("p", lambda e: e["i"])))
    p = F.col("p")
    gaps = F.transform(p, lambda v, i: F.least(F.lit(3), F.coalesce(v - F.get(p, i - 1), F.lit(3))))
    return x.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)).drop("p")


def word_buckets(u: Column, p: Quality) -> Column:
    return F.transform(u, lambda w: F.pmod(w, F.lit(p.words)).cast("int"))


def pair_buckets(u: Column, p: Quality) -> Column:
    """Buckets of the 2-grams, numbered after those of the 1-grams."""
    return F.transform(F.slice(u, 1, F.greatest(F.size(u) - 1, F.lit(0))), lambda w, i: (F.pmod(F.xxhash64(w, F.get(u, i + 1)), F.lit(p.pairs)) + p.words).cast("int"))


def labelled(labels: DataFrame, p: Quality) -> DataFrame:
    """(doc_id, kind) of every labelled document: of the trusted ones one half is 'fit', the other 'held', by the hash of their id; 'bad' are those of low quality or toxic.

    Several labels of a document count as the worst of them; null ids and null qualities are left out.
    """
    worst = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    half = F.when(F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)) == 0, "fit").otherwise("held")
    kind = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), "bad").when(F.col("quality") == 1, half)
    return cut(worst.select("doc_id", kind.alias("kind")).where("kind is not null"))


def near(few: DataFrame) -> DataFrame:
    """Labelled documents, to be broadcast while they are few."""
    return F.broadcast(few) if few.count() <= MOST_BROADCAST else few


def log_ratios(docs: DataFrame, sample: DataFrame, p: Quality) -> list[float]:
    """log(p_trusted / p_raw) of each bucket; raw counts are over all documents.

    The model has a fixed number of buckets, so what comes to the driver
    doesn't grow with the corpus. Without trusted documents all ratios are 0.
    """
    trusted = sample.where("kind = 'fit'").select("doc_id", F.lit(1).cast("long").alias("trusted"))
    counts = (
        docs.select("doc_id", "text")
        .join(near(trusted), "doc_id", "left")
        .select("trusted", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("u"))
        .select("trusted", F.concat(word_buckets(F.col("u"), p), pair_buckets(F.col("u"), p)).alias("grams"))
        .select(F.coalesce("trusted", F.lit(0).cast("long")).alias("trusted"), F.explode_outer("grams").alias("bucket"))
        .where("bucket is not null")
        .groupBy("bucket")
        .agg(F.sum("trusted").alias("t"), F.count(F.lit(1)).alias("r"))
        .collect()
    )
    n = p.words + p.pairs
    if not any(row["t"] for row in counts):
        return [0.0] * n
    t, r = [p.smoothing] * n, [p.smoothing] * n
    for row in counts:
        t[row["bucket"]] += row["t"]
        r[row["bucket"]] += row["r"]
    st, sr = sum(t), sum(r)
    return [math.log(a / st) - math.log(b / sr) for a, b in zip(t, r, strict=True)]


def with_scores(docs: DataFrame, ratios: list[float], p: Quality) -> DataFrame:
    """Add to ``docs`` (row, text) the rule columns, score and worst_word: the mean ratio of the text's 1- and 2-grams and the least of its words."""
    table = F.split(F.lit(",".join(f"{v:.9g}" for v in ratios)), ",").cast("array<double>")
    x = base_columns(docs).withColumns({"one": F.transform(word_buckets(F.col("u"), p), lambda g: F.get(table, g)), "two": F.transform(pair_buckets(F.col("u"), p), lambda g: F.get(table, g))}).drop("u")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    n = F.size("one") + F.size("two")
    x = x.withColumn("score", F.when(n > 0, (total("one") + total("two")) / n).otherwise(F.lit(0.0))).withColumn("worst_word", F.coalesce(F.array_min("one"), F.lit(0.0)))
    x = x.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return sealed(x.select("row", *SCORES), *SCORES)


SCORES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "worst_word"]


def threshold(held: list[float], bad: list[float], lost: float) -> float:
    """The bound that rejects the most of ``bad`` and at most the share ``lost`` of ``held``: in the middle of the gap above the bad ones it rejects; -inf if it would reject none."""
    held = sorted(held)
    if not held:
        return -math.inf
    most = held[int(lost * len(held))]
    below = max((v for v in bad if v < most), default=-math.inf)
    return (below + next(v for v in held if v > below)) / 2 if below > -math.inf else -math.inf


def at_rank(values: DataFrame, k: int, most: int = MOST_SORTED) -> float:
    """The value at place ``k``, from 0, of ``values`` (v) in order: bins around it are counted until few are left in its own, so the driver holds a bounded number."""
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    while n > most and low < high:
        place = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        for b in values.where(F.col("v").between(low, high)).groupBy(place.alias("bin")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("bin").collect():
            if k < b["n"]:
                low, high, n = b["low"], b["high"], b["n"]
                break
            k -= b["n"]
    return low if low == high else sorted(r["v"] for r in values.where(F.col("v").between(low, high)).collect())[k]


def bound(rows: DataFrame, column: str, lost: float, most: int = MOST_SORTED) -> float:
    """``threshold`` of a column of ``rows`` (kind, ...), however many they are."""
    held, bad = (rows.where(F.col("kind") == k).select(F.col(column).alias("v")) for k in ("held", "bad"))
    n = held.count()
    if not n:
        return -math.inf
    below = bad.where(F.col("v") < at_rank(held, int(lost * n), most)).agg(F.max("v")).first()[0]
    return -math.inf if below is None else (below + held.where(F.col("v") > below).agg(F.min("v")).first()[0]) / 2


def fitted(scored: DataFrame, kinds: DataFrame, p: Quality) -> tuple[float, float]:
    """The least score and the least worst word that are kept, from all labelled documents, but for the counted ones, that pass the base rules; ``scored`` has doc_id beside the scores."""
    some = scored.where("not base_failed").select("doc_id", "score", "worst_word").join(near(kinds.where("kind <> 'fit'")), "doc_id")
    rows = stored(some.groupBy("doc_id", "kind").agg(F.min("score").alias("score"), F.min("worst_word").alias("worst")), "judged")
    score = bound(rows, "score", p.lost)
    return score, bound(rows.where(F.col("score") >= score), "worst", p.lost)


def judge_quality(docs: DataFrame, labels: DataFrame, params: Quality = Quality(), keep: list[str] | None = None) -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, worst_word and kept to ``docs``.

    ``score`` is the mean over the document's hashed 1- and 2-grams of the log
    ratio between trusted and raw counts, ``worst_word`` the least ratio of its
    1-grams. ``kept`` is false if base_failed, else whether both reach their
    thresholds, which are fitted once on all labelled documents and hold for all.
    ``keep`` names narrow columns, doc_id among them, that are kept of ``docs``:
    then each document is scored once and the scores are stored. Else whole
    rows go on as they are read, and the labelled ones are scored before.
    Null and blank texts have no words, so they fail; repeated rows and ties
    get equal verdicts; null ids are judged like others; texts of any length
    are judged as a whole; an empty table stays empty. Columns of these names
    in ``docs`` are replaced, all others stay. Documents whose labels are
    missing or null are raw text only; without labels all that pass the base
    rules are kept.
    """
    made = [*SCORES, "kept"]
    docs = docs.select(*[c for c in docs.columns if c not in made])
    kinds = labelled(labels, params)
    ratios = log_ratios(docs, kinds, params)
    if keep is None:
        checked = docs.select("doc_id", "text").join(near(kinds.where("kind <> 'fit'").select("doc_id")), "doc_id", "left_semi")
        score, worst = fitted(with_scores(checked.select(F.struct("doc_id").alias("row"), "text"), ratios, params).select("row.doc_id", *SCORES), kinds, params)
        x = with_scores(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), ratios, params)
    else:
        x = stored(with_scores(docs.select(F.struct(*keep).alias("row"), F.col("text")), ratios, params), "scores")
        score, worst = fitted(x.select("row.doc_id", *SCORES), kinds, params)
    x = x.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= score) & (F.col("worst_word") >= worst))
    return x.select("row.*", *made)
