"""Duplicates, quality flags, status edits, and the report on them."""

from __future__ import annotations

import difflib
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

from ..functions import titles as T
from ..functions import visibility as V

SIMILAR, SHORT_TEXT, SHORT_ARTICLE = 0.95, 200, 5
#: Where the stretch of a text that is compared ends: texts are compared as a whole.
COMPARED = None


def runs(a: str, places: dict[str, list[int]], b: str) -> list[tuple[list[int], dict[str, list[int]]]] | None:
    """By length: where in ``a`` the runs of so many characters begin that are in ``b`` too, and where those are in ``b``; only of characters that have ``places``. None if runs are many, as where few characters are too common for difflib."""
    begins, found, size, total = [i for i, c in enumerate(a) if c in places], places, 1, 0
    made = []
    while begins:
        total += len(begins)
        if total > len(a) // 2:
            return None
        made.append((begins, found))
        longer = {a[i : i + size + 1] for i in begins if a[i + size : i + size + 1] in places}
        more: dict[str, list[int]] = {}
        for run in {x[:-1] for x in longer}:
            for j in found[run]:
                if b[j : j + size + 1] in longer:
                    more.setdefault(b[j : j + size + 1], []).append(j)
        begins, found, size = [i for i in begins if a[i : i + size + 1] in more], more, size + 1
    return made


def longest_match(a: str, b: str):
    """difflib's find_longest_match of two texts as a function, which looks runs up instead of meeting all places of a character.

    The block is the longest run of characters that aren't too common, the
    first of them in ``a`` and then in ``b``, grown by equal characters.
    """
    matcher = difflib.SequenceMatcher(None, a, b)
    made = runs(a, matcher.b2j, b)
    if made is None:
        return matcher.find_longest_match

    def find(alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        i, j, k = alo, blo, 0
        for size in range(min(len(made), ahi - alo, bhi - blo), 0, -1):
            begins, found = made[size - 1]
            for at in range(bisect_left(begins, alo), bisect_left(begins, ahi - size + 1)):
                js = found[a[begins[at] : begins[at] + size]]
                q = bisect_left(js, blo)
                if q < len(js) and js[q] + size <= bhi:
                    i, j, k = begins[at], js[q], size
                    break
            if k:
                break
        while i > alo and j > blo and a[i - 1] == b[j - 1]:
            i, j, k = i - 1, j - 1, k + 1
        while i + k < ahi and j + k < bhi and a[i + k] == b[j + k]:
            k += 1
        return i, j, k

    return find


def ratio(a: str, b: str) -> float | None:
    """difflib's share of matching characters of two texts, or null as soon as what isn't compared yet can't bring it to the threshold.

    Matching blocks are looked for in the stretches that earlier ones leave,
    as difflib does; a stretch pair holds no more than the shorter one's characters.
    """
    both = len(a) + len(b)
    if a == b:
        return 1.0
    find, matched, left, queue = longest_match(a, b), 0, min(len(a), len(b)), [(0, len(a), 0, len(b))]
    while queue and 2.0 * (matched + left) / both >= SIMILAR:
        alo, ahi, blo, bhi = queue.pop()
        i, j, k = find(alo, ahi, blo, bhi)
        matched, left = matched + k, left - min(ahi - alo, bhi - blo)
        # without a block nothing in the stretches matches; the longer ones come last, so that small ones that don't match are known first
        rest = [x for x in ((alo, i, blo, j), (i + k, ahi, j + k, bhi)) if k and x[0] < x[1] and x[2] < x[3]]
        queue += sorted(rest, key=lambda x: x[0] - x[1])
        left += sum(min(x[1] - x[0], x[3] - x[2]) for x in rest)
    return 2.0 * matched / both if 2.0 * (matched + left) / both >= SIMILAR else None


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters of two whole texts, by difflib; null below the threshold."""
    return pd.Series([ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def could_be_similar(a, b):
    """An upper bound of the similarity from the lengths alone reaches the threshold."""
    return 2.0 * F.least(a, b) >= SIMILAR * (a + b)


def could_match(a: str, b: str) -> bool:
    """An upper bound of the similarity reaches the threshold: matched characters are the same on both sides."""
    return 2.0 * (Counter(a) & Counter(b)).total() >= SIMILAR * (len(a) + len(b))


@F.pandas_udf(BooleanType())
def may_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([could_match(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="bool")


def to_compare(likely: DataFrame, fine: DataFrame) -> DataFrame:
    """(id, keeper_id, mine, other): those pairs (id, keeper_id), with their texts, whose characters let them be similar.

    Pairs are dealt to tasks by their id before they are compared, since
    comparing takes far longer than reading and a keeper may be in most pairs.
    """
    n = int(likely.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = fine.select(F.col("id").alias("of_id"), F.col("full_text").alias("text"))
    both = likely.select("id", "keeper_id").join(texts.toDF("keeper_id", "other"), "keeper_id").repartition(n, "id").join(texts.toDF("id", "mine"), "id")
    return both.where(may_match("mine", "other")).select("id", "keeper_id", "mine", "other")


def keepers(laws: DataFrame, group, rank) -> DataFrame:
    """(grp, keeper_id, keeper_hash, keeper_chars): of each group the law of the best rank, then the longest text, then the lowest id; an aggregation of narrow rows, so no group is sorted in one task."""
    chars = F.length(F.coalesce("full_text", F.lit("")))
    best = F.min_by(F.struct("id", "content_hash", chars.alias("chars")), F.struct(-rank, -chars, F.col("id"))).alias("k")
    return laws.groupBy(group.alias("grp")).agg(best, F.count(F.lit(1)).alias("n")).where("n > 1").select("grp", F.col("k.id").alias("keeper_id"), F.col("k.content_hash").alias("keeper_hash"), F.col("k.chars").alias("keeper_chars"))


def duplicates(laws: DataFrame, group=None, rank=None) -> DataFrame:
    """(id, duplicate_of, similarity): laws with the title of a keeper and an equal hash or a similar text.

    Each is compared with its group's keeper only, and only if the lengths and
    then the characters' numbers allow it: bounds that leave no
    similar pair out and spare most comparisons.
    """
    group = T.normalize_title(F.col("title")) if group is None else group
    rank = T.source_rank(F.col("source_name")) if rank is None else rank
    fine = laws.where(V.edge_ok())
    slim = fine.select("id", "content_hash", F.length(F.coalesce("full_text", F.lit(""))).alias("chars"), group.alias("grp"))
    pairs = slim.join(keepers(fine, group, rank), "grp").where(F.col("id") != F.col("keeper_id"))
    same = F.coalesce(F.col("content_hash") == F.col("keeper_hash"), F.lit(False))
    likely = pairs.where(same | could_be_similar(F.col("chars"), F.col("keeper_chars"))).select("id", "keeper_id", same.alias("same"))
    scored = to_compare(likely.where("not same"), fine).select("id", "keeper_id", similarity("mine", "other").alias("similarity"))
    scored = scored.unionByName(likely.where("same").select("id", "keeper_id", F.lit(1.0).alias("similarity")))
    return scored.where(F.col("similarity") >= SIMILAR).select("id", F.col("keeper_id").alias("duplicate_of"), "similarity")


def flag(laws: DataFrame, articles: DataFrame, found: DataFrame) -> DataFrame:
    """Laws with duplicate_of and quality_flag: duplicate; empty_text over it; unsplit only where no flag is."""
    some = articles.select(F.col("law_id").alias("id"), F.lit(True).alias("has_articles")).distinct()
    marked = found.select("id", F.col("duplicate_of").alias("new_dup"))
    x = laws.join(marked, "id", "left").join(some, "id", "left")
    short = F.length(T.strip(F.coalesce("full_text", F.lit("")))) < SHORT_TEXT
    flagged = F.when(short, "empty_text").when(F.col("new_dup").isNotNull(), "duplicate").otherwise(F.col("quality_flag"))
    x = x.withColumns({"quality_flag": flagged, "duplicate_of": F.coalesce("new_dup", "duplicate_of")})
    unsplit = F.col("quality_flag").isNull() & F.col("has_articles").isNull()
    return x.withColumn("quality_flag", F.when(unsplit, "unsplit").otherwise(F.col("quality_flag"))).select(*laws.columns)


def real_articles(articles: DataFrame) -> DataFrame:
    """Articles whose text has 5 characters or more."""
    return articles.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= SHORT_ARTICLE)


def report(laws: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of counts, a pass over each table."""
    tiny = articles.agg(F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < SHORT_ARTICLE).alias("empty_articles"))
    return laws.agg(
        F.count(F.lit(1)).alias("laws"),
        *[F.count_if(F.col("quality_flag") == f).alias(f) for f in ("duplicate", "empty_text", "unsplit")],
    ).withColumn("empty_articles", tiny.scalar())


def status_counts(laws: DataFrame) -> DataFrame:
    return laws.where(V.edge_ok()).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def set_status(laws: DataFrame, title: str, status: str, allowed: list[str], dry_run: bool = False) -> tuple[DataFrame, list[int]]:
    """(laws, ids): the status of the one law whose title is, or else contains, the given one. None: no ids; several: an error."""
    if status not in allowed:
        raise ValueError(f"status is one of {', '.join(allowed)}")
    fine = laws.where(V.edge_ok())
    ids = [r["id"] for r in fine.where(F.col("title") == title).select("id").limit(2).collect()] or [r["id"] for r in fine.where(V.contains_ci(F.col("title"), title)).select("id").limit(2).collect()]
    if len(ids) > 1:
        raise ValueError(f"several laws fit {title!r}")
    if dry_run or not ids:
        return laws, ids
    return laws.withColumn("status", F.when(F.col("id") == ids[0], status).otherwise(F.col("status"))), ids
