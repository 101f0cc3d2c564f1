"""Catalogue, reader and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import visibility as V
from ..functions.numerals import normalize_article_no

# The columns a catalogue page shows.
CARD = ["id", "title", "doc_number", "issuer", "level", "topic_tags", "issue_date", "effective_date", "status", "source_name", "source_url", "updated_at"]


def cards(laws: DataFrame) -> DataFrame:
    """The columns of a catalogue page, without texts."""
    return laws.select(*[c for c in CARD if c in laws.columns])


def by_id(laws: DataFrame, law_id: int) -> DataFrame:
    return laws.where(F.col("id") == law_id)


def latest_runs(log: DataFrame) -> DataFrame:
    """One row: the last attempt and the last success of all, in one aggregation."""
    ok = F.when(F.col("status") == "ok", F.col("id"))
    return log.agg(F.max("id").alias("last_id"), F.max_by("source_name", "id").alias("last_source"), F.max_by("status", "id").alias("last_status"), F.max(ok).alias("ok_id"), F.max_by("source_name", ok).alias("ok_source"))


def check_page(number: int, size: int, sort: str = "id") -> None:
    if not 1 <= number <= 1_000_000 or not 1 <= size <= 100:
        raise ValueError("page from 1 to 1000000 and page size from 1 to 100")
    if sort not in ("id", "updated"):
        raise ValueError("sort is id or updated")


def counts(df: DataFrame, by: Column, name: str, blank: bool = False) -> DataFrame:
    """(name, n) of the values of ``by``, most first; null and blank ones only if ``blank``."""
    rows = df.select(by.alias(name))
    rows = rows if blank else rows.where(F.trim(name) != "")
    return rows.groupBy(name).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name)


def topic_facet(laws: DataFrame, tags: str = "topic_tags") -> DataFrame:
    """(topic, n): laws per topic; one law counts once however often it repeats a topic."""
    return laws.select(F.explode_outer(V.topics(F.col(tags))).alias("topic")).where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "topic")


def content_updated(laws: DataFrame) -> DataFrame:
    return laws.agg(F.max(F.coalesce("updated_at", "created_at")).alias("content_updated_at"))


def latest_per_source(log: DataFrame) -> DataFrame:
    """Last attempt and last success of each source, in one aggregation."""
    ok = F.col("status") == "ok"
    return (
        log.where("source_name is not null")
        .groupBy("source_name")
        .agg(F.max("id").alias("last_id"), F.max_by("status", "id").alias("last_status"), F.max_by("finished_at", "id").alias("last_finished"), F.max(F.when(ok, F.col("id"))).alias("ok_id"), F.max_by(F.when(ok, F.col("finished_at")), F.when(ok, F.col("id"))).alias("ok_finished"))
    )


def stats(laws: DataFrame, articles: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of totals; each table is read once."""
    of_laws = laws.agg(F.count(F.lit(1)).alias("total_laws"), F.count_if(V.active()).alias("laws"))
    seen = articles.join(laws.select(F.col("id").alias("law_id"), V.active().alias("is_active")), "law_id", "left")
    some = F.col("embedding").isNotNull()
    of_articles = seen.agg(F.count(F.lit(1)).alias("articles"), F.count_if(some).alias("embedded"), F.count_if(F.col("is_active")).alias("searchable"), F.count_if(F.col("is_active") & some).alias("embedded_searchable"))
    coverage = F.when(F.col("searchable") > 0, F.round(100.0 * F.col("embedded_searchable") / F.col("searchable"))).otherwise(0.0)
    # one row each
    return of_laws.crossJoin(of_articles).crossJoin(relations.agg(F.count(F.lit(1)).alias("relations"))).withColumn("coverage", coverage)


def list_laws(laws: DataFrame, sort: str = "id", number: int = 1, size: int = 20, q: str | None = None, matched: DataFrame | None = None, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total) of active laws that pass the filters; ``q`` is met by the title or, in ``matched`` (law_id), by an article."""
    check_page(number, size, sort)
    found = laws.where(V.active() & V.law_filters(**filters))
    if q:
        in_title = V.contains_ci(F.col("title"), q)
        if matched is not None:
            hit = matched.select(F.col("law_id").alias("id"), F.lit(True).alias("hit")).distinct()
            found = found.join(hit, "id", "left").where(in_title | F.coalesce("hit", F.lit(False))).drop("hit")
        else:
            found = found.where(in_title)
    order = [F.desc("id")] if sort == "id" else [F.coalesce("updated_at", "created_at").desc_nulls_last(), F.desc("id")]
    return found.orderBy(*order).offset((number - 1) * size).limit(size), found.agg(F.count(F.lit(1)).alias("total"))


def article_index(articles: DataFrame, law_id: int) -> DataFrame:
    return articles.where(F.col("law_id") == law_id).select("id", "article_no").orderBy("id")


def reader(articles: DataFrame, laws: DataFrame, law_id: int, number: int = 1, size: int = 50, article_no: str | None = None, q: str | None = None) -> tuple[DataFrame, int, int, int | None]:
    """(page, total, page number, target id) of a law's articles.

    An article number leads to its page, met exactly or by its normal form; a
    text filter counts only without it. A law without articles is one article,
    its text.
    """
    check_page(number, size)
    own = articles.where(F.col("law_id") == law_id).select("id", "article_no", "text")
    text = laws.where(F.col("id") == law_id).select(F.lit(None).cast("long").alias("id"), F.lit("全文").alias("article_no"), F.col("full_text").alias("text"))
    none = own.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    rows = own.unionByName(text.where(none & (F.coalesce("text", F.lit("")) != "")))
    target = None
    if article_no:
        placed = own.withColumn("at", F.row_number().over(W.orderBy("id")) - 1)
        wanted = F.lit(article_no)
        hit = placed.where((F.col("article_no") == wanted) | (normalize_article_no(F.col("article_no")) == normalize_article_no(wanted)))
        row = hit.orderBy(F.col("article_no") != wanted, "at").select("id", "at").first()
        if row:
            target, number = row["id"], row["at"] // size + 1
    elif q:
        rows = rows.where(V.contains_ci(F.coalesce("article_no", F.lit("")), q) | V.contains_ci(F.col("text"), q))
    return rows.orderBy("id").offset((number - 1) * size).limit(size), rows.count(), number, target


def fingerprint(laws: DataFrame, relations: DataFrame, changed: Column) -> DataFrame:
    """One row (laws, relations, changed, last_id): equal as long as what a cached graph was made from is."""
    counted = laws.agg(F.count(F.lit(1)).alias("laws"), F.max(changed).alias("changed"), F.max("id").alias("last_id"))
    return counted.withColumn("relations", relations.agg(F.count(F.lit(1)).alias("n")).scalar())


def stale(rows: DataFrame, changed: Column, now: Column, days: int = 7) -> DataFrame:
    """``rows`` with ``stale``: last changed more than ``days`` days before ``now``, or never."""
    return rows.withColumn("stale", F.coalesce(changed < now - F.make_dt_interval(F.lit(days)), F.lit(True)))
