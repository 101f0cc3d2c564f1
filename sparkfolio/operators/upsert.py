"""Ingest: actions per document, versions, derived data, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import titles as T
from ..functions import visibility as V
from ..sources.shared import numbered
from . import graph

LEAST_TEXT = 50
#: Columns of which an update takes the new value, even null.
REPLACED = ["doc_number", "issue_date", "effective_date"]


def next_ids(rows: DataFrame, taken: DataFrame, *order: str) -> DataFrame:
    """``rows`` with id above every taken one, in the given order."""
    top = taken.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    return numbered(rows, *order).withColumn("top", top).withColumn("id", (F.col("top") + F.col("nth")).cast("long")).drop("nth", "top")


def classify(batch: DataFrame, laws: DataFrame) -> DataFrame:
    """``batch`` (source_name, title, full_text, ...) with content_hash, current_id and action.

    Titles and texts lose white space at their ends before anything else. Of a
    batch's documents with one source and title the last by content hash
    counts. Without title or with a short text: skip. The source's current law
    of that title with equal text: skip; with another: update. A new one is
    inserted unless some law has its text already, or another document of the
    batch brings it: of several the first by source and title.
    """
    trimmed = {c: T.strip(F.coalesce(c, F.lit(""))) for c in ("title", "full_text")}
    keyed = batch.withColumns(trimmed).withColumn("content_hash", X.content_hash(F.col("full_text"))).withColumn("source_key", F.coalesce("source_name", F.lit("\0")))
    key = ["source_key", "title"]
    # decided on narrow rows; the texts travel once, to their source and title
    bad = (F.col("title") == "") | (F.length("full_text") < LEAST_TEXT)
    x = keyed.select(*key, "source_name", "content_hash", bad.alias("bad")).groupBy(*key).agg(F.max_by(F.struct("source_name", "content_hash", "bad"), "content_hash").alias("d")).select(*key, "d.*")
    current = laws.where(V.edge_ok()).groupBy("source_name", "title").agg(F.min_by(F.struct("id", "content_hash"), "id").alias("now")).select("source_name", "title", F.col("now.id").alias("current_id"), F.col("now.content_hash").alias("current_hash"))
    held = laws.select("content_hash", F.lit(True).alias("held")).distinct()
    x = x.join(current, ["source_name", "title"], "left").join(held, "content_hash", "left")
    action = F.when(F.col("bad"), "skip").when(F.col("current_hash") == F.col("content_hash"), "skip").when(F.col("current_id").isNotNull(), "update").when(F.col("held"), "skip").otherwise("insert")
    x = x.withColumn("action", action)
    by = F.struct((F.col("action") == "insert").alias("new"), F.coalesce("source_name", F.lit("")).alias("source"), "title")
    first = x.where("action <> 'skip'").groupBy("content_hash").agg(F.min(by).alias("first"))
    again = (F.col("action") == "insert") & (by != F.col("first"))
    told = x.join(first, "content_hash", "left").select(*key, "current_id", F.when(again, "skip").otherwise(F.col("action")).alias("action"))
    latest = keyed.groupBy(*key).agg(F.max_by(F.struct(*[c for c in keyed.columns if c not in key]), "content_hash").alias("d")).select(*key, "d.*")
    return latest.join(told, key).select(*[c for c in (*batch.columns, "content_hash")], "current_id", "action")


def apply(actions: DataFrame, laws: DataFrame, now: str, every: DataFrame | None = None) -> DataFrame:
    """The laws after the actions: a changed law keeps its id, its old text becomes a row of its own that names it in superseded_by.

    ``laws`` may be a part of ``every`` law that holds the changed ones; the others are looked at for their ids and hashes only.
    """
    every = laws if every is None else every
    changed = actions.where("action = 'update'").select(F.col("current_id").alias("id"), F.struct("full_text", "content_hash", "title", *[c for c in (*REPLACED, "issuer", "status") if c in actions.columns]).alias("new"))
    joined = laws.join(changed, "id", "left")
    has = lambda c: c in actions.columns
    made = {
        "full_text": F.col("new.full_text"),
        "content_hash": F.col("new.content_hash"),
        "updated_at": F.lit(now),
        "version_label": T.version_label(F.col("new.title")),
        **{c: F.col(f"new.{c}") for c in REPLACED if has(c)},
        **{c: F.coalesce(F.col(f"new.{c}"), F.col(c)) for c in ("issuer", "status") if has(c)},
    }
    updated = joined.select(*[F.when(F.col("new").isNotNull(), made[c]).otherwise(F.col(c)).alias(c) if c in made else F.col(c) for c in laws.columns])
    # a version that another row holds already isn't kept twice
    elsewhere = every.select("content_hash", F.col("id").alias("other_id"))
    replaced = joined.where("new is not null").select(*laws.columns)
    twice = replaced.select("id", "content_hash").join(elsewhere, "content_hash").where("id <> other_id").select("id").distinct()
    old = replaced.join(twice, "id", "left_anti").withColumns({"superseded_by": F.col("id"), "status": F.lit("已修订")}).drop("id")
    fresh = actions.where("action = 'insert'")
    blank = {c: F.lit(None).cast(t) for c, t in laws.dtypes if c != "id"}
    fresh = fresh.select(*[(F.col(c) if c in fresh.columns else blank[c]).alias(c) for c in laws.columns if c != "id"])
    fresh = fresh.withColumns({"status": F.coalesce("status", F.lit("现行有效")), "created_at": F.lit(now), "version_label": T.version_label(F.col("title"))})
    new = next_ids(old.unionByName(fresh), every, "source_name", "title", "content_hash")
    return updated.unionByName(new.select(*laws.columns))


def rebuild_articles(articles: DataFrame, laws: DataFrame, changed: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """Articles with those of the changed laws (id) split again; ids go on from the highest of ``every`` article, if ``articles`` are a part."""
    kept = articles.join(changed.select(F.col("id").alias("law_id")), "law_id", "left_anti")
    made = X.split_articles(laws.join(changed.select("id"), "id", "left_semi")).select("law_id", "pos", "article_no", "text")
    fresh = next_ids(made, articles if every is None else every, "law_id", "pos").withColumn("embedding", F.lit(None).cast("array<float>"))
    return kept.unionByName(fresh.select(*kept.columns))


def invalidate(changed: DataFrame, articles: DataFrame, relations: DataFrame, wiki: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relations, wiki, marks) without what the changed laws (id) made stale: relations that touch them, their pages, their marks and those of laws that refer to them."""
    own = articles.join(changed.select(F.col("id").alias("law_id")), "law_id", "left_semi").select("id")
    left = relations.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_anti").join(own.withColumnRenamed("id", "to_id"), "to_id", "left_anti")
    ids = changed.select(F.col("id").alias("law_id"))
    stale = ids.union(graph.referencing(relations, articles, changed)).distinct()
    return left.select(*relations.columns), wiki.join(ids, "law_id", "left_anti"), marks.join(stale, "law_id", "left_anti")


def mark_attempts(marks: DataFrame, outcome: DataFrame) -> DataFrame:
    """Marks after a run (law_id, status, ...): attempts go up by one, all else is the run's."""
    old = marks.select("law_id", F.struct(*[c for c in marks.columns if c != "law_id"]).alias("old"))
    joined = old.join(outcome.select("law_id", F.struct(*[c for c in outcome.columns if c != "law_id"]).alias("new")), "law_id", "full")
    made = [c for c in outcome.columns if c != "law_id"]

    def value(c: str, kind: str):
        if c == "attempts":
            return F.when(F.col("new").isNotNull(), F.coalesce("old.attempts", F.lit(0)) + 1).otherwise(F.col("old.attempts")).cast(kind)
        return F.when(F.col("new").isNotNull(), F.col(f"new.{c}") if c in made else F.lit(None)).otherwise(F.col(f"old.{c}")).cast(kind)

    return joined.select("law_id", *[value(c, t).alias(c) for c, t in marks.dtypes if c != "law_id"])


def overwrite(table: DataFrame, rows: DataFrame, key: str, newest: str) -> DataFrame:
    """Last write wins: per key the row with the greatest ``newest``."""
    both = table.unionByName(rows)
    return both.groupBy(key).agg(F.max_by(F.struct(*both.columns), newest).alias("r")).select("r.*")


def add_missing(table: DataFrame, rows: DataFrame, *key: str) -> DataFrame:
    """Rows whose key the table lacks are added once."""
    fresh = rows.dropDuplicates(list(key)).join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*rows.columns), allowMissingColumns=True)


def run_log(source: str, actions: DataFrame, errors: DataFrame) -> DataFrame:
    """The log row of a run: counts, status and the first 20 errors (nth, error)."""
    n = actions.agg(F.count_if(F.col("action") == "insert").cast("int").alias("new_count"), F.count_if(F.col("action") == "update").cast("int").alias("updated_count"))
    bad = errors.agg(F.count(F.lit(1)).alias("n"), F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= 20, F.struct("nth", "error")))), lambda e: e["error"]), 1, 20), "; ").alias("detail"))
    done = F.col("new_count") + F.col("updated_count")
    x = n.withColumns({"n": bad.select("n").scalar(), "detail": bad.select("detail").scalar()})
    return x.select(F.lit(source).alias("source_name"), "new_count", "updated_count", F.when(F.col("n") == 0, "ok").when(done > 0, "partial").otherwise("failed").alias("status"), "detail")


def keep_last(messages: DataFrame, n: int = 40, chars: int = 8000) -> DataFrame:
    """Of each conversation's messages (conv_id, turn, ...) the last ``n``, texts cut to ``chars``; Spark limits each group before the shuffle."""
    last = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("rn", F.row_number().over(last)).where(F.col("rn") <= n).drop("rn").withColumn("text", F.substring("text", 1, chars))


def recent_views(views: DataFrame, n: int = 6) -> DataFrame:
    """(user, law_id, viewed) of each user's last ``n`` different laws in views (user, law_id, viewed)."""
    last = views.groupBy("user", "law_id").agg(F.max("viewed").alias("viewed"))
    rank = F.row_number().over(W.partitionBy("user").orderBy(F.desc("viewed"), "law_id"))
    return last.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def client_history(messages: DataFrame, n: int = 80) -> DataFrame:
    """Of each conversation's messages (conv_id, turn, role, ...) the last ``n``, less assistant's ones that would come first."""
    kept = messages.withColumn("rn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("rn") <= n).drop("rn")
    first = kept.groupBy("conv_id").agg(F.min(F.when(F.col("role") != "assistant", F.col("turn"))).alias("first_turn"))
    return kept.join(first, "conv_id").where(F.col("turn") >= F.col("first_turn")).drop("first_turn")
