"""Incremental ingest of landed documents into snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema
from ..operators import graph, upsert
from ..sources import buckets, files

DOCUMENT = "source_name STRING, title STRING, full_text STRING, source_url STRING, level STRING, doc_number STRING, issuer STRING, issue_date STRING, effective_date STRING, status STRING"
#: The column of each stored table by which its rows fall into buckets.
KEYS = {"laws": "id", "articles": "law_id", "relations": "from_id", "relation_extractions": "law_id", "wiki_pages": "law_id", "sync_log": "id"}
REFUSED = "line STRING, file STRING, error STRING"


def current(spark: SparkSession, root: str, name: str | None = None) -> dict[str, DataFrame]:
    """A snapshot's tables, by default the newest's, or empty ones."""
    return {t: buckets.read(spark, root, t, ddl, name) for t, ddl in schema.TABLES.items()}


def parsed(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, refused) of JSON lines (value, file): what can't be read as a document is kept with its file and the reason."""
    found = F.from_json("value", f"{DOCUMENT}, broken STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"})
    rows = lines.where("trim(value) <> ''").select("value", "file", found.alias("d"))
    bad = F.col("d").isNull() | F.col("d.broken").isNotNull()
    return rows.where(~bad).select("d.*").drop("broken"), rows.where(bad).select(F.col("value").alias("line"), "file", F.lit("not a JSON document").alias("error"))


def ingest_batch(lines: DataFrame, root: str, name: str) -> bool:
    """Take a batch of JSON lines (value, file) into the next snapshot; returns whether it was taken now.

    Lines that can't be read are stored under ``refused``, before the snapshot
    that says so in its log. A batch rewrites the buckets of the laws it
    changes, of their articles and of what is derived from them, and adds
    new ones; a batch that was taken already changes nothing.
    """
    spark = lines.sparkSession
    if name in buckets.snapshots(spark, root):
        return False
    batch, refused = parsed(lines)
    refused.write.mode("overwrite").parquet(f"{root}/refused/{name}")
    refused = spark.read.schema(REFUSED).parquet(f"{root}/refused/{name}")
    held = current(spark, root)
    actions = upsert.classify(batch, held["laws"]).persist()
    now = spark.sql("SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\") AS now").first()["now"]
    some = lambda t, b: buckets.read(spark, root, t, schema.TABLES[t], some=b)

    updated = actions.where("action = 'update'").select(F.col("current_id").alias("id"))
    changed = buckets.touched(updated, "id")
    laws = upsert.apply(actions, some("laws", changed), now, held["laws"]).persist()
    fresh = laws.join(held["laws"].select("id"), "id", "left_anti").select("id")
    anew = updated.union(fresh)
    own = held["articles"].join(updated.withColumnRenamed("id", "law_id"), "law_id", "left_semi").select("id")
    ends = [held["relations"].join(own.withColumnRenamed("id", c), c, "left_semi").select("from_id") for c in ("from_id", "to_id")]
    stale = updated.select(F.col("id").alias("law_id")).union(graph.referencing(held["relations"], held["articles"], updated))
    # what is rewritten: the buckets with rows that change or go, and those with too many folders that gain rows
    gains = buckets.touched(anew, "id")
    rewritten = {
        "articles": changed | buckets.crowded(spark, root, "articles", gains),
        "relations": buckets.touched(ends[0].union(ends[1]), "from_id") if changed else set(),
        "relation_extractions": buckets.touched(held["relation_extractions"].join(stale, "law_id", "left_semi"), "law_id") if changed else set(),
        "wiki_pages": buckets.touched(held["wiki_pages"].join(updated.withColumnRenamed("id", "law_id"), "law_id", "left_semi"), "law_id") if changed else set(),
    }
    crowded = buckets.crowded(spark, root, "laws", gains) - changed
    relations, wiki, marks = upsert.invalidate(updated, held["articles"], some("relations", rewritten["relations"]), some("wiki_pages", rewritten["wiki_pages"]), some("relation_extractions", rewritten["relation_extractions"]))
    if rewritten["relation_extractions"]:  # laws that refer to the changed ones lose their marks too
        marks = marks.join(stale, "law_id", "left_anti")
    articles = upsert.rebuild_articles(some("articles", rewritten["articles"]), laws, anew, held["articles"])
    errors = refused.select(F.monotonically_increasing_id().alias("at"), F.concat_ws(": ", "file", "error").alias("error"))
    first = errors.orderBy("at").limit(20).withColumn("nth", F.row_number().over(W.orderBy("at")))
    rest = errors.agg((F.count(F.lit(1)) - 20).alias("n")).where("n > 0").select(F.lit(21).alias("nth"), F.lit("").alias("error"))
    log = upsert.run_log("stream", actions, first.select("nth", "error").union(rest)).withColumn("finished_at", F.lit(now))
    log = upsert.next_ids(log, held["sync_log"], "finished_at")
    log = spark.createDataFrame([], schema.TABLES["sync_log"]).unionByName(log, allowMissingColumns=True)
    made = {"laws": (laws.unionByName(some("laws", crowded)), changed | crowded), "articles": (articles, rewritten["articles"]), "sync_log": (log, set())}
    for t, rows in (("relations", relations), ("wiki_pages", wiki), ("relation_extractions", marks)):
        if rewritten[t]:
            made[t] = (rows, rewritten[t])
    columns = {t: [x.strip().split(" ")[0] for x in ddl.split(", ")] for t, ddl in schema.TABLES.items()}
    taken = buckets.publish(spark, root, name, {t: (rows.select(*columns[t]), KEYS[t], b) for t, (rows, b) in made.items()})
    actions.unpersist()
    laws.unpersist()
    return taken


def start_ingest(spark: SparkSession, landing: str, root: str, checkpoint: str) -> StreamingQuery:
    """Run over what is new in the landing folder and stop."""
    lines = spark.readStream.text(landing).select("value", F.col("_metadata.file_name").alias("file"))

    def each(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, root, f"{batch_id:012d}")

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def refused(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(line, file, error) of what a batch couldn't read."""
    return spark.read.schema(REFUSED).parquet(f"{root}/refused/{name}")


def replay(spark: SparkSession, root: str, name: str, mended: DataFrame | None = None) -> str:
    """Take a batch's refused lines again, or mended ones (value, file), as a snapshot of its own; returns its name.

    What still can't be read is refused under that name. Replaying a batch's lines twice changes nothing, as their laws are there already.
    """
    lines = mended if mended is not None else refused(spark, root, name).select(F.col("line").alias("value"), "file")
    last = buckets.snapshots(spark, root)[-1]
    batch, _, n = last.partition("-r")
    again = f"{batch}-r{int(n or 0) + 1:06d}"
    ingest_batch(lines, root, again)
    return again


def latest_per_source(log: DataFrame) -> DataFrame:
    """Running last attempt and last success of each source, from a stream of log rows; state is one row per source."""
    ok = F.when(F.col("status") == "ok", F.col("id"))
    return log.where("source_name is not null").groupBy("source_name").agg(F.max("id").alias("last_id"), F.max(ok).alias("ok_id"))


def progress_events(lines: DataFrame) -> DataFrame:
    """(type, stage, round, query, error) of progress lines (value), JSON a line; lines that aren't are left out."""
    event = F.from_json("value", "type STRING, stage STRING, round INT, query STRING, error STRING")
    return lines.select(event.alias("e")).where("e.type in ('stage', 'result', 'error', 'cancelled')").select("e.*")
