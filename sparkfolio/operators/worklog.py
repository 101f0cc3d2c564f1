"""Extraction as a work loop: laws are leased for a time, outcomes count once however often a batch reports.

Leases and marks are stored in buckets; of workers that lease or report at the
same time one snapshot wins and the others look again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..sources import buckets
from . import graph

#: A failed law is tried so often in all.
ATTEMPTS = 3
MARKS = f"{schema.MARKS}, batch STRING"
LEASES = "law_id BIGINT, batch STRING, until TIMESTAMP"
TABLES = {"marks": MARKS, "leases": LEASES}


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return buckets.read(spark, root, table, TABLES[table])


def _next(spark: SparkSession, root: str) -> str:
    held = buckets.snapshots(spark, root)
    return f"{int(held[-1]) + 1 if held else 0:09d}"


def lease(root: str, laws: DataFrame, articles: DataFrame, n: int = 50, now: str | None = None, minutes: int = 45) -> tuple[str | None, list[int]]:
    """(batch, law ids): up to ``n`` laws that aren't done and that no live lease holds, leased until ``minutes`` from now; (None, []) without any.

    A lease that ran out counts no more, so a lost worker's laws are given out again.
    """
    spark, at = laws.sparkSession, F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    while True:
        name = _next(spark, root)
        live = read(spark, root, "leases").where(F.col("until") > at)
        left = graph.pending(laws.join(live.select(F.col("law_id").alias("id")), "id", "left_anti"), articles, read(spark, root, "marks"), ATTEMPTS, n)
        ids = [r["id"] for r in left.select("id").collect()]  # n at most
        if not ids:
            return None, []
        batch = uuid.uuid4().hex
        rows = spark.createDataFrame([(i, batch) for i in ids], "law_id long, batch string").withColumn("until", at + F.make_dt_interval(mins=F.lit(minutes)))
        own = buckets.touched(rows, "law_id")
        kept = buckets.read(spark, root, "leases", LEASES, some=own).where(F.col("until") > at).join(rows, "law_id", "left_anti")
        if buckets.publish(spark, root, name, {"leases": (kept.select("law_id", "batch", "until").unionByName(rows), "law_id", own)}):
            return batch, ids


def report(root: str, batch: str, outcome: DataFrame) -> int:
    """Mark a batch's outcome (law_id, status, extracted, saved, unmatched, note, attempted_at); returns how many laws it counted for.

    A law counts if the batch still holds its lease or it has run out
    unclaimed, and only once a batch: a mark keeps the batch that made it.
    Attempts go up by one, marks of other laws stay.
    """
    spark = outcome.sparkSession
    while True:
        name = _next(spark, root)
        marks, leases = read(spark, root, "marks"), read(spark, root, "leases")
        done = marks.where(F.col("batch") == batch).select("law_id")
        held = leases.where(F.col("batch") == batch).select("law_id")
        fresh = outcome.dropDuplicates(["law_id"]).join(held, "law_id", "left_semi").join(done, "law_id", "left_anti").persist()
        n, own = fresh.count(), buckets.touched(fresh, "law_id")
        if not n:
            fresh.unpersist()
            return 0
        old = buckets.read(spark, root, "marks", MARKS, some=own)
        tried = old.select("law_id", F.col("attempts").alias("before"))
        made = fresh.join(tried, "law_id", "left").withColumns({"attempts": (F.coalesce("before", F.lit(0)) + 1).cast("int"), "batch": F.lit(batch)}).drop("before")
        rows = old.join(fresh.select("law_id"), "law_id", "left_anti").unionByName(spark.createDataFrame([], MARKS).unionByName(made, allowMissingColumns=True))
        ended = buckets.touched(fresh, "law_id")
        rest = buckets.read(spark, root, "leases", LEASES, some=ended).join(fresh.select("law_id"), "law_id", "left_anti")
        taken = buckets.publish(spark, root, name, {"marks": (rows.select(*[c.split(" ")[0] for c in MARKS.split(", ")]), "law_id", own), "leases": (rest.select("law_id", "batch", "until"), "law_id", ended)})
        fresh.unpersist()
        if taken:
            return n


def work(root: str, laws: DataFrame, articles: DataFrame, extract: Callable[[DataFrame], DataFrame], n: int = 50, minutes: int = 45) -> dict[str, int]:
    """Lease, extract (laws -> outcome) and report until nothing is left; a batch in which nothing succeeds ends the loop. Returns counts."""
    counts = {"batches": 0, "ok": 0, "failed": 0}
    while True:
        batch, ids = lease(root, laws, articles, n, minutes=minutes)
        if batch is None:
            return counts
        outcome = extract(laws.where(F.col("id").isin(ids))).persist()
        report(root, batch, outcome)
        ok = outcome.where("status <> 'failed'").count()
        counts = {"batches": counts["batches"] + 1, "ok": counts["ok"] + ok, "failed": counts["failed"] + outcome.count() - ok}
        outcome.unpersist()
        if not ok:
            return counts
