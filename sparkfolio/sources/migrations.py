"""Ordered changes of stored tables, each recorded with the snapshot that it makes.

A step appears as one snapshot with its number in the ledger, or not at all: a
step that fails leaves the tables and the version as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import buckets

LEDGER = "version INT, name STRING, applied_at STRING"
Change = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Step:
    """A version's number and name, and for each table it changes: the schema it reads, the bucket key, and what becomes of the rows."""

    version: int
    name: str
    tables: dict[str, tuple[str, str, Change]]


def version(spark: SparkSession, root: str) -> int:
    """The last version that was applied, 0 before any."""
    return buckets.read(spark, root, "ledger", LEDGER).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def ledger(spark: SparkSession, root: str) -> DataFrame:
    return buckets.read(spark, root, "ledger", LEDGER)


def migrate(spark: SparkSession, root: str, steps: list[Step]) -> int:
    """Apply the steps above the recorded version in order; returns the version reached. Run again it changes nothing."""
    numbers = [s.version for s in steps]
    if numbers != sorted(set(numbers)):
        raise ValueError("steps have to ascend")
    at = version(spark, root)
    whole = set(range(buckets.BUCKETS))
    for step in steps:
        if step.version <= at:
            continue
        changes = {t: (change(buckets.read(spark, root, t, ddl)), key, whole) for t, (ddl, key, change) in step.tables.items()}
        row = spark.createDataFrame([(step.version, step.name)], "version int, name string").withColumn("applied_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
        last = (buckets.snapshots(spark, root) or [""])[-1]
        # sorts behind the newest snapshot and before the next batch's
        if not buckets.publish(spark, root, f"{last}-v{step.version:06d}", {**changes, "ledger": (row, "version", set())}):
            raise RuntimeError(f"another job took version {step.version}")
        at = step.version
    return at
