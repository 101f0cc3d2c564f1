"""Tables kept between jobs in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where no other has executors."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="sparkfolio-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Compute ``df`` once into a Parquet table there."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with nth, from 1 in the given order.

    Rows are dealt to ranges of the order and stored; counts per range give
    offsets, so no task numbers all rows.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(rows.repartitionByRange(parts, *order).withColumn("range_part", F.spark_partition_id()), "numbered")
    from pyspark.sql import Window as W

    upto = W.orderBy("range_part").rowsBetween(W.unboundedPreceding, -1)  # over the ranges
    offsets = ranged.groupBy("range_part").agg(F.count(F.lit(1)).alias("n")).select("range_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    within = W.partitionBy("range_part").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "range_part").withColumn("nth", (F.col("before") + F.row_number().over(within)).cast("long")).drop("range_part", "before")
