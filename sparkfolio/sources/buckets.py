"""Tables in buckets of a hash of their key, in snapshots that name the folders of each bucket.

A batch writes new folders for the buckets that it changes and adds folders to
those that only gain rows; the snapshot that appears at the end names them and
all others' old ones. Folders are never changed, so readers of an older snapshot
are undisturbed, and a batch that fails half-way leaves nothing that counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files

#: Buckets of a table, fixed for a root. A batch of few documents rewrites as many at most.
BUCKETS = 64
#: A bucket of more folders is written anew when a batch touches it.
MOST_FOLDERS = 8
NAMED = "table string, bucket int, folder string"


def bucket_of(key: str | Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Snapshots under a root, oldest first."""
    fs, p = files._fs(spark, f"{root}/snapshots")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def folders(spark: SparkSession, root: str, name: str | None = None) -> dict[str, dict[int, list[str]]]:
    """The folders of each bucket of each table in a snapshot, by default the newest; at most BUCKETS * MOST_FOLDERS or so a table."""
    held = snapshots(spark, root)
    out: dict[str, dict[int, list[str]]] = {}
    if held:
        for r in spark.read.schema(NAMED).parquet(f"{root}/snapshots/{name or held[-1]}").collect():
            out.setdefault(r["table"], {}).setdefault(r["bucket"], []).append(r["folder"])
    return out


def read(spark: SparkSession, root: str, table: str, ddl: str, name: str | None = None, some: set[int] | None = None) -> DataFrame:
    """A table of a snapshot, or those of its buckets that are asked for."""
    own = folders(spark, root, name).get(table, {})
    paths = sorted(f"{root}/{f}" for b, fs in own.items() if some is None or b in some for f in fs)
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def touched(rows: DataFrame, key: str) -> set[int]:
    """The buckets that rows fall into."""
    return {r[0] for r in rows.select(bucket_of(key)).distinct().collect()}


def publish(spark: SparkSession, root: str, name: str, changes: dict[str, tuple[DataFrame, str, set[int]]]) -> bool:
    """A new snapshot of the newest one and ``changes``: by table its rows, their key, and the buckets that the rows replace.

    Rows of other buckets are added to what these hold. Returns whether the
    snapshot is this call's: one of that name that is there already stays.
    """
    named = folders(spark, root)
    if name in snapshots(spark, root):
        return False
    for table, (rows, key, replaced) in changes.items():
        own = named.setdefault(table, {})
        for b in replaced:
            own[b] = []
        made = f"data/{table}/{name}-{uuid.uuid4().hex[:8]}"
        # a bucket too large for one task is dealt to several
        rows.withColumn("bucket", bucket_of(key)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{root}/{made}")
        fs, p = files._fs(spark, f"{root}/{made}")
        for s in fs.listStatus(p):
            folder = s.getPath().getName()
            if folder.startswith("bucket="):
                own.setdefault(int(folder.removeprefix("bucket=")), []).append(f"{made}/{folder}")
    rows = [(t, b, f) for t, own in named.items() for b, fs_ in own.items() for f in fs_]
    made = f"{root}/made/{uuid.uuid4().hex}"
    spark.createDataFrame(rows, NAMED).coalesce(1).write.parquet(made)
    fs, source = files._fs(spark, made)
    target = files._fs(spark, f"{root}/snapshots/{name}")[1]
    fs.mkdirs(target.getParent())
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, True)
    return False


def crowded(spark: SparkSession, root: str, table: str, added: set[int]) -> set[int]:
    """Those of the buckets about to gain rows that have too many folders already."""
    own = folders(spark, root).get(table, {})
    return {b for b in added if len(own.get(b, [])) >= MOST_FOLDERS}


def vacuum(spark: SparkSession, root: str, keep: int = 5) -> int:
    """Delete all but the newest snapshots and the folders that no kept one names; returns how many folders went."""
    held = snapshots(spark, root)
    kept = held[-max(1, keep) :]
    needed = {f for name in kept for own in folders(spark, root, name).values() for fs in own.values() for f in fs}
    dropped = {f for name in held if name not in kept for own in folders(spark, root, name).values() for fs in own.values() for f in fs}
    fs = files._fs(spark, root)[0]
    for name in held:
        if name not in kept:
            fs.delete(files._fs(spark, f"{root}/snapshots/{name}")[1], True)
    for f in dropped - needed:
        fs.delete(files._fs(spark, f"{root}/{f}")[1], True)
    return len(dropped - needed)
