"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators between words: the space and the control characters tab to carriage return.
WORD_GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text, in order; none for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a folder of this machine only where no other has executors."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="sparkfolio-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage with a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for tables or files an operator writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, under: str | None = None) -> DataFrame:
    """Compute ``df`` once into a Parquet table in the shared folder, or a folder ``under`` it: for large tables, smaller and read by column."""
    path = f"{under}/{name}-{uuid.uuid4().hex}" if under else scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of stored tables that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def row_key(df: DataFrame, *cols: str) -> Column:
    """Two independent hashes of the given columns and their nulls: equal for equal rows."""
    parts = [F.struct(F.col(c).isNull(), F.col(c)) for c in cols]
    return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts, F.lit(7)).alias("b"))


def sealed(df: DataFrame, *made: str) -> DataFrame:
    """``df`` with the columns ``made`` behind a one-element generator.

    Otherwise a later filter on them would be pushed below and their
    definitions inlined into each other's lambdas, which turns a pass over an
    array into a pass per element. For the same reason arrays built by lambdas
    are exploded with the outer generators: the plain ones add such a filter.
    """
    rest = [c for c in df.columns if c not in made]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*made))))
