"""The law graph kept as stored edges and degrees, to which changes of relations are added with their sign.

A fingerprint that sums over relations says whether the stored graph and the
changes together are what the relations now are: then the changes are folded
into the buckets they touch, else the graph is built anew.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import buckets
from . import graph

TABLES = {"edges": "s BIGINT, t BIGINT, rel_type STRING, n BIGINT", "degrees": "id BIGINT, n_out BIGINT, n_in BIGINT", "print": "one INT, n BIGINT, total DECIMAL(38,0)"}
KEYS = {"edges": "s", "degrees": "id", "print": "one"}


def fingerprint(relations: DataFrame) -> tuple[int, int]:
    """(relations, sum of their hashes): one pass over narrow columns, without a shuffle of rows; adds up over parts."""
    own = F.xxhash64("id", "from_id", "to_id", "rel_type").cast("decimal(38,0)")
    n, total = relations.agg(F.count(F.lit(1)), F.sum(own)).first()
    return n, int(total or 0)


def signed(relations: DataFrame, articles: DataFrame, sign: int) -> DataFrame:
    """(s, t, rel_type, n): edges between laws with how many relations they gain or lose."""
    return graph.law_edges(relations, articles).groupBy("s", "t", "rel_type").agg((F.count(F.lit(1)) * sign).alias("n"))


def summed(deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, degrees) of signed edges, zeros left out."""
    edges = deltas.groupBy("s", "t", "rel_type").agg(F.sum("n").alias("n")).where("n <> 0")
    zero = F.lit(0).cast("long")
    ends = edges.select(F.explode(F.array(F.struct(F.col("s").alias("id"), F.col("n").alias("o"), zero.alias("i")), F.struct(F.col("t").alias("id"), zero.alias("o"), F.col("n").alias("i")))).alias("e"))
    return edges, ends.groupBy("e.id").agg(F.sum("e.o").alias("n_out"), F.sum("e.i").alias("n_in")).where("n_out <> 0 or n_in <> 0")


def read(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored (edges, degrees): edges (s, t, rel_type, n) by how many relations make them, degrees (id, n_out, n_in) as ``graph.degrees`` has them."""
    return tuple(buckets.read(spark, root, t, TABLES[t]) for t in ("edges", "degrees"))


def _publish(spark: SparkSession, root: str, tables: dict[str, tuple[DataFrame, set[int]]], found: tuple[int, int]) -> None:
    held = buckets.snapshots(spark, root)
    prints = spark.createDataFrame([(1, found[0], Decimal(found[1]))], "one int, n long, total decimal(38,0)")
    changes = {t: (rows.select(*[c.split(" ")[0] for c in TABLES[t].split(", ")]), KEYS[t], old) for t, (rows, old) in tables.items()}
    buckets.publish(spark, root, f"{len(held) and int(held[-1]) + 1:09d}", {**changes, "print": (prints, "one", set(range(buckets.BUCKETS)))})


def refresh(root: str, relations: DataFrame, articles: DataFrame, inserted: DataFrame | None = None, deleted: DataFrame | None = None, articles_before: DataFrame | None = None) -> str:
    """Bring the stored graph up to ``relations``; returns ``kept``, ``folded`` or ``rebuilt``.

    ``inserted`` and ``deleted`` are the relations that came and went since;
    deleted ones may refer to ``articles_before`` that are gone. They count
    only if with them the stored fingerprint becomes the relations' own, so a
    change that was told twice, or not at all, leads to a rebuild. Articles
    keep their law for good, so relations say all.
    """
    spark = relations.sparkSession
    now = fingerprint(relations)
    seen = [(r["n"], int(r["total"])) for r in buckets.read(spark, root, "print", TABLES["print"]).collect()]
    if seen == [now]:
        return "kept"
    none = relations.where("false")
    inserted, deleted = none if inserted is None else inserted, none if deleted is None else deleted
    if seen:
        came, went = fingerprint(inserted), fingerprint(deleted)
        if tuple(a + b - c for a, b, c in zip(seen[0], came, went)) == now:
            before = articles if articles_before is None else articles_before
            deltas = signed(inserted, articles, 1).unionByName(signed(deleted, before, -1)).persist()
            edges, degrees = summed(deltas)
            at_edges, at_degrees = buckets.touched(edges, "s"), buckets.touched(degrees, "id")
            old_edges = buckets.read(spark, root, "edges", TABLES["edges"], some=at_edges)
            old_degrees = buckets.read(spark, root, "degrees", TABLES["degrees"], some=at_degrees)
            new_edges = old_edges.unionByName(edges).groupBy("s", "t", "rel_type").agg(F.sum("n").alias("n")).where("n <> 0")
            new_degrees = old_degrees.unionByName(degrees).groupBy("id").agg(F.sum("n_out").alias("n_out"), F.sum("n_in").alias("n_in")).where("n_out <> 0 or n_in <> 0")
            _publish(spark, root, {"edges": (new_edges, at_edges), "degrees": (new_degrees, at_degrees)}, now)
            deltas.unpersist()
            return "folded"
    edges, degrees = summed(signed(relations, articles, 1))
    whole = set(range(buckets.BUCKETS))
    _publish(spark, root, {"edges": (edges, whole), "degrees": (degrees, whole)}, now)
    return "rebuilt"
