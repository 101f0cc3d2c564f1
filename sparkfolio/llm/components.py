"""Connected components by alternating star contraction, as joins over the links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """One half-step: each node's neighbours are tied to the least node around it.

    ``larger`` ties the neighbours above the node (seen from both ends), else
    those below it and the node itself. Least neighbours are found by an
    aggregation with map-side combine and joined back, so that a hub's links
    can be split over tasks.
    """
    if larger:
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    else:
        ends = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = ends.groupBy("node").agg(F.min("other").alias("m")).withColumn("m", F.least("m", "node"))
    tied = ends.join(least, "node")
    if larger:
        made = tied.where("other > node").select(F.col("other").alias("a"), F.col("m").alias("b"))
    else:
        made = tied.select(F.col("other").alias("a"), F.col("m").alias("b")).union(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return made.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); component is the least node that can be reached.

    Self-links, null ends and repeated links are ignored; no links give no
    rows. Each round's links are checkpointed to the shared folder; a round
    that changes nothing ends the loop, which takes O(log^2 n) rounds.
    """
    links = cut(links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    print_of = lambda x: x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = print_of(links)
    while before["n"]:
        links = cut(_stars(_stars(links, True), False))
        after = print_of(links)
        if after == before:
            break
        before = after
    # every node now links to the least of its component
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
