"""The graph of laws, its audit, and relation queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import visibility as V
from ..functions.titles import classify
from ..schema import LEVELS, NO_LEVEL


def law_edges(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """(s, t, rel_type, relation_id): relations between articles as relations between their laws."""
    a = articles.select("id", "law_id")
    s = a.select(F.col("id").alias("from_id"), F.col("law_id").alias("s"))
    t = a.select(F.col("id").alias("to_id"), F.col("law_id").alias("t"))
    return relations.join(s, "from_id").join(t, "to_id").select("s", "t", "rel_type", F.col("id").alias("relation_id"))


def edges(relations: DataFrame, articles: DataFrame, laws: DataFrame) -> DataFrame:
    """Different (s, t, rel_type) between laws that are neither duplicates nor superseded."""
    fine = laws.where(V.edge_ok()).select("id")
    found = law_edges(relations, articles).select("s", "t", "rel_type").distinct()
    return found.join(fine.withColumnRenamed("id", "s"), "s", "left_semi").join(fine.withColumnRenamed("id", "t"), "t", "left_semi")


def degrees(edge_rows: DataFrame) -> DataFrame:
    """(id, n_out, n_in) over all article relations, counted from one pass over the ends."""
    ends = edge_rows.select(F.explode(F.array(F.struct(F.col("s").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("t").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.id").agg(F.sum("e.o").cast("long").alias("n_out"), F.sum("e.i").cast("long").alias("n_in"))


def nodes(laws: DataFrame, relations: DataFrame, articles: DataFrame, board: Callable[[Column], Column] = classify) -> DataFrame:
    """(id, title, level, status, board, n_out, n_in) of the indexable laws."""
    shown = laws.where(V.indexable()).select("id", "title", F.coalesce(F.nullif("level", F.lit("")), F.lit(NO_LEVEL)).alias("level"), F.coalesce("status", F.lit("")).alias("status"), board(F.coalesce("title", F.lit(""))).alias("board"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_out", "n_in")}
    return shown.join(degrees(law_edges(relations, articles)), "id", "left").withColumns(zero)


def adjacency(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """(id, neighbours) over edges with both ends among the nodes, either way."""
    both = induced(node_rows, edge_rows)
    ends = both.select(F.col("s").alias("id"), F.col("t").alias("other")).union(both.select(F.col("t").alias("id"), F.col("s").alias("other")))
    return ends.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def induced(node_rows: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    ids = node_rows.select("id")
    return edge_rows.join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "t"), "t", "left_semi")


def outgoing(relations: DataFrame, articles: DataFrame, laws: DataFrame, law_id: int, incoming: bool = False) -> DataFrame:
    """Relations of a law's articles with both ends' laws and numbers."""
    a = articles.select("id", "law_id", "article_no")
    name = laws.select("id", "title")
    side = lambda p: a.select(*[F.col(c).alias(f"{p}_{c}") for c in a.columns]).join(name.select(F.col("id").alias(f"{p}_law_id"), F.col("title").alias(f"{p}_title")), f"{p}_law_id")
    mine, other = ("to", "from") if incoming else ("from", "to")
    return (
        relations.withColumnsRenamed({"id": "relation_id", "from_id": "r_from", "to_id": "r_to"})
        .join(side(mine).where(F.col(f"{mine}_law_id") == law_id), F.col(f"r_{mine}") == F.col(f"{mine}_id"))
        .join(side(other), F.col(f"r_{other}") == F.col(f"{other}_id"))
    )


def law_relations(relations: DataFrame, articles: DataFrame, laws: DataFrame, law_id: int) -> DataFrame:
    """Outgoing and incoming relations, tagged by direction."""
    tagged = [outgoing(relations, articles, laws, law_id, i).withColumn("direction", F.lit("in" if i else "out")) for i in (False, True)]
    return tagged[0].unionByName(tagged[1])


def wiki_context(relations: DataFrame, articles: DataFrame, laws: DataFrame, law_id: int, n: int = 10) -> DataFrame:
    """The first ``n`` outgoing relations of a law, by id: what a page about it is told of."""
    found = outgoing(relations, articles, laws, law_id)
    return found.select("relation_id", "from_article_no", "rel_type", "note", F.col("to_title").alias("target"), "to_article_no").orderBy("relation_id").limit(n)


def endpoints(relations: DataFrame, articles: DataFrame) -> DataFrame:
    """Relations (id, from_id, to_id, from_law_id, to_law_id, ...) with both ends' laws: from the articles, else what the row itself says."""
    own = articles.select("id", "law_id")
    x = relations.join(own.toDF("from_id", "found_from"), "from_id", "left").join(own.toDF("to_id", "found_to"), "to_id", "left")
    return x.withColumns({"from_law_id": F.coalesce("found_from", "from_law_id"), "to_law_id": F.coalesce("found_to", "to_law_id")}).select(*relations.columns)


def curated(laws: DataFrame, relations: DataFrame, articles: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a fixed set of laws: different edges within it, sorted, and degrees over the article relations within it."""
    inside = law_edges(relations, articles).where(F.col("s").isin(ids) & F.col("t").isin(ids))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_out", "n_in")}
    shown = laws.where(F.col("id").isin(ids)).select("id", "title").join(degrees(inside), "id", "left").withColumns(zero)
    return shown.orderBy("id"), inside.select("s", "t", "rel_type").distinct().orderBy("s", "t", "rel_type")


def symmetric_pairs(relations: DataFrame) -> DataFrame:
    """Relations from a lower to a higher article whose reverse exists with the same type."""
    back = relations.select(F.col("from_id").alias("to_id"), F.col("to_id").alias("from_id"), "rel_type")
    return relations.where("from_id < to_id").join(back, ["from_id", "to_id", "rel_type"], "left_semi")


def isolated(laws: DataFrame, articles: DataFrame, relations: DataFrame) -> DataFrame:
    """Laws none of whose articles is an end of a relation; the ends are stacked, so the join is on keys."""
    ends = relations.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()
    joined = articles.select("id", "law_id").join(ends, "id", "left_semi").select(F.col("law_id").alias("id"))
    return laws.join(joined, "id", "left_anti")


def ghost_marks(marks: DataFrame, articles: DataFrame, relations: DataFrame) -> DataFrame:
    """Marks that claim saved relations of laws without outgoing ones."""
    out = articles.select("id", "law_id").join(relations.select(F.col("from_id").alias("id")), "id", "left_semi").select("law_id")
    return marks.where("saved > 0").join(out, "law_id", "left_anti")


def without_ghosts(marks: DataFrame, articles: DataFrame, relations: DataFrame) -> DataFrame:
    return marks.join(ghost_marks(marks, articles, relations).select("law_id"), "law_id", "left_anti")


def failed_marks(marks: DataFrame, laws: DataFrame) -> DataFrame:
    return marks.where("status = 'failed'").join(laws.select(F.col("id").alias("law_id"), "title"), "law_id")


def audit(laws: DataFrame, articles: DataFrame, relations: DataFrame, marks: DataFrame) -> DataFrame:
    """(check, n)."""
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    return (
        one("symmetric", symmetric_pairs(relations))
        .union(one("isolated", isolated(laws, articles, relations)))
        .union(one("ghost", ghost_marks(marks, articles, relations)))
        .union(one("failed", failed_marks(marks, laws)))
    )


def pending(laws: DataFrame, articles: DataFrame, marks: DataFrame, retries: int = 3, n: int | None = None) -> DataFrame:
    """Laws with articles that aren't done: no mark, or a failed one with retries left; by id, the first ``n`` if given."""
    done = marks.where((F.col("status") != "failed") | (F.col("attempts") >= retries)).select(F.col("law_id").alias("id"))
    some = articles.select(F.col("law_id").alias("id")).distinct()
    left = laws.join(done, "id", "left_anti").join(some, "id", "left_semi").orderBy("id")
    return left.limit(n) if n is not None else left


def referencing(relations: DataFrame, articles: DataFrame, changed: DataFrame) -> DataFrame:
    """(law_id): other laws with relations to the changed ones (id)."""
    hit = law_edges(relations, articles).join(changed.select(F.col("id").alias("t")), "t", "left_semi").where("s <> t")
    return hit.select(F.col("s").alias("law_id")).distinct()


def rings(node_rows: DataFrame) -> DataFrame:
    """(level, radius) of the rings that hold nodes, from the inside.

    In legend order, other levels last: a ring is wide enough for its nodes'
    spacing and a gap away from the one before. A scan over the few levels.
    """
    place = F.array_position(F.array(*[F.lit(v) for v in [*LEVELS, NO_LEVEL]]), F.col("level")).cast("int")
    held = node_rows.groupBy("level").agg(F.count(F.lit(1)).alias("n")).select("level", "n", F.when(place > 0, place).otherwise(len(LEVELS) + 2).alias("ring"))
    ordered = held.agg(F.array_sort(F.collect_list(F.struct("ring", "level", "n"))).alias("rows"))
    radius = lambda before, n: F.greatest(before + F.lit(GAP), n * F.lit(SPACING / (2 * 3.141592653589793)))
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast("array<struct<level:string,radius:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        r = radius(acc["at"], x["n"])
        return F.struct(r.alias("at"), F.concat(acc["out"], F.array(F.struct(x["level"].alias("level"), r.alias("radius")))).alias("out"))

    return ordered.select(F.explode_outer(F.aggregate("rows", start, step)["out"]).alias("x")).where("x is not null").select("x.level", "x.radius")


#: Room between rings and between nodes of a ring.
GAP, SPACING = 60.0, 14.0


def layout(node_rows: DataFrame) -> DataFrame:
    """(id, x, y, r): a ring per level, in each ring by degree, with a fixed jitter."""
    degree = F.col("n_out") + F.col("n_in")
    in_ring = W.partitionBy("level")
    angle = (F.row_number().over(in_ring.orderBy(degree.desc(), "id")) - 1) / F.count(F.lit(1)).over(in_ring) * 2 * 3.141592653589793
    noise = F.sin(F.col("id") * 12.9898 + 78.233) * 43758.5453
    turn = angle + (noise - F.floor(noise)) * 0.1
    placed = node_rows.select("id", "level", turn.alias("turn"), (F.lit(2.6) + 0.9 * F.sqrt(degree)).alias("r")).join(F.broadcast(rings(node_rows)), "level")
    return placed.select("id", (F.col("radius") * F.cos("turn")).alias("x"), (F.col("radius") * F.sin("turn")).alias("y"), "r")


#: Zooms above which nodes of a degree are labelled, and the degree from which they always are.
LABEL_ZOOMS, ALWAYS_LABELLED = [(1.6, 8), (0.9, 20)], 45


def labelled(node_rows: DataFrame, zoom: float, level: str | None = None, every: bool = False, hovered: int | None = None) -> DataFrame:
    """Nodes whose label is shown: the larger the zoom, the smaller ones too; with ``every`` (a small board) all. A focus on a level leaves out the others, but for the hovered node."""
    degree = F.col("n_out") + F.col("n_in")
    least = next((n for above, n in LABEL_ZOOMS if zoom > above), ALWAYS_LABELLED)
    shown = F.lit(every) | (degree >= min(least, ALWAYS_LABELLED))
    if level is not None:
        shown &= F.col("level") == level
    return node_rows.where(shown | (F.col("id").eqNullSafe(hovered) if hovered is not None else F.lit(False)))


def nearest(places: DataFrame, x: float, y: float, within: float) -> DataFrame:
    """The node nearest to a point, if within a distance."""
    d = F.hypot(F.col("x") - x, F.col("y") - y)
    return places.withColumn("d", d).where(F.col("d") <= within).select(F.min_by("id", F.struct("d", "id")).alias("id")).where("id is not null")
