"""Mixing sources to target weights with a golden-ratio slot schedule over shuffled equal-token blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, quoted, sealed, stored, words

#: Cells into which the slots' cumulative range is dealt for the interval join.
CELLS = 4096
#: Slots ranked together; each source's counts per chunk are summed first.
CHUNK = 4096


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point, null last; together they get ``share`` of all words.

    ``epochs`` bounds how often a source is taken, ``block_words`` is the size of a block, whatever the corpus' size.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    epochs: int = 2
    block_words: int = 256


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """The place of a document in its source's shuffled order: equal for equal rows only, so null or repeated ids spread by their texts."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def unit_key(order_key: Column, source: Column) -> Column:
    return F.md5(F.concat(order_key, source.isNull().cast("string"), F.coalesce(source, F.lit(""))))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, order_key, copies): equal rows are one unit, counted with map-side combine."""
    rows = docs.select(docs["doc_id"], docs["source"], size_of(docs["text"]).alias("size"), shuffle_key(docs["doc_id"], docs["text"]).alias("order_key"))
    return stored(rows.groupBy("doc_id", "source", "size", "order_key").agg(F.count(F.lit(1)).alias("copies")), "units")


def source_plan(sized: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its words, target and slots. It has as many rows as there are sources.

    Targets share the budget by weight and stop at ``epochs`` times their
    source: with sources ordered by cap over weight, the level left for the
    others only rises while capped sources go by, so the final level is the
    largest of the levels met.
    """
    everything = W.orderBy(F.col("source").asc_nulls_last())
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("nth"))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy(F.lit(1))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in mix.weights]), (F.col("nth") % len(mix.weights) + 1).cast("int"))
    return (
        sized.groupBy("source")
        .agg(F.sum(F.col("size") * F.col("copies")).cast("long").alias("source_size"))
        .withColumn("nth", F.row_number().over(everything) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(mix.epochs) * F.col("source_size"))
        .withColumn("budget", F.lit(float(mix.share)) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("target", F.least(F.col("cap").cast("double"), F.max("level").over(whole) * F.col("weight")))
        .withColumn("block_words", F.lit(mix.block_words).cast("long"))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .withColumn("wanted", F.least(F.floor("target").cast("long"), F.col("cap").cast("long")))
        .withColumn("full_epochs", F.when(F.col("source_size") > 0, F.expr("wanted div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("wanted") - F.col("full_epochs") * F.col("source_size"))
        .withColumn("rest_blocks", F.ceil(F.col("rest") / F.col("block_words")).cast("long"))
        .withColumn("n_slots", F.col("full_epochs") * F.col("n_blocks") + F.col("rest_blocks"))
        .withColumn("first_slot", F.coalesce(F.sum("n_slots").over(everything.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        .drop("level", "cap")
    )


def golden_lattice(n: int) -> tuple[int, int]:
    """Consecutive Fibonacci numbers (f, g), g at least n: k -> k * f mod g visits each of 0..g-1 once, in golden-ratio order."""
    f, g = 1, 1
    while g < n:
        f, g = g, f + g
    return f, g


def schedule(plan: DataFrame) -> DataFrame:
    """Slots (slot, source, rank, epoch, block, words) in mixing order.

    Slot k's golden-ratio point k * f / g falls in one source's stretch of the
    cumulative slot counts; g a Fibonacci number makes the points a
    permutation, so each source gets exactly its slots, evenly spread. Points
    past the last stretch are no slots. The interval join goes by cells of the
    range, and ranks are sums over chunks of slots plus a rank within the
    chunk, so a source with a third of all slots is no hot key.
    """
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("n_slots"), F.lit(0)).alias("n")).first()["n"]
    f, g = golden_lattice(total)
    width = max(1, -(-total // CELLS))
    cells = plan.where("n_slots > 0").select(
        "source", "first_slot", "n_slots", "source_size", "block_words", "n_blocks", "full_epochs", "rest", "rest_blocks",
        F.explode(F.expr(f"sequence(first_slot div {width}, (first_slot + n_slots - 1) div {width})")).alias("cell"),
    )
    points = (
        spark.range(g if total else 0)
        .select(F.col("id").alias("slot"), F.expr(f"cast(cast(id as decimal(19, 0)) * {f} % {g} as long)").alias("point"))
        .where(F.col("point") < total)
        .withColumn("cell", F.expr(f"point div {width}"))
        .withColumn("chunk", F.expr(f"slot div {CHUNK}"))
    )
    placed = points.join(cells, "cell").where((F.col("point") >= F.col("first_slot")) & (F.col("point") < F.col("first_slot") + F.col("n_slots")))
    upto = W.partitionBy("first_slot").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = placed.groupBy("first_slot", "chunk").agg(F.count(F.lit(1)).alias("n")).select("first_slot", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("earlier"))
    rank = F.col("earlier") + F.row_number().over(W.partitionBy("first_slot", "chunk").orderBy("slot")) - 1
    full = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    last = (F.col("epoch") == F.col("full_epochs")) & (F.col("block") == F.col("rest_blocks") - 1)
    return (
        placed.join(chunks, ["first_slot", "chunk"])
        .withColumn("rank", rank)
        .withColumn("epoch", F.expr("rank div n_blocks"))
        .withColumn("block", F.expr("rank % n_blocks"))
        .withColumn("words", F.when(last, F.col("rest") - F.col("block") * F.col("block_words")).otherwise(full))
        .select("slot", "source", "rank", "epoch", "block", "words")
    )


def positions(rows: DataFrame) -> DataFrame:
    """Where each unit begins in its source's shuffled stream of words: sums over 4096 stretches of the order, then within one."""
    rows = rows.withColumn("stretch", F.substring("order_key", 1, 3)).withColumn("all", F.col("size") * F.col("copies"))
    upto = W.partitionBy("source").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy("source", "stretch").agg(F.sum("all").alias("n")).select(F.col("source").alias("s_source"), F.col("stretch").alias("s_stretch"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    within = W.partitionBy("source", "stretch").orderBy("order_key").rowsBetween(W.unboundedPreceding, -1)
    return (
        rows.withColumn("begin", F.coalesce(F.sum("all").over(within), F.lit(0)))
        .join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("stretch") == F.col("s_stretch")))
        .select("doc_id", "source", "size", "order_key", "copies", (F.col("begin") + F.col("offset")).cast("long").alias("begin"))
    )


def size_of(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: Copies of one unit that are spread together.
PORTION = 4096


def takes(docs: DataFrame, mix: Mix) -> DataFrame:
    """(doc_id, source, size, order_key, copy, source_size, target, slot, epoch, place, first_word, n_words).

    A row for every stretch of a document that a slot takes, and one without
    slot for a document whose blocks no slot names. ``place`` counts words in the
    source's stream, so slot and place order the mix.
    """
    rows = units(docs)
    plan = cut(source_plan(rows, mix))
    slots = stored(schedule(plan), "slots")
    facts = plan.select(F.col("source").alias("p_source"), "source_size", "target", F.col("block_words").alias("p_words"))
    placed = positions(rows).join(facts, F.col("source").eqNullSafe(F.col("p_source"))).drop("p_source")
    # few rows have copies; those of one row are dealt to tasks before they are written out
    portions = placed.withColumn("portion", F.explode(F.expr(f"sequence(0L, (copies - 1) div {PORTION})"))).repartition("order_key", "portion")
    single = portions.withColumn("copy", F.explode(F.expr(f"sequence(portion * {PORTION}, least(copies, (portion + 1) * {PORTION}) - 1)")))
    single = single.withColumn("begin", F.col("begin") + F.col("copy") * F.col("size")).drop("portion", "copies")
    spread = F.when(F.col("size") > 0, F.expr("sequence(begin div p_words, (begin + size - 1) div p_words)"))
    pieces = single.withColumn("piece", F.explode_outer(spread))
    named = slots.select(F.col("source").alias("s_source"), F.col("block").alias("s_block"), "slot", "epoch", "words")
    first = F.greatest(F.col("begin"), F.col("piece") * F.col("p_words"))
    n = F.least(F.col("begin") + F.col("size"), F.col("piece") * F.col("p_words") + F.col("words")) - first
    joined = pieces.join(named, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("piece") == F.col("s_block")), "left")
    return joined.select(
        "doc_id", "source", "size", "order_key", "copy", "source_size", "target", "slot", "epoch",
        first.alias("place"), (first - F.col("begin")).alias("first_word"), F.when(F.col("slot").isNotNull(), F.greatest(n, F.lit(0))).otherwise(0).cast("long").alias("n_words"),
    )


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """How many words the mix takes of each document: (doc_id, source, size, source_size, target, taken).

    Each row of ``docs`` gives one row. A source's documents stand in a
    shuffled stream (by a digest of doc_id and text) that is cut into equal
    blocks of words; slots of the schedule name blocks, ``rank`` counting
    through the stream again for each epoch, and the last slot of a source is
    cut to end on its target. A document's take is the sum of the stretches
    its blocks' slots take, at most ``epochs`` times its size. Null sources are
    a source of their own, null and blank texts have size 0 and take 0, null
    ids and repeated rows take places of their own, ties don't arise but
    between equal rows, texts of any length are spread over their blocks, extra
    columns are left out, an empty table gives an empty result. Reruns agree,
    since nothing depends on the order of rows.
    """
    found = takes(docs, mix).groupBy("doc_id", "source", "size", "order_key", "copy", "source_size", "target").agg(F.sum("n_words").cast("long").alias("taken"))
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


#: Copies of a unit that are looked up together.
STRIDE = 256


def mixed_stream(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: ``docs`` with text cut to one taken stretch a row, and slot, epoch, place and n_words.

    Sorted by slot and place the rows are the mixed sequence: a slot's rows are
    the stretches of one block, in order. White space goes with the word before
    it. Each stretch appears as often as the schedule takes it; documents of
    which nothing is taken have no row, so null and blank texts have none.
    Null ids and sources, repeated rows and long texts are treated as in
    ``mix_documents``. Other columns stay, whatever their names, each row's own:
    of rows with one doc_id, text and source that differ elsewhere, the order of
    the differences says which copy is whose. Columns of the four names are
    replaced.
    """
    made = ["slot", "epoch", "place", "n_words"]
    found = takes(docs, mix).where("n_words > 0").withColumn("unit", unit_key(F.col("order_key"), F.col("source")))
    lists = found.groupBy("unit", "copy").agg(F.collect_list(F.struct("slot", "epoch", "place", "first_word", "n_words")).alias("list"))
    kept = [c for c in docs.columns if c.lower() not in made]
    # plain columns of plain names: a struct of them would be pruned on its way through the generators
    held = {c: f"own_{i}" for i, c in enumerate(kept) if c != "text"}
    rows = docs.select(*[quoted(c).alias(n) for c, n in held.items()], F.col("text").alias("body"), unit_key(shuffle_key(F.col("doc_id"), F.col("text")), F.col("source")).alias("unit"))
    variants = rows.withColumn("variant", F.xxhash64(F.to_json(F.struct(*held.values())))).groupBy("unit", "variant")
    variants = variants.agg(F.count(F.lit(1)).alias("many"), *[F.first(c).alias(c) for c in (*held.values(), "body")])
    upto = W.partitionBy("unit").orderBy("variant").rowsBetween(W.unboundedPreceding, -1)
    variants = variants.withColumn("from_copy", F.coalesce(F.sum("many").over(upto), F.lit(0)))
    variants = variants.withColumn("stride", F.explode(F.expr(f"sequence(from_copy div {STRIDE}, (from_copy + many - 1) div {STRIDE})")))
    joined = variants.join(lists.withColumn("stride", F.expr(f"copy div {STRIDE}")), ["unit", "stride"]).where("copy >= from_copy and copy < from_copy + many")
    pieces = F.split(F.regexp_replace("body", r"^[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut_out = lambda x: F.struct(*[x[c].alias(c) for c in made], F.array_join(F.slice("pieces", (x["first_word"] + 1).cast("int"), x["n_words"].cast("int")), "").alias("stretch"))
    whole = joined.select(*held.values(), "list", pieces.alias("pieces"))
    taken = sealed(whole, "list", "pieces").select(*held.values(), F.explode_outer(F.transform("list", cut_out)).alias("x"))
    return taken.select(*[F.col("x.stretch").alias(c) if c == "text" else F.col(held[c]).alias(c) for c in kept], *[F.col("x")[c].alias(c) for c in made])
