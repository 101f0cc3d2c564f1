"""Filter interaction audit: what every order of a set of filters keeps, from one pass over the texts.

Each document gets a mask, a bit for each filter it fails. The masks are counted
per part, and a subset-zeta transform turns the counts into the survivors of
every subset of filters. A step of an order is then the difference between two
neighbouring subsets, so no order is ever run over the documents.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import words

#: What is counted of the documents of a mask.
MEASURES = ("documents", "good", "toxic")
#: Rows without a doc_id are dealt to so many keys where ids are joined.
SALTS = 64


def standard_filters(text: Column) -> dict[str, Column]:
    """The text filters by letter, true where a text fails: short, repetitive, capitals, symbols."""
    found = words(text)
    return {
        "A": F.size(found) < 200,
        "B": 100 * F.size(F.array_distinct(found)) < 50 * F.size(found),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with good and toxic; a document with several labels is either if one of them says so."""
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))
    known = known.select(F.col("doc_id").alias("labelled_id"), F.lit(0).alias("labelled_salt"), "good", "toxic")
    salted = docs.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.hash("digest"), F.lit(SALTS)) + 1).otherwise(0))
    joined = salted.join(known, (F.col("doc_id") == F.col("labelled_id")) & (F.col("salt") == F.col("labelled_salt")), "left")
    return joined.drop("labelled_id", "labelled_salt", "salt").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def mask_counts(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], copies: str | None = None) -> DataFrame:
    """(part, mask, documents, good, toxic): documents by the filters they fail, bit i for the i-th of ``filters``.

    ``docs`` has doc_id, part and text, on which the filters' columns are
    built. ``copies`` names one more filter, whose bit comes last: a text
    identical to that of any smaller doc_id, in any part. Copies are counted
    per text, part and label first, so a text that a third of the rows share
    is a few rows when its smallest doc_id is looked for.
    """
    mask = sum((failed.cast("int") * (1 << i) for i, failed in enumerate(filters.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.col("text"), 256)) if copies else F.lit(None).cast("binary")
    flagged = docs.select("doc_id", "part", mask.alias("mask"), digest.alias("digest"))
    labelled = _labelled(flagged, labels)
    kinds = ["digest", "part", "mask", "good", "toxic"]
    if copies:
        by_id = labelled.groupBy("doc_id", *kinds).agg(F.count(F.lit(1)).alias("n"))
        first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
        by_text = by_id.groupBy(*kinds).agg(
            F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless")
        )
        least = F.min("first.doc_id").over(W.partitionBy("digest"))
        held = by_text.withColumn("least", least)
        originals = F.col("n_nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
        bit = 1 << len(filters)
        sides = F.array(F.struct(F.col("mask").alias("mask"), originals.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - originals).alias("n")))
        counted = held.select("part", "good", "toxic", F.inline(sides))
    else:
        counted = labelled.withColumn("n", F.lit(1))
    return counted.groupBy("part", "mask").agg(
        F.sum("n").alias("documents"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")
    )


def survivors(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, documents, good, toxic): per part, arrays over all subsets of filters of what passes all filters of the subset.

    Element s + 1 belongs to the subset with bits s. A document survives s if
    its mask lies within the complement of s, so the arrays are the zeta
    transform of the counts, read backwards: for each bit in turn, sets with
    the bit add what the set without it has. There are 2 ** n_filters subsets,
    so a part is one row of that length, whatever its documents.
    """
    size = 1 << n_filters
    places = F.sequence(F.lit(0), F.lit(size - 1))
    cells = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES)))).alias("cells"))

    def cell(m: str) -> Column:
        return F.transform(places, lambda s: F.coalesce(F.col("cells")[s][m], F.lit(0).cast("long"))).alias(m)

    def added(m: str, bit: int) -> Column:
        return F.transform(F.col(m), lambda x, s: x + F.when(s.bitwiseAND(bit) > 0, F.get(F.col(m), s - bit)).otherwise(0)).alias(m)

    # each round behind an array of one struct, or it would be copied into the next one's lambda
    cells = cells.select("part", F.inline_outer(F.array(F.struct(*map(cell, MEASURES)))))
    for i in range(n_filters):
        cells = cells.select("part", F.inline_outer(F.array(F.struct(*[added(m, 1 << i) for m in MEASURES]))))
    return cells.select("part", *[F.reverse(m).alias(m) for m in MEASURES])


def order_steps(survived: DataFrame, names: str) -> DataFrame:
    """Every step of every order of the filters, zeros included, per part.

    kept and removed are of the step, redundant fail its filter but went
    earlier, unique_fails fail no other filter, good_lost and toxic_lost are the
    labelled ones among removed, shapley is what its filter removes, summed over
    all orders. The orders are a list of len(names)! words.
    """
    n, whole = len(names), (1 << len(names)) - 1
    bit_of = F.create_map(*[F.lit(x) for i, c in enumerate(names) for x in (c, 1 << i)])
    orders = F.array(*[F.lit("".join(p)) for p in itertools.permutations(names)])
    steps = survived.withColumn("filter_order", F.explode(orders)).select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    letters = F.transform(F.split(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1), ""), lambda c: F.coalesce(bit_of[c], F.lit(0)))
    steps = steps.withColumn("before", F.aggregate(letters, F.lit(0), lambda a, b: a + b)).withColumn("bit", bit_of[F.substring(F.col("filter_order"), F.col("step"), F.lit(1))])

    def of(measure: str, subset: Column) -> Column:
        return F.get(F.col(measure), subset)

    def lost(measure: str, subset: Column) -> Column:
        return of(measure, subset) - of(measure, subset + F.col("bit"))

    shares = [math.factorial(s.bit_count()) * math.factorial(n - 1 - s.bit_count()) if s != whole else 0 for s in range(whole + 1)]
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(whole)),
        F.lit(0).cast("long"),
        lambda total, s: total + F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(F.array(*map(F.lit, shares)), s) * lost("documents", s)).otherwise(0),
    )
    removed = lost("documents", F.col("before"))
    return steps.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        of("documents", F.col("before") + F.col("bit")).alias("kept"),
        removed.alias("removed"),
        (lost("documents", F.lit(0)) - removed).alias("redundant"),
        lost("documents", F.lit(whole) - F.col("bit")).alias("unique_fails"),
        lost("good", F.col("before")).alias("good_lost"),
        lost("toxic", F.col("before")).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """The steps of all orders of the four text filters and E, copies of a smaller doc_id's text, per value of ``part``.

    Null texts count as empty, null parts as the empty string. A null doc_id
    has no label, is no copy and makes none. Repeated rows count as often as
    they occur; rows with the smallest doc_id of their text are no copies,
    however many. Long texts are read whole. Further columns of ``docs`` are
    not read, whatever their names; without documents there are no parts and
    no rows.
    """
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    filters = standard_filters(F.col("text"))
    counts = mask_counts(named, labels, filters, copies="E")
    return order_steps(survivors(counts, len(filters) + 1), "".join(filters) + "E")
