"""The word and trigram index as immutable segments of stored tables.

A segment holds the postings of the units that one refresh cut, those units with
their lengths, and the ids that it replaces or takes away. A version is a list
of segments, oldest first; what a later segment names no longer counts in an
earlier one. Small segments are merged as they come, each several times smaller
than the one before, so a refresh writes in proportion to what changed and a
query reads a few segments. Nothing that was written is changed, so readers of
an older version are undisturbed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..functions import text as X
from ..sources import files
from . import grams, retrieval

#: A segment is merged with the later ones unless it has so many times their units.
FACTOR = 4
TABLES = {"postings": "term string, id long, tf long, dl long", "grams": grams.SCHEMA, "units": "id long, dl long, grams long", "gone": "id long"}
#: Characters of texts whose postings make one range at most, in the mean: what a task sorts doesn't grow with the texts.
RANGE_CHARS = 8_000_000
#: Columns by whose ranges a table's files are sorted; the id splits what has one term.
RANGES = {"postings": ("term", "id"), "grams": ("gram", "id"), "units": ("id",), "gone": ("id",)}


def versions(spark: SparkSession, root: str) -> list[str]:
    """Complete versions under a root, oldest first."""
    fs, p = files._fs(spark, f"{root}/versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def segments(spark: SparkSession, root: str, version: str | None = None) -> list[tuple[str, int]]:
    """(name, units and gone ids) of a version's segments, oldest first; of the newest version by default."""
    held = versions(spark, root)
    return _named(spark, f"{root}/versions/{version or held[-1]}") if held else []


_SEEN: dict[str, list[tuple[str, int]]] = {}


def _named(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """A version's list; what was read once isn't read again, as versions don't change."""
    key = _stamped(spark, path)
    if key not in _SEEN:
        rows = spark.read.schema("nth int, name string, size long").parquet(path).orderBy("nth").collect()
        if len(_SEEN) > 1000:
            _SEEN.clear()
        _SEEN[key] = [(r["name"], r["size"]) for r in rows]
    return list(_SEEN[key])


def _stamped(spark: SparkSession, path: str) -> str:
    """A version's path with its time, so that a root made anew isn't taken for the old one."""
    fs, p = files._fs(spark, path)
    return f"{path}@{fs.getFileStatus(p).getModificationTime()}"


def _publish(spark: SparkSession, root: str, named: list[tuple[str, int]], number: int) -> bool:
    """A version appears as a whole, unless another job made that number first."""
    made = f"{root}/made/{uuid.uuid4().hex}"
    rows = [(i, name, size) for i, (name, size) in enumerate(named)]
    spark.createDataFrame(rows, "nth int, name string, size long").coalesce(1).write.parquet(made)
    fs, source = files._fs(spark, made)
    target = files._fs(spark, f"{root}/versions/{number:06d}")[1]
    fs.mkdirs(target.getParent())
    if not fs.exists(target) and fs.rename(source, target):
        return True
    fs.delete(source, True)
    return False


def _ranges(spark: SparkSession, chars: int | None) -> int | None:
    """Ranges for the postings of so many characters; none where Spark's own number is enough."""
    n = -(-(chars or 0) // RANGE_CHARS)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def _write(tables: dict[str, DataFrame], root: str, ranged: tuple[str, ...] = (), ranges: int | None = None) -> tuple[str, int]:
    """A new segment: each table in files of ranges, so that a query's terms are met in few row groups; the ``ranged`` ones are in ranges already, other postings are dealt to ``ranges``."""
    name = uuid.uuid4().hex
    spark = next(iter(tables.values())).sparkSession
    for t, df in tables.items():
        rows = df.select(*[c.split(" ")[0] for c in TABLES[t].split(", ")])
        rows = rows if t in ranged else rows.repartitionByRange(*([ranges] if ranges and t in KINDS else []), *RANGES[t])
        rows.sortWithinPartitions(*RANGES[t]).write.option("compression", "zstd").parquet(f"{root}/segments/{name}/{t}")
    return name, sum(_table(spark, root, name, t).count() for t in ("units", "gone"))


def _table(spark: SparkSession, root: str, name: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{root}/segments/{name}/{table}")


def _live(spark: SparkSession, root: str, named: list[tuple[str, int]], table: str) -> DataFrame:
    """A table's rows over segments, without what later ones replace. The ids that later segments name are few beside an earlier one."""
    out, later = None, None
    for name, _ in reversed(named):
        rows = _table(spark, root, name, table)
        if later is not None:
            rows = rows.join(later, "id", "left_anti").select(*rows.columns)
        out = rows if out is None else rows.unionByName(out)
        ids = _table(spark, root, name, "units").select("id").union(_table(spark, root, name, "gone"))
        later = ids if later is None else later.union(ids)
    return out if out is not None else spark.createDataFrame([], TABLES[table])


def _stats(spark: SparkSession, root: str, version: str) -> tuple:
    """(units, mean words, mean grams) of a version, counted when first asked for."""
    key = _stamped(spark, f"{root}/versions/{version}")
    if key not in _COUNTED:
        if len(_COUNTED) > 1000:
            _COUNTED.clear()
        units = _live(spark, root, segments(spark, root, version), "units")
        _COUNTED[key] = tuple(units.agg(F.count(F.lit(1)), F.avg("dl"), F.avg("grams")).first())
    return _COUNTED[key]


_COUNTED: dict[str, tuple] = {}


def _one_row(spark: SparkSession, n: int, avgdl: float | None) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (:n, :avgdl) AS t(n, avgdl)", args={"n": n, "avgdl": avgdl})


def read(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of a version, the newest by default."""
    version = version or versions(spark, root)[-1]
    n, avgdl, _ = _stats(spark, root, version)
    return _live(spark, root, segments(spark, root, version), "postings"), _one_row(spark, n, avgdl)


def read_grams(spark: SparkSession, root: str, version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(trigram postings, their statistics) of a version, the newest by default."""
    version = version or versions(spark, root)[-1]
    n, _, avgdl = _stats(spark, root, version)
    return _live(spark, root, segments(spark, root, version), "grams"), _one_row(spark, n, avgdl)


def read_units(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """(id, dl, grams) of the units that a version covers, the newest by default."""
    return _live(spark, root, segments(spark, root, version), "units")


def lengths(units: DataFrame, tokens=X.tokens) -> DataFrame:
    dl = segment.words_of(units, tokens).select("id", F.size("w").cast("long").alias("dl"))
    return units.select("id", grams.size(F.col("text")).alias("grams")).join(dl, "id")


#: What an index can hold: words, trigrams, or both.
KINDS = ("postings", "grams")


def _segment(units: DataFrame, gone: DataFrame, tokens, kinds: tuple[str, ...], root: str) -> tuple[str, int]:
    """A new segment of ``units``, in ranges by the length of their texts."""
    ranges = _ranges(units.sparkSession, units.agg(F.sum(F.length("text"))).first()[0])
    return _write(_cut(units, gone, tokens, kinds, ranges), root, ("postings",), ranges)


def _cut(units: DataFrame, gone: DataFrame, tokens, kinds: tuple[str, ...], ranges: int | None = None) -> dict[str, DataFrame]:
    make = {"postings": lambda: retrieval.postings(units, tokens, ranged=True, ranges=ranges), "grams": lambda: grams.postings(units)}
    own = lengths(units, tokens) if "postings" in kinds else units.select("id", F.lit(None).cast("long").alias("dl"), grams.size(F.col("text")).alias("grams"))
    return {**{k: make[k]() for k in kinds}, "units": own, "gone": gone.select("id")}


def refresh(units: DataFrame, root: str, changed: DataFrame | None = None, tokens=X.tokens, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) that cover ``units`` (id, text), ids all different; of trigrams if ``kinds``, the same at every call, has no words.

    Units that the newest version lacks, and the ``changed`` ones (id), are cut
    into a new segment, which takes away those that are gone; if nothing
    differs, nothing is written. A version belongs to one way of cutting:
    another dictionary needs another root.
    """
    spark, found = units.sparkSession, read if "postings" in kinds else read_grams
    held = versions(spark, root)
    number = int(held[-1]) + 1 if held else 0
    named = segments(spark, root)
    if not named:
        _publish(spark, root, [_segment(units, units.where("false"), tokens, kinds, root)], number)
        return found(spark, root)
    seen, ids = _live(spark, root, named, "units").select("id"), units.select("id")
    gone, fresh = seen.join(ids, "id", "left_anti"), retrieval.missing_from_index(ids, seen)
    if changed is not None:
        fresh = fresh.union(ids.join(changed.select("id"), "id", "left_semi")).distinct()
    if gone.isEmpty() and fresh.isEmpty():
        return found(spark, root)
    named.append(_segment(units.join(fresh, "id", "left_semi"), gone, tokens, kinds, root))
    _publish(spark, root, merged(spark, root, named, kinds), number)
    return found(spark, root)


def merged(spark: SparkSession, root: str, named: list[tuple[str, int]], kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int]]:
    """The segments after those at the end that are too much alike in size became one."""
    at, size = len(named) - 1, named[-1][1]
    while at > 0 and named[at - 1][1] < FACTOR * size:
        at -= 1
        size += named[at][1]
    if at == len(named) - 1:
        return named
    some = named[at:]
    tables = {t: _live(spark, root, some, t) for t in (*kinds, "units")}
    # what the merged ones replace in earlier segments stays named
    ids = None
    for name, _ in some:
        own = _table(spark, root, name, "gone").union(_table(spark, root, name, "units").select("id"))
        ids = own if ids is None else ids.union(own)
    earlier = ids.distinct().join(tables["units"].select("id"), "id", "left_anti") if at else ids.where("false")
    ranges = _ranges(spark, tables["units"].agg(F.sum("grams")).first()[0])
    return [*named[:at], _write({**tables, "gone": earlier}, root, ranges=ranges)]


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete all but the newest versions and what only they named; returns the segments that went."""
    held = versions(spark, root)
    needed = {name for v in held[-max(1, keep) :] for name, _ in segments(spark, root, v)}
    fs, p = files._fs(spark, f"{root}/segments")
    old = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    for v in held[: -max(1, keep)]:
        fs.delete(files._fs(spark, f"{root}/versions/{v}")[1], True)
    went = [n for n in old if n not in needed]
    for n in went:
        fs.delete(files._fs(spark, f"{root}/segments/{n}")[1], True)
    return went
