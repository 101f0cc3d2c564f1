"""Which laws a query may see, and the filters that users set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(alias: str | None, name: str) -> Column:
    return F.col(f"{alias}.{name}" if alias else name)


def edge_ok(alias: str | None = None) -> Column:
    """Neither a duplicate nor superseded, whatever its quality."""
    return _c(alias, "duplicate_of").isNull() & _c(alias, "superseded_by").isNull()


def indexable(alias: str | None = None) -> Column:
    """What word index, graph nodes and citations see: all but empty texts."""
    flag = _c(alias, "quality_flag")
    return edge_ok(alias) & (flag.isNull() | (flag != "empty_text"))


def active(alias: str | None = None) -> Column:
    """What search, statistics and catalogue see."""
    flag = _c(alias, "quality_flag")
    return edge_ok(alias) & (flag.isNull() | ~flag.isin("duplicate", "empty_text"))


def contains_ci(text: Column, part: Column | str) -> Column:
    """Case-insensitive substring; no character of ``part`` is a wildcard."""
    return F.contains(F.lower(text), F.lower(F.lit(part) if isinstance(part, str) else part))


def like_ci(text: Column, pattern: str) -> Column:
    """Case-insensitive LIKE: ``%`` and ``_`` in the pattern are wildcards and nothing escapes them."""
    return F.lower(text).like(pattern.lower().replace("\\", "\\\\"))


def topics(tags: Column) -> Column:
    """The tags of a comma-separated list; white space goes, full-width commas count."""
    plain = F.translate(F.coalesce(tags, F.lit("")), "， \t\n\r　", ",")
    return F.array_distinct(F.array_remove(F.split(plain, ","), ""))


def has_topic(tags: Column, topic: str | None) -> Column:
    """Law has the topic; a blank one, if given, fits none."""
    if topic is None:
        return F.lit(True)
    wanted = topic.replace("，", ",").translate({ord(c): None for c in " \t\n\r　"})
    return F.array_contains(topics(tags), wanted) if wanted else F.lit(False)


def has_offline_topic(tags: Column, topic: str) -> Column:
    """The offline reader's test: lists split at commas and semicolons of either width, tags trimmed and compared without case."""
    tag_list = F.transform(F.split(F.coalesce(tags, F.lit("")), "[,，;；]"), lambda x: F.lower(F.btrim(x)))
    return F.array_contains(tag_list, topic.strip().lower())


def law_filters(level: str | None = None, status: str | None = None, source_name: str | None = None, law_id: int | None = None, topic: str | None = None, alias: str | None = None) -> Column:
    """All filters that are set; null or empty sets none, but for a blank topic."""
    tests = [_c(alias, n) == v for n, v in (("level", level), ("status", status), ("source_name", source_name)) if v]
    if law_id is not None:
        tests.append(_c(alias, "id") == law_id)
    if topic is not None:
        tests.append(has_topic(_c(alias, "topic_tags"), topic))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def all_terms(text: Column, terms: Column) -> Column:
    """Every term occurs, whatever its case."""
    return F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
