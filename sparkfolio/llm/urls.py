"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the equi-join uses; the full digest confirms.
SHORT = 8


def url_host(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.when(F.octet_length(host) == F.length(host), F.lower(host)).otherwise(
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their digests.

    Null hosts or paths count as empty, an empty host is dropped (it names no
    site), verdicts other than allow count as block, and where one host and
    path has both verdicts, block stands.
    """
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    return (
        rules.select(host.alias("rule_host"), path.alias("rule_path"), F.when(F.col("verdict") == "allow", "allow").otherwise("block").alias("rule_verdict"))
        .where("rule_host <> ''")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("rule_digest", digest(F.concat_ws("\n", "rule_host", "rule_path")))
        .withColumn("short", F.substring("rule_digest", 1, SHORT))
    )


def expressions(urls: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """One row per host suffix and path prefix of each URL that some rule could name.

    ``labels`` and ``lengths`` are the distinct label counts and path lengths
    of the rules, so a URL makes at most their product of expressions however
    long it is.
    """
    suffix = lambda n: F.substring_index("host", ".", -n)
    n_labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    suffixes = F.array_compact(F.array(*[F.when((n_labels >= n) & (F.col("host") != ""), suffix(n)) for n in labels]))
    prefixes = F.array_compact(F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in lengths]))
    return (
        urls.select("*", F.explode(suffixes).alias("suffix"))
        .select("*", F.explode(prefixes).alias("prefix"))
        .withColumn("digest", digest(F.concat_ws("\n", "suffix", "prefix")))
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's path. The longest rule (host and path together, then the longer
    host) wins; without one the verdict is ``default`` and the rule null. Each
    distinct URL is judged once, so repeated URLs cost one lookup, and repeated
    rows, null ids and extra columns stay as they are. A null or empty URL has an
    empty host and path and fits no rule; a long one makes no more expressions
    than the rules have shapes. Of rules that tie in length and host, block
    stands. Columns of ``pages`` named host, path, rule or verdict are
    replaced. No rules: all get ``default``; no pages: no rows.
    """
    prepared = prepare_rules(rules)
    shape = prepared.agg(
        F.collect_set(F.length("rule_host") - F.length(F.replace(F.col("rule_host"), F.lit("."))) + 1).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
    ).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*kept)
    urls = pages.select(F.col(url).alias("judged_url")).distinct().withColumns({"host": url_host(F.col("judged_url")), "path": url_path(F.col("judged_url"))})
    if shape["labels"]:
        fits = (
            expressions(urls, sorted(shape["labels"]), sorted(shape["lengths"]))
            .join(prepared, "short")
            .where(F.col("digest") == F.col("rule_digest"))
            .groupBy("judged_url", "host", "path")
            .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))).alias("best"))
            .select("judged_url", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict"))
        )
    else:
        fits = urls.where("false").select("judged_url", F.lit("").alias("rule"), F.lit("").alias("verdict"))
    joined = pages.join(fits, pages[url].eqNullSafe(fits["judged_url"]), "left")
    return joined.select(
        *[pages[c] for c in kept],
        url_host(pages[url]).alias("host"),
        url_path(pages[url]).alias("path"),
        "rule",
        F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )
