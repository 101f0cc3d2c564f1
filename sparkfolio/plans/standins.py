"""The tables that stand in for the stored ones: role by role, with the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of one document are numbered below this.
LINES = 1_000_000

LAWS_SQL = """laws AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS title, lang AS level, source AS source_name, text AS full_text, sha256(text) AS content_hash,
    CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) < doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of,
    CAST(NULL AS BIGINT) AS superseded_by, CASE WHEN length(text) < 200 THEN 'empty_text' END AS quality_flag
  FROM documents)"""
ACTIVE_SQL = "duplicate_of IS NULL AND superseded_by IS NULL AND (quality_flag IS NULL OR quality_flag NOT IN ('duplicate', 'empty_text'))"
ARTICLES_SQL = f"""articles AS (
  SELECT doc_id * {LINES} + i - 1 AS id, doc_id AS law_id, '第' || i || '条' AS article_no, CAST(i - 1 AS BIGINT) AS pos, lines[i] AS text
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)))"""
RELATIONS_SQL = """relations AS (
  SELECT c_nationkey AS s, s_nationkey AS t, l_returnflag AS rel_type
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


TRADE_SQL = """ends AS (SELECT c_custkey * 2 AS id, c_nationkey AS law_id, c_name AS article_no FROM customer UNION ALL SELECT s_suppkey * 2 + 1, s_nationkey, s_name FROM supplier),
links AS (SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey * 2 AS from_id, l_suppkey * 2 + 1 AS to_id, l_returnflag AS rel_type, l_linestatus AS note FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (SELECT links.*, a.law_id AS s, b.law_id AS t FROM links JOIN ends a ON a.id = from_id JOIN ends b ON b.id = to_id)"""
#: Titles made of part names: as they are, with source and version, with a version, with white space around.
TITLED_SQL = """titled AS (SELECT p_partkey AS id, p_name, p_type, p_size, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN '【甲站】《' || p_name || '》（2023年修订）' WHEN 2 THEN p_name || '(2018年修正)' ELSE '  ' || p_name || '　' END AS title,
  CASE p_partkey % 3 WHEN 0 THEN '中国人大网' WHEN 1 THEN '中国证监会' ELSE 'other' END AS source_name, CASE WHEN p_size < 10 THEN '已废止' ELSE '现行有效' END AS status FROM part)"""
#: One law for each part name, half of them with the country's name in front; each has twenty articles.
NAMED_SQL = """named AS (SELECT id, p_name, CASE WHEN id % 2 = 0 THEN '中华人民共和国' || p_name ELSE p_name END AS title FROM (SELECT min(p_partkey) AS id, p_name FROM part GROUP BY p_name)),
numbered AS (SELECT id * 100 + n AS id, id AS law_id, n FROM named, (SELECT unnest(range(1, 21)) AS n))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents: the first line as title, language as level; a later copy of a text is a duplicate of the first, short texts are flagged."""
    docs = table(spark, sf_dir, "documents")
    x = docs.select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("lang").alias("level"),
        F.col("source").alias("source_name"),
        F.col("text").alias("full_text"),
        F.sha2("text", 256).alias("content_hash"),
        F.lit(None).cast("bigint").alias("superseded_by"),
        F.when(F.length("text") < 200, "empty_text").alias("quality_flag"),
    )
    first = docs.groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return x.join(first, F.col("content_hash") == F.col("h"), "left").withColumn("duplicate_of", F.when(F.col("first_id") < F.col("id"), F.col("first_id"))).drop("h", "first_id")


def slim_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return laws(spark, sf_dir).drop("full_text")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents, numbered in plain digits; ids keep their order."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("law_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return rows.select((F.col("law_id") * LINES + F.col("pos")).alias("id"), "law_id", F.concat(F.lit("第"), (F.col("pos") + 1).cast("string"), F.lit("条")).alias("article_no"), F.col("pos").cast("long").alias("pos"), "text")


def trade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(laws, articles, relations): nations are laws, their customers and suppliers articles, line items relations from customer to supplier."""
    t = lambda n: table(spark, sf_dir, n)
    none = F.lit(None).cast("bigint")
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    flags = {"status": F.lit("现行有效"), "duplicate_of": none, "superseded_by": none, "quality_flag": F.lit(None).cast("string")}
    laws_ = nations.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("title"), F.col("r_name").alias("level")).withColumns(flags)
    buyers = t("customer").select((F.col("c_custkey") * 2).alias("id"), F.col("c_nationkey").alias("law_id"), F.col("c_name").alias("article_no"))
    sellers = t("supplier").select((F.col("s_suppkey") * 2 + 1).alias("id"), F.col("s_nationkey").alias("law_id"), F.col("s_name").alias("article_no"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    relations = lines.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("o_custkey") * 2).alias("from_id"), (F.col("l_suppkey") * 2 + 1).alias("to_id"),
        F.col("l_returnflag").alias("rel_type"), F.col("l_linestatus").alias("note"),
    )
    return laws_, buyers.unionByName(sellers), relations


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TITLED_SQL as a DataFrame, with the columns of laws that governance reads."""
    name, k = F.col("p_name"), F.col("p_partkey")
    title = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(F.lit("【甲站】《"), name, F.lit("》（2023年修订）"))).when(k % 4 == 2, F.concat(name, F.lit("(2018年修正)"))).otherwise(F.concat(F.lit("  "), name, F.lit("　")))
    none = F.lit(None).cast("bigint")
    return table(spark, sf_dir, "part").select(
        k.alias("id"), "p_name", "p_type", "p_size", title.alias("title"),
        F.when(k % 3 == 0, "中国人大网").when(k % 3 == 1, "中国证监会").otherwise("other").alias("source_name"),
        F.when(F.col("p_size") < 10, "已废止").otherwise("现行有效").alias("status"),
        F.col("p_type").alias("full_text"), F.sha2("p_type", 256).alias("content_hash"), none.alias("duplicate_of"), none.alias("superseded_by"), F.lit(None).cast("string").alias("quality_flag"),
    )


def named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(laws, articles) of NAMED_SQL; odd articles are numbered in digits, even ones in numerals."""
    from ..functions.numerals import to_chinese

    none = F.lit(None).cast("bigint")
    x = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    laws_ = x.select("id", "p_name", F.when(F.col("id") % 2 == 0, F.concat(F.lit("中华人民共和国"), "p_name")).otherwise(F.col("p_name")).alias("title"), none.alias("duplicate_of"), none.alias("superseded_by"), F.lit(None).cast("string").alias("quality_flag"))
    spread = laws_.select(F.col("id").alias("law_id"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("n"))
    said = F.when(F.col("n") % 2 == 1, F.col("n").cast("string")).otherwise(to_chinese(F.col("n")))
    return laws_, spread.select((F.col("law_id") * 100 + F.col("n")).alias("id"), "law_id", F.concat(F.lit("第"), said, F.lit("条")).alias("article_no"), F.lit("").alias("text"))


def nation_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, t, rel_type) from a customer's nation to a supplier's for every line item: the small tables are joined by Spark's choice."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_suppkey", F.col("l_returnflag").alias("rel_type"))
    buyers = t("orders").select("o_orderkey", "o_custkey").join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    sellers = t("supplier").select("s_suppkey", "s_nationkey")
    return lines.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("c_nationkey").alias("s"), F.col("s_nationkey").alias("t"), "rel_type")
