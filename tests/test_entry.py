"""The driver's contract."""

import __spark_entry__
from sparkfolio.functions import numerals as N
from sparkfolio.plans import catalogue


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.queries()) <= set(__spark_entry__.queries())


def test_numerals_there_and_back(spark):
    numbers = spark.range(0, 10001).selectExpr("cast(id as int) as n")
    odd = numbers.select("n", N.to_chinese(numbers["n"]).alias("said")).select("n", "said", N.to_int("said").alias("back"))
    assert odd.where("n between 1 and 9999 and (back is null or back <> n)").count() == 0
    assert [r["said"] for r in odd.where("n in (0, 10000)").collect()] == [None, None]
    said = {r["n"]: r["said"] for r in odd.where("n in (10, 19, 101, 110, 1001, 1010, 9999)").collect()}
    assert said == {10: "十", 19: "十九", 101: "一百零一", 110: "一百一十", 1001: "一千零一", 1010: "一千零一十", 9999: "九千九百九十九"}


def test_first_citation_of_a_query(spark):
    asked = spark.createDataFrame([(1, "《证券法》第50条怎么说"), (2, "内幕交易"), (3, None)], "id int, q string")
    found = {r["id"]: r["c"] for r in asked.select("id", N.parse_citation(asked["q"]).alias("c")).collect()}
    assert (found[1]["title"], found[1]["article_no"]) == ("证券法", "第五十条") and found[2] is None and found[3] is None
