"""Columns of any name, and every selection of the mix's columns."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import decontaminate, mixing, pii, simhash


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text {i} " + "word " * (i % 9), "en", "hot" if i % 3 else None) for i in range(60)]
    rows += [(7, "same text again", lang, "hot") for lang in ("de", "en", "fr", "fr", None)] + [(8, None, "en", "hot")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "concat('d', doc_id, lang) AS `a.b`", "map('k', lang) AS `m``m`", "1 AS Slot")


def test_the_mix_survives_every_selection(spark, docs):
    mixed = mixing.mixed_stream(docs, mixing.Mix(block_words=8))
    every = mixed.collect()
    assert mixed.columns == ["doc_id", "text", "lang", "source", "a.b", "m`m", "slot", "epoch", "place", "n_words"]
    for some in (["doc_id"], ["lang"], ["text", "n_words"], ["doc_id", "lang", "text", "n_words"], ["slot", "a.b"], ["place"]):
        got = mixed.select(*[f"`{c}`" for c in some]).collect()
        assert Counter(map(tuple, got)) == Counter(tuple(r[c] for c in some) for r in every)
    assert all(r["a.b"] == (None if r["lang"] is None else f"d{r['doc_id']}{r['lang']}") for r in every)


def test_rows_that_differ_elsewhere_keep_their_own_columns(spark, docs):
    mix = mixing.Mix(block_words=8, share=2.0, weights=(1,))
    own = lambda rows: Counter((r["lang"], r["n_words"]) for r in rows if r["doc_id"] == 7 and "again" in r["text"] or r["text"].startswith("same"))
    first = mixing.mixed_stream(docs, mix).collect()
    words = Counter()
    for r in first:
        if r["doc_id"] == 7 and r["source"] == "hot" and set(r["text"].split()) <= {"same", "text", "again"}:
            words[r["lang"]] += r["n_words"]
    assert words == {"de": 6, "en": 6, "fr": 12, None: 6}
    assert own(first) == own(mixing.mixed_stream(docs.repartition(5), mix).collect())


def test_many_copies_are_looked_up_in_strides(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STRIDE", 2)
    rows = [(1, "a b c", lang, "s") for lang in ["x"] * 5 + ["y"] * 4 + ["z"]]
    mixed = mixing.mixed_stream(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), mixing.Mix(block_words=4, share=2.0, weights=(1,))).collect()
    words = Counter()
    for r in mixed:
        words[r["lang"]] += r["n_words"]
    assert words == {"x": 30, "y": 24, "z": 6}


def test_stages_keep_columns_with_dots(spark, docs):
    items = spark.createDataFrame([(1, "text 5 word word word word word")], "item_id long, text string")
    names = docs.columns
    assert decontaminate.clean_documents(docs, items, window=5).columns == names
    assert sorted(r["a.b"] or "" for r in pii.sanitise(docs).collect()) == sorted(r["a.b"] or "" for r in docs.collect())
    plain = docs.drop("m`m").where(F.col("doc_id") < 30)
    assert {r["a.b"] for r in simhash.keep_one(plain).collect()} <= {r["a.b"] for r in plain.collect()}
