"""The segmenter, the trigram and word index and search, against brute force and whole rebuilds."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio.functions import segment
from sparkfolio.operators import grams, index, retrieval

COUNTS = {"证券": 50, "证券法": 20, "交易": 60, "证券交易所": 9, "所": 5, "内幕交易": 3, "券交": 1, "法": 200, "中华人民共和国证券法": 10_000, "人民": 80, "共和国": 7}


def all_paths(known, run):
    """Every way of writing a run as words and single characters."""
    if not run:
        return [[]]
    return [[run[:n], *rest] for n in range(1, len(run) + 1) if n == 1 or run[:n] in known for rest in all_paths(known, run[n:])]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="证券法交易所内幕中华人民共和国的", min_size=1, max_size=10))
def test_the_path_is_the_most_probable_of_all(run):
    words, total = segment.Words(COUNTS), sum(COUNTS.values())
    worth = lambda path: sum(math.log(COUNTS.get(w, 1) / total) for w in path)
    assert math.isclose(worth(words.path(run)), max(map(worth, all_paths(COUNTS, run))), rel_tol=1e-12)
    assert "".join(words.path(run)) == run


def test_long_words_give_inner_words_and_strays_give_pairs():
    words = segment.Words(COUNTS)
    assert words.cut("证券法") == ["证券", "证券法"]
    assert words.cut("内幕交易") == ["内幕", "幕交", "交易", "内幕交易"]
    assert words.cut("中华人民共和国证券法 ABC第9条ipo2023年") == [
        "中华", "华人", "人民", "共和国", "证券", "证券法", "中华人民共和国证券法", "ABC", "第", "9", "条", "ipo2023", "年",
    ]
    assert words.cut("投资者，买") == ["投资", "资者", "买"] and words.cut("，。 ") == []


@pytest.fixture(scope="module")
def terms(spark):
    vocabulary = spark.createDataFrame([(t, n) for t, n in COUNTS.items() if n < 10_000], "term string, n long")
    titles = spark.createDataFrame([("《中华人民共和国证券法》",), (" 期货 ",), ("期",), ("长" * 21,), (None,)], "title string")
    return segment.dictionary(spark, titles, vocabulary)


def test_dictionary_holds_terms_and_titles_of_fit_length(terms):
    held = {r["term"]: r["n"] for r in terms.collect()}
    assert held["中华人民共和国证券法"] == 10_000 and held["期货"] == 10_000 and held["内幕交易"] == 3 and held["短线交易"] == 1
    assert "期" not in held and "长" * 21 not in held and None not in held


def test_joined_dictionary_cuts_as_the_shipped_one(spark, terms):
    rng = random.Random(1)
    texts = ["".join(rng.choice("证券法交易所内幕中华人民共和国的 a9，") for _ in range(rng.randrange(40))) for _ in range(150)] + [None, "", "only latin TEXT", "期", "法"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    small, large = segment.Segmenter(terms), segment.Segmenter(terms, most=3)
    assert small.small is not None and large.small is None
    for inner in (True, False):
        cut = {r["id"]: r["w"] for r in small.words(units, inner).collect()}
        assert cut == {r["id"]: r["w"] for r in large.words(units, inner).collect()} and len(cut) == len(texts)
    words = segment.Words({r["term"]: r["n"] for r in terms.collect()})
    assert all(w == words.cut((texts[i] or "").lower()) for i, w in ((r["id"], r["w"]) for r in small.words(units).collect()))
    assert small.query_terms("证券法的内幕交易证券") == ["证券", "证券法", "内幕", "幕交", "交易", "内幕交易"]


# --- trigrams


def plain_hits(text, phrase):
    return text.lower().count(phrase.lower()) if text else 0


def test_phrases_are_counted_as_in_the_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abAB 证é😀") for _ in range(rng.randrange(60))) for _ in range(200)] + ["aaaaaaaaaa", "x" * 5000 + "abab", None, "", "ab"]
    units = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    phrases = ["aba", "aaaa", "ab", "b 证é", "a" * 9, "x" * 4000, "abab", "ABA", "😀ab", "nowhere to be found"]
    got = {(r["phrase"], r["id"]): (r["n"], r["dl"]) for r in grams.hits(grams.postings(units), phrases).collect()}
    want = {(i, k): (plain_hits(t, p), max(len(t) - 2, 0)) for i, p in enumerate(phrases) for k, t in enumerate(texts) if len(p) >= 3 and plain_hits(t, p)}
    assert got == want and any(k[0] == 4 for k in want)


def test_scores_equal_those_of_reading_all_texts(spark):
    rng = random.Random(3)
    units = spark.createDataFrame([(i, " ".join(rng.choice(["cold", "widget", "old", "rule"]) for _ in range(rng.randrange(30)))) for i in range(120)], "id long, text string")
    stats = units.agg(F.count(F.lit(1)).alias("n"), F.avg(grams.size(F.col("text"))).alias("avgdl"))
    held = grams.postings(units)
    for query in ("cold widget", "old", "cold, old rule", "ab", "no such words"):
        fast = {r["id"]: r["score"] for r in grams.keyword_scores(held, stats, query).collect()}
        slow = {r["id"]: r["score"] for r in retrieval.keyword_scores(units, query).collect()}
        assert fast.keys() == slow.keys() and all(math.isclose(fast[i], slow[i], rel_tol=1e-9) for i in fast)


# --- segments


def rows_of(df):
    return sorted(map(str, df.collect()))


def everything(spark, root):
    return [rows_of(x.select(*sorted(x.columns))) for x in (index.read(spark, root)[0], index.read_grams(spark, root)[0], index.read(spark, root)[1], index.read_grams(spark, root)[1], index.read_units(spark, root))]


def written(root):
    import os

    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_refreshes_equal_a_rebuild_and_write_what_changed(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["cold", "widget", "证券交易", "rule", "内幕"]) for _ in range(12))
    held = {i: text() for i in range(400)}
    frame = lambda: spark.createDataFrame(list(held.items()), "id long, text string").coalesce(2)
    root = f"file://{tmp_path}/index"
    index.refresh(frame(), root)
    first, before = everything(spark, root), written(tmp_path / "index")
    assert len(index.segments(spark, root)) == 1
    for step in range(4):
        changed = rng.sample(sorted(held), 3)
        for i in changed[:2]:
            held[i] = text()
        del held[changed[2]]
        held[1000 + step] = text()
        files_before = written(tmp_path / "index")
        index.refresh(frame(), root, spark.createDataFrame([(i,) for i in changed[:2]], "id long"))
        new = {f: n for f, n in written(tmp_path / "index").items() if f not in files_before}
        units = [f for f in new if "/units/" in f]
        # at most what changed so far, the base isn't written again
        assert sum(spark.read.parquet(f"file://{f}").count() for f in units) <= 2 * 3 * (step + 1)
        assert all(f in written(tmp_path / "index") for f in files_before)
    whole = f"file://{tmp_path}/whole"
    index.refresh(frame(), whole)
    assert everything(spark, root) == everything(spark, whole)
    assert 1 < len(index.segments(spark, root)) < 5
    # a reader of the first version sees what it saw
    assert rows_of(index.read(spark, root, "000000")[0].select("dl", "id", "term", "tf")) == first[0] and before.items() <= written(tmp_path / "index").items()
    went = index.vacuum(spark, root, keep=1)
    assert went and everything(spark, root) == everything(spark, whole) and index.versions(spark, root) == ["000004"]


def test_segments_merge_until_one_is_left(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    held = {}
    for i in range(5):
        held[i] = f"word{i} again"
        index.refresh(spark.createDataFrame(list(held.items()), "id long, text string"), root)
    assert len(index.segments(spark, root)) <= 2
    index.refresh(spark.createDataFrame([], "id long, text string"), root)
    assert index.read(spark, root)[0].count() == 0 and index.read(spark, root)[1].first()["n"] == 0
    index.refresh(spark.createDataFrame([(1, "back")], "id long, text string"), root)
    assert [r["term"] for r in index.read(spark, root)[0].collect()] == ["back"]


# --- search


@pytest.fixture(scope="module")
def library(spark):
    laws = spark.createDataFrame([(1, "证券法", "法律"), (2, "增值税法", "法律"), (3, "公司法", "法律")], "id long, title string, level string").selectExpr(
        "*", "'现行有效' AS status", "'' AS source_url", "CAST(NULL AS bigint) AS duplicate_of", "CAST(NULL AS bigint) AS superseded_by", "CAST(NULL AS string) AS quality_flag"
    )
    arts = spark.createDataFrame(
        [(11, 1, "第一条", "禁止内幕交易", [1.0, 0.0]), (12, 1, "第二条", "证券交易所的规则", None), (21, 2, "第一条", "交税的人", None), (31, 3, "第一条", "公司的章程", None)],
        "id long, law_id long, article_no string, text string, embedding array<float>",
    )
    return arts, laws


def searched(spark, library, tmp_path, query, tokens=None, **more):
    arts, laws = library
    tokens = tokens or retrieval.X.tokens
    root = f"file://{tmp_path}/index-{random.random()}"
    units = arts.select("id", F.concat_ws(" ", "article_no", "text").alias("text"))
    held = index.refresh(units, root, tokens=tokens)
    shown, total, mode = retrieval.search(arts, laws, *held, query, phrases=index.read_grams(spark, root), tokens=tokens, **more)
    rows = shown.collect()
    assert total.first()["total"] >= len(rows)
    return [(r["id"], list(r["reasons"])) for r in rows], mode


def test_dictionary_search_finds_whole_words(spark, library, terms, tmp_path):
    found, mode = searched(spark, library, tmp_path, "证券交易所规则", segment.Segmenter(terms))
    assert found[0][0] == 12 and "segment" in found[0][1] and mode == "keyword"


def test_texts_are_read_for_terms_only_if_both_word_legs_are_empty(spark, library, tmp_path):
    found, mode = searched(spark, library, tmp_path, "税")
    assert found == [(21, ["keyword"])] and mode == "keyword"
    found, _ = searched(spark, library, tmp_path, "内幕交易")
    assert found[0][0] == 11  # 12 has a pair of it


def test_mode_is_hybrid_only_if_vectors_were_met(spark, library, tmp_path):
    arts, laws = library
    found, mode = searched(spark, library, tmp_path, "内幕交易", vector=[1.0, 0.0])
    assert mode == "hybrid" and found[0][0] == 11 and "vector" in found[0][1]
    bare = (arts.withColumn("embedding", F.lit(None).cast("array<float>")), laws)
    assert searched(spark, bare, tmp_path, "内幕交易", vector=[1.0, 0.0])[1] == "keyword"


def test_many_candidates_are_numbered_by_ranges(spark):
    rng = random.Random(5)
    legs = [(name, spark.createDataFrame([(i, float(rng.randrange(4))) for i in range(n)], "id long, score double")) for name, n in (("segment", 300), ("vector", 200))]
    few, held = retrieval.ranked(legs)
    many, _ = retrieval.ranked(legs, most=10)
    assert rows_of(few) == rows_of(many) and held == {"segment": 300, "vector": 200}


def test_words_are_cut_by_patterns_of_one_script():
    assert re.fullmatch(segment._HAN, "中々〇㐀") and not re.search(segment._HAN, "カタaЯ9")
