"""What the third round's review found."""

import datetime as dt
import difflib
import random

from pyspark.sql import functions as F

from sparkfolio.llm import packing, quality, simhash, spans
from sparkfolio.plans import catalogue
from sparkfolio.operators import citations, governance, grams, index, retrieval
from sparkfolio.sources import pages


def test_only_closed_entities_become_characters(spark):
    html = "<h1>a &lt;&amp;lt; b&ampb &copy=1 &amp</h1>" + "<p>&middot;&#65;&#x42; c&amp d&nbsp;e f g &ampx; &nosuch;</p>"
    row = spark.createDataFrame([(html,)], "html string").select(pages.title(F.col("html")).alias("h"), pages.plain_text(F.col("html")).alias("t")).first()
    assert row["h"] == "a <&lt; b&ampb &copy=1 &amp"
    assert row["t"] == row["h"] + "\n·AB c&amp d e f g &ampx; &nosuch;"


def test_every_event_says_when_its_user_changed(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n, tzinfo=dt.UTC)
    rows = [(1, "view", 5.0, day(1)), (2, "purchase", 99.0, day(20)), (2, "purchase", 1.0, day(2)), (3, "view", 1.0, day(21)), (None, "click", 1.0, day(3))]
    spark.createDataFrame(rows, "user_id long, event_type string, value double, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    found = {r["user_id"]: r["stale"] for r in catalogue.queries()["stale_sources"](spark, str(tmp_path)).collect()}
    assert found == {1: True, 2: False, 3: False, None: True}


def test_texts_that_meet_by_chance_are_not_compared(spark, monkeypatch):
    """Texts share five words in a row by chance; only near copies come to a comparison of texts, and none of them is missed."""
    rng, asked = random.Random(3), []
    common = [" ".join(f"c{i}x{j}" for j in range(5)) for i in range(40)]
    texts = [" ".join(x for _ in range(12) for x in (" ".join(f"u{rng.randrange(10**9)}" for _ in range(25)), rng.choice(common))) for _ in range(60)]
    near = [t.replace(" ", f" n{i} ", 1) for i, t in enumerate(texts[:10])] + ["a b c d e f", "a b c d e f g", "x y z"]
    rows = list(enumerate(texts + near))
    whole = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, *more: asked.append(pairs.count()) or whole(pairs, *more))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similar=0.8).collect()}
    assert got == {i: i - 60 if 60 <= i < 70 else i for i, _ in rows} | {70: 70, 71: 71}
    assert sum(asked) <= 12


def test_copies_too_different_to_link_are_not_compared(spark, monkeypatch):
    """Of a group of edited copies, those with an edit or two are linked; those with five share all their common shingles, but no pair of them comes to a comparison of texts."""
    rng, asked = random.Random(8), []
    base = [f"w{i}" for i in range(150)]

    def edited(edits):
        words = list(base)
        for at in rng.sample(range(15), edits):
            words[10 * at] = f"e{rng.randrange(10**9)}"
        return " ".join(words)

    rows = list(enumerate([edited(1) for _ in range(20)] + [edited(5) for _ in range(60)]))
    sets = {i: set(simhash.set_of(list(simhash.shingle_hashes(t, 5))).tolist()) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    whole = simhash.alike
    monkeypatch.setattr(simhash, "alike", lambda pairs, *more: asked.append(pairs.count()) or whole(pairs, *more))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), similar=0.8).collect()}
    assert got == want and len(set(want.values())) == 61
    assert sum(asked) <= 160


def test_all_labelled_documents_count(spark):
    labels = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    found = {r["kind"]: r["n"] for r in quality.labelled(labels, quality.Quality()).groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert found["bad"] == 10_000 and found["fit"] + found["held"] == 30_000 and min(found.values()) >= 10_000


def test_thresholds_of_many_rows_are_those_of_a_sorted_list(spark):
    rng = random.Random(5)
    held = [rng.choice([rng.gauss(0, 1), 0.25, 1e-300, rng.random() * 1e6]) for _ in range(3000)]
    bad = [rng.gauss(-1, 1) for _ in range(500)]
    rows = spark.createDataFrame([("held", v) for v in held] + [("bad", v) for v in bad], "kind string, v double").repartition(3).persist()
    for lost in (0.0, 0.005, 0.4, 0.9):
        assert quality.at_rank(rows.where("kind = 'held'"), int(lost * 3000), 20) == sorted(held)[int(lost * 3000)]
        assert quality.bound(rows, "v", lost, 20) == quality.threshold(held, bad, lost)
    assert quality.bound(rows.where("kind = 'bad'"), "v", 0.1) == quality.bound(rows.where("kind = 'held'"), "v", 0.1) == -float("inf")
    rows.unpersist()


def test_searches_need_no_index_of_all_grams(spark, tmp_path, monkeypatch):
    """The grams and words asked for give the scores that an index of everything gives."""
    rng = random.Random(8)
    words = ["that", "with", "was", "The", "on", "at", "wAs", "thatwas", "ü"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(80, None), (81, "")]
    units = spark.createDataFrame(rows, "id long, text string")
    every, terms = (units.agg(F.count("*").alias("n"), F.avg(grams.size(F.col("text"))).alias("avgdl")), ["that", "with", "was"])
    for query in ("the on", "that with was", "was"):
        known = grams.keyword_scores(grams.postings(units), every, query)
        made = grams.keyword_scores(*grams.of_phrases(units, [query, *query.split(" ")]), query)
        assert made.collect() and sorted(made.collect()) == sorted(known.collect())
    known = retrieval.bm25(retrieval.postings(units), retrieval.corpus_stats(units), terms)
    assert sorted(retrieval.bm25(*retrieval.of_terms(units, terms), terms).collect()) == sorted(known.collect())
    monkeypatch.setattr(index, "refresh", None)
    assert catalogue.queries()["hybrid_total"](spark, "/root/testdata/sf0.001").first()["total"] > 0


def test_a_task_sorts_no_more_postings_as_texts_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "RANGE_CHARS", 1000)
    units = spark.range(200).select("id", F.concat_ws(" ", *[F.concat(F.lit("w"), F.col("id") * 7 + i) for i in range(20)]).alias("text"))
    found, _ = index.refresh(units, f"{tmp_path}/index", kinds=("postings",))
    assert found.count() == 4000 and found.select(F.input_file_name()).distinct().count() > 8


def test_containers_go_to_python_in_small_batches(spark):
    plan = spark.createDataFrame([("<nav>x</nav>",)], "html string").select(pages.container(F.col("html"), "nav").alias("c"))
    assert plan.first()["c"] == "x"
    assert "ArrowEvalPython" not in plan._jdf.queryExecution().toString() and "BatchEvalPython" in plan._jdf.queryExecution().toString()


def test_answers_of_one_file_are_read_by_many_tasks(spark):
    answers = spark.range(100).coalesce(1).select("id", F.concat(F.lit("【《法"), F.col("id").cast("string"), F.lit("》· 第3条、第四条、第3条； 乙·全文 】")).alias("text"))
    found = citations.citations(answers)
    assert found.select(F.spark_partition_id()).distinct().count() > 1
    assert [tuple(r) for r in found.where("id = 7").orderBy("nth").collect()] == [(7, 0, "《法7》", "第3条", "第三条"), (7, 1, "《法7》", "第四条", "第四条"), (7, 2, "乙", "全文", "全文")]


def test_relations_are_joined_once(spark, monkeypatch):
    lines, read = [], catalogue.shared.stored
    monkeypatch.setattr(catalogue.shared, "stored", lambda df, name: lines.append(name) or read(df, name))
    assert catalogue.queries()["maintained_degrees"](spark, "/root/testdata/sf0.001").count() > 0
    assert lines.count("relations") == 1


def test_texts_of_latin_1_are_encoded_without_a_second_reading():
    own = packing.Encoder(packing.TOKENIZER)
    texts = ["", " ", "don't  stop\n\n 12a é!?\t", "x" + " " * 999 + "y", "x" + " " * 1000 + "y", "é" + "\n" * 1500, "“a” – b…", "中 a", "a \u00a0\u00a0 b  "]
    assert [own.other(t) for t in texts] == [bool(own.OTHER.search(t)) for t in texts]
    assert [own(t).tolist() for t in texts] == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_only_texts_with_repeats_are_cut_into_sentences_again(spark):
    """A text's runs say how many sentences it has; only those that lose some go to Python again."""
    shared = " ".join(f"Common w{i} of these is here." for i in range(8))
    rows = [(1, f"One own. {shared} End here."), (2, f"Other own. {shared}"), (3, "Alone. Two\n\nthree."), (4, None), (5, " \n"), (6, "x")]
    found = spark.createDataFrame(rows, "doc_id long, text string")
    cleaned = spans.remove_repeats(found)
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in cleaned.collect()}
    assert got == {1: (rows[0][1], 10, 0), 2: ("Other own.", 9, 8), 3: (rows[2][1], 3, 0), 4: (None, 0, 0), 5: (" \n", 0, 0), 6: ("x", 1, 0)}
    assert spans.parsed("Ab c.\nD")[1] == ["ab", "c.", "d"]


def test_runs_of_sentences_move_once_and_are_not_kept(spark, monkeypatch):
    """What is stored has a row for each text, not for each run; runs are dealt out by their hash once, later ones and a text's last one by their text."""
    kept, store = [], spans.stored
    monkeypatch.setattr(spans, "stored", lambda df, name: kept.append((df, store(df, name))) or kept[-1][1])
    shared = " ".join(f"Common w{i} of these is here." for i in range(40))
    docs = spark.createDataFrame([(i, f"Own e{i}. {shared}" if i % 2 else shared) for i in range(10)] + [(None, shared), (3, f"Own e3. {shared}")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_sentences, r.n_removed, r.text) for r in spans.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(i, 41, 40, f"Own e{i}.") if i % 2 else (i, 40, 40 * (i > 0), shared if i == 0 else "") for i in range(10)] + [(None, 40, 40, ""), (3, 41, 40, "Own e3.")], key=str)
    assert sum(made.count() for _, made in kept) == 11
    assert sum(plan._jdf.queryExecution().sparkPlan().toString().count("MapInArrow") for plan, _ in kept) == 1
    assert kept[0][0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 2


def test_a_run_of_very_many_texts_is_met_once_a_batch(spark):
    """Copies that are read together are known as later ones, so few rows of a common run meet in one task; all of them are still cut."""
    shared = " ".join(f"Common w{i} of these is here." for i in range(40))
    docs = spark.createDataFrame([(i, f"Own e{i}. {shared}") for i in range(300)], "doc_id long, text string").repartition(3)
    found = spans.all_runs(docs)
    assert found.groupBy("run", "rest").count().agg(F.max("count")).first()[0] <= 3 and found.where("not later").count() <= 3 * 40 + 300
    assert {(r.n_sentences, r.n_removed) for r in spans.remove_repeats(docs).where("doc_id > 0").collect()} == {(41, 40)}


def test_pairs_of_one_keeper_are_compared_by_many_tasks_and_only_as_far_as_needed(spark):
    rng = random.Random(4)
    base = "".join(chr(0x4E00 + rng.randrange(300)) for _ in range(600))
    texts = [base, *["".join(rng.choice("xy") if rng.random() < k / 400 else c for c in base) for k in range(40)], "", base[::-1], base[300:] + base[:300], base[:-1], *[base[:20] + "z" * k + base[20:] for k in (1, 40, 90)]]
    for t in texts:
        want = difflib.SequenceMatcher(None, t, base).ratio()
        assert governance.ratio(t, base) == (want if want >= governance.SIMILAR else None)
    asked, find = [], difflib.SequenceMatcher.find_longest_match
    difflib.SequenceMatcher.find_longest_match = lambda *a: asked.append(1) or find(*a)
    try:
        assert governance.ratio(base[300:] + base[:300], base) is None and len(asked) <= 2
    finally:
        difflib.SequenceMatcher.find_longest_match = find
    laws = spark.createDataFrame(list(enumerate(texts)), "id long, full_text string").coalesce(1)
    made = governance.to_compare(spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "id long, keeper_id long").coalesce(1), laws)
    assert made.select(F.spark_partition_id()).distinct().count() > 1 and "regexp_count" not in made._jdf.queryExecution().toString()


def test_answers_are_read_once_to_be_resolved(spark):
    answers = spark.createDataFrame([(1, "【甲法·第3条；甲法·第三条】【乙·全文】"), (2, None)], "id long, text string")
    laws = spark.createDataFrame([(7, "甲法")], "id long, title string").withColumns({c: F.lit(None).cast("string") for c in ("duplicate_of", "superseded_by", "quality_flag")})
    found = citations.resolve(answers, laws, spark.createDataFrame([(70, 7, "第3条")], "id long, law_id long, article_no string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, "甲法", "第3条", "第三条", 7, 70), (1, 2, "乙", "全文", "全文", None, None)]
    assert "regexp_extract_all" not in found.drop("article_no")._jdf.queryExecution().optimizedPlan().toString()
