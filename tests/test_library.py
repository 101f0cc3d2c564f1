"""Ingest, files, pages, index, references and the rules that typed cases show best."""

import difflib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkfolio import schema
from sparkfolio.functions import numerals as N
from sparkfolio.functions import text as X
from sparkfolio.functions import titles as T
from sparkfolio.operators import catalog, citations, governance, graph, index, retrieval, upsert
from sparkfolio.sources import buckets, files, pages, registry, shared
from sparkfolio.streaming import ingest


def law_text(*bodies):
    return "总则\n" + "\n".join(f"第{i + 1}条 {b}" for i, b in enumerate(bodies)) + "\n" + "x" * 60


def land(folder, name, *docs):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"source_name": "s", "title": t, "full_text": x, "status": None}, ensure_ascii=False) for t, x in docs), encoding="utf-8")


def test_ingest_of_two_batches(spark, tmp_path):
    landing, root, mark = tmp_path / "landing", f"file://{tmp_path}/root", f"file://{tmp_path}/mark"
    land(landing, "a.json", ("甲法", law_text(*"abcdefgh")), ("乙法（2023年修订）", law_text("y")), ("", law_text("no title")), ("short", "short"))
    ingest.start_ingest(spark, f"file://{landing}", root, mark).awaitTermination(120)
    first = ingest.current(spark, root)
    laws = {r.title: r for r in first["laws"].collect()}
    assert set(laws) == {"甲法", "乙法（2023年修订）"} and laws["乙法（2023年修订）"].version_label == "2023年修订" and laws["甲法"].status == "现行有效"
    own = [(r.article_no, r.text) for r in first["articles"].where(F.col("law_id") == laws["甲法"].id).orderBy("id").collect()]
    assert [a for a, _ in own] == [f"第{i + 1}条" for i in range(8)] and [t[0] for _, t in own] == list("abcdefgh")
    rows, total, _, _ = catalog.reader(first["articles"], first["laws"], laws["甲法"].id)
    assert total == 8 and [r.text[0] for r in rows.collect()] == list("abcdefgh")
    land(landing, "b.json", ("甲法", law_text(*"abcX")), ("乙法（2023年修订）", law_text("y")), ("丙法", law_text("z")))
    ingest.start_ingest(spark, f"file://{landing}", root, mark).awaitTermination(120)
    second = ingest.current(spark, root)
    rows = second["laws"].collect()
    now = {r.title: r for r in rows if r.superseded_by is None}
    old = [r for r in rows if r.superseded_by is not None]
    assert len(rows) == 4 and now["甲法"].id == laws["甲法"].id and [(r.superseded_by, r.status) for r in old] == [(laws["甲法"].id, "已修订")]
    texts = lambda i: [r.text[0] for r in second["articles"].where(F.col("law_id") == i).orderBy("id").collect()]
    assert texts(now["甲法"].id) == list("abcX") and texts(old[0].id) == list("abcdefgh") and texts(now["丙法"].id) == ["z"]
    assert [(r.new_count, r.updated_count, r.status) for r in second["sync_log"].orderBy("id").collect()] == [(2, 0, "ok"), (1, 1, "ok")]
    assert len(buckets.snapshots(spark, root)) == 2


def lines_of(spark, *docs):
    made = [(d if isinstance(d, str) else json.dumps({"source_name": "s", "title": d[0], "full_text": d[1]}, ensure_ascii=False), "f.json") for d in docs]
    return spark.createDataFrame(made, "value string, file string")


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    assert ingest.ingest_batch(lines_of(spark, *[(f"law {i}", law_text(f"body {i}")) for i in range(150)]), root, "000")
    before = buckets.folders(spark, root)
    seen = {t: sorted(map(str, df.collect())) for t, df in ingest.current(spark, root).items()}
    files_of = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "root" / "data").rglob("*.parquet")}
    old_files = files_of()
    law = {r.title: r.id for r in ingest.current(spark, root)["laws"].collect()}
    # a relation and a mark of a law that refers to the one that changes, and others that stay
    art = {r.law_id: r.id for r in ingest.current(spark, root)["articles"].collect()}
    relation = spark.createDataFrame([(1, art[law["law 5"]], art[law["law 7"]], "引用", None, None), (2, art[law["law 8"]], art[law["law 9"]], "引用", None, None)], schema.RELATIONS)
    marks = spark.createDataFrame([(law[f"law {i}"], "ok", 1, 0, 0, 0, None, None) for i in (5, 7, 8)], schema.MARKS)
    buckets.publish(spark, root, "000-x", {"relations": (relation, "from_id", set()), "relation_extractions": (marks, "law_id", set())})
    assert ingest.ingest_batch(lines_of(spark, ("law 7", law_text("changed")), ("law 150", law_text("new")), ("law 8", law_text("body 8"))), root, "001")
    after, now = buckets.folders(spark, root), ingest.current(spark, root)
    replaced = {b for b, fs in before["laws"].items() if not set(fs) <= set(after["laws"][b])}
    assert replaced == {r[0] for r in spark.createDataFrame([(law["law 7"],)], "id long").select(buckets.bucket_of("id")).collect()}
    assert sum(before["laws"][b] == after["laws"][b] for b in before["laws"]) >= len(before["laws"]) - 3
    # files of the older snapshot are as they were, and so is what its readers see
    assert old_files.items() <= files_of().items()
    assert {t: sorted(map(str, df.collect())) for t, df in ingest.current(spark, root, "000").items()} == seen
    rows = now["laws"].collect()
    assert len(rows) == 152 and len({r.id for r in rows}) == 152 and [r.superseded_by for r in rows if r.status == "已修订"] == [law["law 7"]]
    assert {(r.from_id, r.to_id) for r in now["relations"].collect()} == {(art[law["law 8"]], art[law["law 9"]])}
    assert {r.law_id for r in now["relation_extractions"].collect()} == {law["law 8"]}
    assert [r.text[:7] for r in now["articles"].where(F.col("law_id") == law["law 7"]).collect()] == ["changed"]
    assert now["articles"].select("id").distinct().count() == now["articles"].count() == 152
    # the same batch again is no snapshot more
    assert not ingest.ingest_batch(lines_of(spark, ("law 7", law_text("changed"))), root, "001") and buckets.snapshots(spark, root) == ["000", "000-x", "001"]
    assert buckets.vacuum(spark, root, keep=1) > 0 and sorted(map(str, ingest.current(spark, root)["laws"].collect())) == sorted(map(str, rows))


def test_crowded_buckets_are_written_anew(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/root"
    monkeypatch.setattr(buckets, "MOST_FOLDERS", 1)
    monkeypatch.setattr(buckets.bucket_of, "__defaults__", (1,))
    for i in range(3):
        ingest.ingest_batch(lines_of(spark, (f"law {i}", law_text(f"body {i}"))), root, f"{i:03d}")
    own, now = buckets.folders(spark, root), ingest.current(spark, root)
    assert len(own["laws"][0]) == 1 and len(own["articles"][0]) == 1
    assert {r.title for r in now["laws"].collect()} == {"law 0", "law 1", "law 2"} and now["articles"].count() == 3 and now["sync_log"].count() == 3


def test_broken_lines_are_kept_told_and_replayed(spark, tmp_path):
    landing, root, mark = tmp_path / "landing", f"file://{tmp_path}/root", f"file://{tmp_path}/mark"
    land(landing, "a.json", ("甲法", law_text("a")))
    with (landing / "a.json").open("a", encoding="utf-8") as f:
        f.write('\n{"title": "乙法", "full_text": "\n[1, 2]\n\n')
    ingest.start_ingest(spark, f"file://{landing}", root, mark).awaitTermination(120)
    log = ingest.current(spark, root)["sync_log"].first()
    assert (log.new_count, log.status) == (1, "partial") and log.detail == "a.json: not a JSON document; a.json: not a JSON document"
    name = buckets.snapshots(spark, root)[-1]
    assert {r.line for r in ingest.refused(spark, root, name).collect()} == {'{"title": "乙法", "full_text": "', "[1, 2]"}
    again = ingest.replay(spark, root, name)
    assert ingest.refused(spark, root, again).count() == 2 and ingest.current(spark, root)["sync_log"].orderBy("id").collect()[-1].status == "failed"
    third = ingest.replay(spark, root, name, lines_of(spark, ("乙法", law_text("b"))))
    assert {r.title for r in ingest.current(spark, root)["laws"].collect()} == {"甲法", "乙法"} and buckets.snapshots(spark, root) == [name, again, third]
    land(landing, "b.json", ("丙法", law_text("c")))
    ingest.start_ingest(spark, f"file://{landing}", root, mark).awaitTermination(120)
    assert ingest.current(spark, root)["laws"].count() == 3 and buckets.snapshots(spark, root)[-1] > third


def test_one_text_is_taken_once_and_ends_are_stripped(spark):
    laws = spark.createDataFrame([(1, "s", "A", "held " * 20 + "x", None, None)], "id long, source_name string, title string, full_text string, duplicate_of long, superseded_by long").withColumn("content_hash", X.content_hash(F.col("full_text")))
    text, other = "new " * 20 + "x", "other " * 20 + "x"
    rows = [("s", "B", text), ("s", "C", text), ("a", "Z", f"  {text}\n"), ("s", " A ", other), ("s", "D", other), ("s", "  ", text), ("s", "E", " " * 70), ("s", "\u3000A", "held " * 20 + "x"), (None, None, None)]
    got = {(r.source_name, r.title): r.action for r in upsert.classify(spark.createDataFrame(rows, "source_name string, title string, full_text string"), laws).collect()}
    assert got[("a", "Z")] == "insert" and got[("s", "B")] == got[("s", "C")] == "skip"
    assert got[("s", "A")] in ("update", "skip") and got[("s", "D")] == ("skip" if got[("s", "A")] == "update" else "insert")
    assert got[("s", "")] == got[("s", "E")] == got[(None, "")] == "skip"


def test_old_version_held_elsewhere_is_not_kept_twice(spark):
    laws = spark.createDataFrame([(1, "s", "t", "a" * 60, None, None), (2, "o", "u", "a" * 60, None, None)], "id long, source_name string, title string, full_text string, duplicate_of long, superseded_by long")
    laws = laws.withColumn("content_hash", X.content_hash(F.col("full_text"))).withColumns({c: F.lit(None).cast("string") for c in ("status", "created_at", "updated_at", "version_label", "issuer")})
    batch = spark.createDataFrame([("s", "t", "b" * 60, "new status")], "source_name string, title string, full_text string, status string")
    after = {r.id: r for r in upsert.apply(upsert.classify(batch, laws), laws, "now").collect()}
    assert set(after) == {1, 2} and after[1].full_text == "b" * 60 and after[1].status == "new status" and after[2].full_text == "a" * 60


def test_numbers_keep_the_order(spark):
    rows = spark.range(5000).select(F.pmod(F.col("id") * 7919, F.lit(5000)).alias("k"), F.lit("same").alias("s"))
    got = shared.numbered(rows.repartition(7), "s", "k").collect()
    assert all(r.nth == r.k + 1 for r in got) and len(got) == 5000
    assert shared.numbered(rows.limit(0), "k").count() == 0


def test_index_is_stored_and_renewed(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    units = spark.createDataFrame([(1, "cold widget cold"), (2, "证券交易 rules"), (3, None)], "id long, text string")
    postings, stats = index.refresh(units, root)
    assert {(r.term, r.id, r.tf, r.dl) for r in postings.collect()} >= {("cold", 1, 2, 3), ("widget", 1, 1, 3), ("证券", 2, 1, 4), ("rules", 2, 1, 4)}
    assert stats.first()["n"] == 3 and index.versions(spark, root) == ["000000"]
    index.refresh(units, root)
    assert index.versions(spark, root) == ["000000"]
    later = spark.createDataFrame([(1, "cold again"), (3, None), (4, "new one")], "id long, text string")
    postings, stats = index.refresh(later, root, later.where("id = 1").select("id"))
    assert {(r.term, r.id) for r in postings.collect()} == {("cold", 1), ("again", 1), ("new", 4), ("one", 4)} and stats.first()["n"] == 3
    assert [r.id for r in retrieval.bm25(postings, stats, ["again"]).collect()] == [1] and retrieval.bm25(postings, stats, []).count() == 0


def test_chinese_terms(spark):
    q = spark.createDataFrame([(1, "证券发行，内幕交易"), (2, "disclosure rules"), (3, "信息披露的")], "id int, q string")
    got = {r.id: r.t for r in q.select("id", X.highlight_terms(F.col("q")).alias("t")).collect()}
    assert got[2] == ["disclosure", "rules"] and got[1][:2] == ["证券发行", "内幕交易"] and {"信息披露", "信息", "披露"} <= set(got[3])
    assert X.split_terms("证券，交易 x") == ["证券", "交易"] and X.split_terms("a") == ["a"]


def test_titles(spark):
    raw = ["【甲站】《证券法》（2023年修订）", "公司法(2018年修正)", "《关于印发《办法》的通知》", "  信托法　", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, title string").select("id", T.normalize_title(F.col("title")).alias("n"), T.version_label(F.col("title")).alias("v"), T.clean_title(F.col("title")).alias("c")).orderBy("id").collect()
    assert [r.n for r in rows] == ["证券法", "公司法", "关于印发《办法》的通知", "信托法", ""]
    assert [r.v for r in rows] == ["2023年修订", "2018年修正", None, None, None]
    alias = spark.createDataFrame([("证监会规则",)], "t string").select(T.title_variants(F.col("t")).alias("v")).first()["v"]
    assert alias == ["证监会规则", "中国证券监督管理委员会规则"]


def test_article_numbers(spark):
    want = {"第1条": "第一条", "第101条": "第一百零一条", "第9999条": "第九千九百九十九条", "第19条之2（经修改）": "第十九条之二", "第0条": "第0条", "第10000条": "第10000条", "第19十一条": "第19十一条", "第一一十九条": "第一一十九条", "第一百〇一条": "第一百零一条"}
    rows = spark.createDataFrame([(k,) for k in want], "r string").select("r", N.normalize_article_no(F.col("r")).alias("n")).collect()
    assert {r.r: r.n for r in rows} == want


def test_citations_of_typed_answers(spark):
    answers = spark.createDataFrame([(1, "见【证券法·第五十条、第51条】和【《公司法》·全文；证券法·第50条】。"), (2, "无"), (3, "【民法典·第一条】【散文】")], "id int, text string")
    none = "duplicate_of bigint, superseded_by bigint, quality_flag string"
    laws = spark.createDataFrame([(10, "中华人民共和国证券法", None, None, None), (11, "公司法", None, None, None), (12, "关于修改《证券法》的决定", None, None, None)], f"id int, title string, {none}")
    arts = spark.createDataFrame([(101, 10, "第五十条"), (102, 10, "第51条"), (103, 11, "第一条")], "id int, law_id int, article_no string")
    got = {(r.id, r.ref_title, r.article_no): (r.law_id, r.article_id) for r in citations.resolve(answers, laws, arts).collect()}
    assert got == {(1, "证券法", "第五十条"): (10, 101), (1, "证券法", "第五十一条"): (10, 102), (1, "《公司法》", "全文"): (11, None), (3, "民法典", "第一条"): (None, None)}
    plan = citations.match_titles(citations.citations(answers), laws)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_missing_fixed_citation_is_an_error(spark):
    arts = spark.createDataFrame([(1, 5, "第一条", "t")], "id long, law_id long, article_no string, text string")
    laws = spark.createDataFrame([(5, "L")], "id long, title string")
    assert citations.require(spark.createDataFrame([(1,)], "article_id long"), laws, arts).count() == 1
    with pytest.raises(Exception, match="no article 2"):
        citations.require(spark.createDataFrame([(1,), (2,)], "article_id long"), laws, arts).collect()


def test_near_duplicates_by_title_equal_brute_force(spark):
    base = "The same law says the same thing in many words, again and again. " * 30
    rows = [(1, "A", base), (2, "《A》", base + "x"), (3, "A（2023年修订）", base[:-200]), (4, "A", "other " * 200), (5, "B", base), (6, "B", base), (7, "C", None), (8, "C", ""), (9, "A", "y" + base[1:] + "z" * 30_000)]
    laws = spark.createDataFrame([(i, t, x, "s", None, None) for i, t, x in rows], "id long, title string, full_text string, source_name string, duplicate_of long, superseded_by long").withColumn("content_hash", X.content_hash(F.col("full_text")))
    got = {r.id: (r.duplicate_of, round(r.similarity, 6)) for r in governance.duplicates(laws).collect()}
    names = {1: "A", 2: "A", 3: "A", 4: "A", 5: "B", 6: "B", 7: "C", 8: "C", 9: "A"}
    text = {i: x or "" for i, _, x in rows}
    want = {}
    for name in "ABC":
        group = [i for i in names if names[i] == name]
        keeper = min(group, key=lambda i: (-len(text[i]), i))
        for i in group:
            a, b = text[i][: governance.COMPARED], text[keeper][: governance.COMPARED]
            r = 1.0 if text[i] == text[keeper] else difflib.SequenceMatcher(None, a, b).ratio()
            if i != keeper and r >= governance.SIMILAR:
                want[i] = (keeper, round(r, 6))
    assert got == want and want


def test_guarded_status(spark):
    laws = spark.createDataFrame([(1, "证券法", "现行有效", None, None), (2, "证券法实施条例", "现行有效", None, None), (3, "公司法", "现行有效", None, None)], "id long, title string, status string, duplicate_of long, superseded_by long")
    done, ids = governance.set_status(laws, "证券法", "已废止", schema.STATUSES)
    assert ids == [1] and {r.id: r.status for r in done.collect()} == {1: "已废止", 2: "现行有效", 3: "现行有效"}
    assert governance.set_status(laws, "公司", "已废止", schema.STATUSES, dry_run=True)[1] == [3] and governance.set_status(laws, "none", "已废止", schema.STATUSES)[1] == []
    with pytest.raises(ValueError):
        governance.set_status(laws, "证券", "已废止", schema.STATUSES)
    with pytest.raises(ValueError):
        governance.set_status(laws, "公司法", "odd", schema.STATUSES)


def test_audit(spark):
    laws = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, title string")
    arts = spark.createDataFrame([(10, 1), (20, 2), (30, 3)], "id long, law_id long")
    rels = spark.createDataFrame([(1, 10, 20, "x"), (2, 20, 10, "x"), (3, 20, 10, "y")], "id long, from_id long, to_id long, rel_type string")
    marks = spark.createDataFrame([(3, 2, "ok", 1), (1, 1, "ok", 1), (2, 0, "failed", 3)], "law_id long, saved int, status string, attempts int")
    assert {r.check: r.n for r in graph.audit(laws, arts, rels, marks).collect()} == {"symmetric": 1, "isolated": 1, "ghost": 1, "failed": 1}
    assert [r.id for r in graph.nearest(spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "id long, x double, y double"), 4.0, 4.0, 2.0).collect()] == [2]


def test_files_of_all_kinds(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    cell = lambda t: f"<w:tc>{run(t)}</w:tc>"
    body = f'<w:document xmlns:w="{word}"><w:body>{run("First")}<w:tbl><w:tr>{cell("a")}{cell("b")}</w:tr></w:tbl>{run("Last")}</w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "old.doc").write_bytes(b"\xd0\xcf\x00\x01" + "第一条 证券交易应当公开。".encode("utf-16-le") + b"\x00\x00\x01\x00")
    (tmp_path / "t.txt").write_text("plain é", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    found = files.landing(spark, f"file://{tmp_path}").select("path", files.file_text("path", "content").alias("r")).select("path", "r.*")
    got = {r.path.rpartition("/")[2]: (r.text, r.error) for r in found.collect()}
    assert got["x.docx"] == ("First\nLast\na | b", None) and "第一条 证券交易应当公开。" in got["old.doc"][0] and got["t.txt"] == ("plain é", None)
    assert got["bad.docx"][0] is None and "BadZipFile" in got["bad.docx"][1]


def test_snapshots_keep_the_newest(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    for i in range(4):
        files.write_snapshot({"t": spark.range(i)}, root, f"{i:03d}", keep=2)
    assert files.snapshots(spark, root) == ["002", "003"] and files.read_snapshot(spark, root, "t").count() == 3
    files.write_report(spark.range(2), f"{root}-report")
    assert spark.read.json(f"{root}-report").count() == 2


def test_settings_and_sources(spark, tmp_path):
    path = str(tmp_path / "c.json")
    assert registry.Settings.load(path) == registry.Settings()
    registry.Settings(page_size=7).save(path)
    assert registry.Settings.load(path).page_size == 7
    (tmp_path / "c.json").write_text("{broken")
    assert registry.Settings.load(path) == registry.Settings()
    rows = registry.enabled_sources(spark, [{"name": "a", "interval_sec": 5}, {"name": "b", "enabled": False}, {"name": "c", "interval_sec": 1.5, "daily_max": 9}]).collect()
    assert [(r.name, r.interval_sec) for r in rows] == [("a", 5.0), ("c", 1.5)] and registry.targets([{"title": "ab"}, {"title": "c"}], "a") == [{"title": "ab"}]


def test_reply_that_lacks_a_number_is_an_error(spark):
    replies = spark.createDataFrame([('{"laws": 5, "articles": 7}',)], "value string")
    assert [tuple(r) for r in files.stats_snapshot(replies, ["laws", "articles"]).collect()] == [(5, 7)]
    with pytest.raises(Exception, match="missing: relations"):
        files.stats_snapshot(replies, ["laws", "relations"]).collect()


def test_embeddings_are_filled_in_and_failures_said(spark):
    arts = spark.createDataFrame([(1, "good", None), (2, "bad", None), (3, "done", [1.0])], "id long, text string, embedding array<float>").repartition(1)

    def embed(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [[float(len(t))] for t in texts]

    got = {r.id: (r.embedding, r.error) for r in retrieval.backfill_embeddings(arts, embed, batch=1).collect()}
    assert got == {1: ([4.0], None), 2: (None, "RuntimeError: no answer")}


def test_pages(spark):
    html = "<html><head><title>T &amp; U</title><style>x{}</style></head><body><h1> Head &eacute; </h1><script>var a='<p>';</script><p>One&nbsp;two &#169; &unknown;</p><!-- no --><noscript>n</noscript>\n\n<p>three</p></body></html>"
    slow = "<div>" + "<!--" + "x" * 4000 + "--><p>tiny</p></div>"
    rows = spark.createDataFrame([(1, html), (2, slow), (3, None), (4, "<title>only</title>")], "id int, html string").select("id", pages.plain_text(F.col("html")).alias("t"), pages.parsed_text(F.col("html")).alias("p"), pages.title(F.col("html")).alias("h")).collect()
    by = {r.id: r for r in rows}
    assert by[1].t.split("\n") == ["T & U", "Head é", "One two © &unknown;", "three"] and by[2].t == "tiny" and by[3].t == ""
    assert [by[i].h for i in (1, 4)] == ["Head é", "only"]


def test_links_of_list_pages(spark):
    html = """<a href="/c/123/files/x.pdf">A long name here</a><a href='b.html'>short</a><a href="javascript:x">No link text</a><a href="/c/123/files/x.pdf">again</a><a href="https://o.org/uploads/1">Up&amp;load</a><script>var curHref='./d.html';var curTitle='Script doc';</script>"""
    df = spark.createDataFrame([(1, "http://h.org/dir/index.html", html)], "page_id int, url string, html string")
    got = [(r.url, r.text) for r in pages.links(df).orderBy("pos").collect()]
    assert got == [("http://h.org/c/123/files/x.pdf", "A long name here"), ("http://h.org/dir/b.html", "short"), ("https://o.org/uploads/1", "Up&load")]
    assert {r.url for r in pages.list_links(df, "numbered").collect()} == {"http://h.org/c/123/files/x.pdf"}
    assert {r.text for r in pages.list_links(df, "long_text").collect()} == {"A long name here", "Up&load"}
    assert [(r.url, r.text) for r in pages.list_links(df, "script").collect()] == [("http://h.org/dir/d.html", "Script doc")]


def test_anchored_bodies(spark):
    body = "（2019年12月28日第十三届会议通过）\n目录\n第一条 为了规范。" + "正文。" * 90
    cases = [
        ("证券法", f"首页 证券法实施条例 第一条 不是 证券法 {body}相关链接：证券法", f"证券法 {body}", "2019年12月28日第十三届会议通过"),
        ("证券法", f"导航 证券法 说明 证券法\n第一条 甲。{'乙' * 30}版权所有", f"证券法\n第一条 甲。{'乙' * 30}", ""),
        ("证券法", "只有 证券法 一词", "证券法 一词", ""),
        ("证券法", "没有", "", ""),
        ("", "没有", "", ""),
        (None, None, "", ""),
        ("a.b", "axb 第一条 a.b 第一条 x", "a.b 第一条 x", ""),
    ]
    df = spark.createDataFrame([(i, n, t) for i, (n, t, _, _) in enumerate(cases)], "id int, name string, text string")
    got = {r.id: (r.body, r.issued) for r in pages.anchored_body(df).collect()}
    for i, (_, _, want, issued) in enumerate(cases):
        assert got[i][0] == want and (not issued or got[i][1] == issued), (i, got[i])
    ok = spark.createDataFrame([("第一条" + "x" * 300,), ("x" * 300,), ("第一条",)], "b string").select(pages.acceptable(F.col("b")).alias("ok")).collect()
    assert [r.ok for r in ok] == [True, False, False]


def test_progress_lines_and_streamed_status(spark, tmp_path):
    lines = spark.createDataFrame([('{"type": "stage", "stage": "search", "round": 1}',), ("no json",), ('{"type": "odd"}',), ('{"type": "result"}',)], "value string")
    assert [r.type for r in ingest.progress_events(lines).collect()] == ["stage", "result"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(json.dumps({"id": i, "source_name": s, "status": k}) for i, s, k in [(1, "a", "ok"), (2, "a", "failed"), (3, None, "ok")]))
    log = spark.readStream.schema("id BIGINT, source_name STRING, status STRING").json(f"file://{tmp_path}/log")
    query = ingest.latest_per_source(log).writeStream.outputMode("complete").format("memory").queryName("latest_rows").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [tuple(r) for r in spark.table("latest_rows").collect()] == [("a", 2, 1)]


def test_small_rules(spark):
    assert [retrieval.safe_top_k(v) for v in (None, "x", 0, 7, 99, "12")] == [8, 8, 1, 7, 50, 12]
    assert retrieval.clamp_page("x", None) == (1, 10) and retrieval.clamp_page(-3, 500) == (1, 100)
    assert retrieval.has_more(21, 2, 10, 10) and not retrieval.has_more(20, 2, 10, 10)
    with pytest.raises(ValueError):
        catalog.check_page(0, 20)
    with pytest.raises(ValueError):
        catalog.check_page(1, 20, "name")
    df = schema.migrate(spark.createDataFrame([("7", 1)], "law_id string, more int"), schema.MARKS)
    assert df.columns == [x.split()[0] for x in schema.MARKS.split(", ")] and df.first()["law_id"] == 7
    docx = io.BytesIO()
    with pytest.raises(Exception):  # noqa: B017
        files.docx_text(docx.getvalue())


def test_parts_are_looked_up_by_their_rarest_gram(spark):
    country = "中华人民共和国"
    names = spark.createDataFrame([(i, f"{country}第{i}号法") for i in range(4000)], "law_id long, law_title string")
    parts = spark.createDataFrame([(f"{country}第{i}号",) for i in range(2000)], "part string")
    assert citations.candidates(parts, "part", names, "law_title", least=4).count() < 40_000
    found = {(r.part, r.law_id) for r in citations.containing(parts.limit(50), "part", names, "law_title").collect()}
    plain = {(p.part, n.law_id) for p in parts.limit(50).collect() for n in names.collect() if p.part in n.law_title}
    assert found == plain and found
    odd = spark.createDataFrame([("法",), ("号法",), ("",), (None,), ("不在",), ("WIDGET",)], "part string")
    more = names.limit(30).unionByName(spark.createDataFrame([(9999, "old widget"), (9998, None), (9997, "")], "law_id long, law_title string"))
    got = {(r.part, r.law_id) for r in citations.containing(odd, "part", more, "law_title").collect()}
    assert got == {("法", i) for i in range(30)} | {("号法", i) for i in range(30)} | {("WIDGET", 9999)}


def test_chips_take_a_year_off_only_where_none_was_said(spark):
    cited = [
        (1, "证券法（2019年修订）", None, "第一条", 10, 101), (1, "中华人民共和国公司法", "公司法", "第5条", 20, 205), (1, "最高人民法院规定", None, "全文", 30, None),
        (2, "证券法（2019年修订）", None, "第一条", 10, 101), (2, "证券法（2005年修订）", None, "第一条", 11, 111), (2, "无号", None, None, 40, 1), (3, "没有的法", None, "第二条", None, None),
    ]
    marks = [(1, 1, "证券法", "第1条"), (1, 2, "证券法（2005年修订）", "第一条"), (1, 3, "公司法", "第五条"), (1, 4, "最高法规定", "全文"), (1, 5, "公司法", "第六条"), (2, 1, "证券法", "第一条"), (2, 2, "证券法（2005年修订）", "第一条"), (3, 1, "没有的法", "第二条"), (4, 1, None, None)]
    got = citations.chips(
        spark.createDataFrame(marks, "id long, nth long, title string, no string"), spark.createDataFrame(cited, "id long, title string, ref_title string, no string, law_id long, article_id long")
    )
    assert {(r.id, r.nth): (r.law_id, r.article_id) for r in got.collect()} == {
        (1, 1): (10, 101), (1, 2): (None, None), (1, 3): (20, 205), (1, 4): (30, None), (1, 5): (None, None), (2, 1): (None, None), (2, 2): (11, 111), (3, 1): (None, None), (4, 1): (None, None),
    }


def test_bounds_spare_comparisons_and_no_pair(spark):
    import random

    rng = random.Random(9)
    base = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(400))  # difflib ignores characters that are too common
    near = [base[:i] + rng.choice("xyz证") + base[i + 1 :] for i in range(0, 40, 4)]
    shuffled = ["".join(rng.sample(base, len(base))) for _ in range(3)]  # same characters, other order: not ruled out
    other = ["".join(chr(0x8000 + rng.randrange(3000)) for _ in range(400)) for _ in range(25)]
    texts = [base, *near, *shuffled, *other, "", None]
    laws = spark.createDataFrame([(i, "同名法", "s", t) for i, t in enumerate(texts)], "id long, title string, source_name string, full_text string").withColumn("content_hash", X.content_hash(F.col("full_text")))
    laws = laws.withColumns({c: F.lit(None).cast("long") for c in ("duplicate_of", "superseded_by")}).withColumn("quality_flag", F.lit(None).cast("string"))
    ratio = lambda t: difflib.SequenceMatcher(None, t or "", base).ratio()
    got = {r.id: r.similarity for r in governance.duplicates(laws).collect()}  # the first of the longest texts is kept
    assert got == {i: ratio(t) for i, t in enumerate(texts) if i and ratio(t) >= governance.SIMILAR}
    pairs = spark.createDataFrame([(i, 0) for i in range(1, len(texts))], "id long, keeper_id long")
    left = {r.id for r in governance.to_compare(pairs, laws).collect()}
    similar = {i for i, t in enumerate(texts) if i and ratio(t) >= governance.SIMILAR}
    assert similar <= left and len(left) == len(near) + len(shuffled) and similar
