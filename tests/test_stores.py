"""The maintained graph, the work loop and the migration ledger."""

import pytest
from pyspark.sql import functions as F

from sparkfolio import schema
from sparkfolio.operators import graph, maintained, worklog
from sparkfolio.sources import buckets, migrations

RELATION = "id long, from_id long, to_id long, rel_type string"


def articles_of(spark, laws=12, each=3):
    return spark.createDataFrame([(law * 10 + i, law) for law in range(laws) for i in range(each)], "id long, law_id long")


def plain(spark, relations, articles):
    edges = {(r.s, r.t, r.rel_type): r.n for r in maintained.signed(relations, articles, 1).collect()}
    return edges, {(r.id, r.n_out, r.n_in) for r in graph.degrees(graph.law_edges(relations, articles)).collect()}


def held(spark, root):
    edges, degrees = maintained.read(spark, root)
    return {(r.s, r.t, r.rel_type): r.n for r in edges.collect()}, {(r.id, r.n_out, r.n_in) for r in degrees.collect()}


def test_folded_graph_equals_recomputation(spark, tmp_path):
    root, arts = f"file://{tmp_path}/graph", articles_of(spark)
    rows = [(i, (i * 7 % 12) * 10 + i % 3, (i * 5 % 12) * 10 + (i + 1) % 3, "ab"[i % 2]) for i in range(80)]
    rel = lambda some: spark.createDataFrame(some, RELATION)
    assert maintained.refresh(root, rel(rows), arts) == "rebuilt" and held(spark, root) == plain(spark, rel(rows), arts)
    assert maintained.refresh(root, rel(rows), arts) == "kept" and len(buckets.snapshots(spark, root)) == 1
    came, went = [(1000, 0, 11, "a"), (1001, 110, 111, "new")], rows[:9]
    after = rows[9:] + came
    before = buckets.folders(spark, root)
    assert maintained.refresh(root, rel(after), arts, rel(came), rel(went)) == "folded" and held(spark, root) == plain(spark, rel(after), arts)
    now = buckets.folders(spark, root)
    assert any(before["edges"].get(b) == fs for b, fs in now["edges"].items()) and len(buckets.snapshots(spark, root)) == 2
    # a change that wasn't told, or was told wrongly, builds the graph anew
    assert maintained.refresh(root, rel(after[1:]), arts) == "rebuilt" and held(spark, root) == plain(spark, rel(after[1:]), arts)
    assert maintained.refresh(root, rel(after[3:]), arts, None, rel(after[1:2])) == "rebuilt" and held(spark, root) == plain(spark, rel(after[3:]), arts)
    # deleted relations of articles that are gone
    fewer = arts.where("law_id <> 11")
    own = {r.id for r in arts.where("law_id = 11").collect()}
    left, dropped = [r for r in after[3:] if not own & {r[1], r[2]}], [r for r in after[3:] if own & {r[1], r[2]}]
    assert dropped and maintained.refresh(root, rel(left), fewer, None, rel(dropped), arts) == "folded" and held(spark, root) == plain(spark, rel(left), fewer)
    assert maintained.refresh(root, rel([]), fewer, None, rel(left)) == "folded" and held(spark, root) == ({}, set())


def outcome(spark, ids, status):
    return spark.createDataFrame([(i, status, 2, 1, 1) for i in ids], "law_id long, status string, extracted int, saved int, unmatched int")


def test_leases_run_out_and_reports_count_once(spark, tmp_path):
    root = f"file://{tmp_path}/work"
    laws, arts = spark.createDataFrame([(i,) for i in range(6)], "id long"), articles_of(spark, 5)
    one, ids = worklog.lease(root, laws, arts, 3, "2026-01-01 00:00:00", 10)
    assert ids == [0, 1, 2]
    two, more = worklog.lease(root, laws, arts, 3, "2026-01-01 00:05:00", 10)
    assert more == [3, 4] and worklog.lease(root, laws, arts, 3, "2026-01-01 00:06:00", 10) == (None, [])  # 5 has no articles
    assert worklog.report(root, two, outcome(spark, more, "failed")) == 2
    assert worklog.report(root, two, outcome(spark, more, "failed")) == 0  # the same batch again
    marks = {r.law_id: (r.status, r.attempts) for r in worklog.read(spark, root, "marks").collect()}
    assert marks == {3: ("failed", 1), 4: ("failed", 1)}
    # the first lease has run out: its laws are given out again, and its late report counts for none of them
    three, again = worklog.lease(root, laws, arts, 2, "2026-01-01 00:11:00", 10)
    assert again == [0, 1] and worklog.report(root, one, outcome(spark, ids, "ok")) == 1
    assert {r.law_id for r in worklog.read(spark, root, "marks").where("status = 'ok'").collect()} == {2}
    assert worklog.report(root, three, outcome(spark, [0, 1, 4], "ok")) == 2


def test_work_ends_when_all_is_done_or_nothing_succeeds(spark, tmp_path):
    root = f"file://{tmp_path}/work"
    laws, arts = spark.createDataFrame([(i,) for i in range(4)], "id long"), articles_of(spark, 4)
    status = F.when(F.col("id") == 1, "failed").otherwise("ok")
    extract = lambda some: some.select(F.col("id").alias("law_id"), status.alias("status"))
    assert worklog.work(root, laws, arts, extract, n=2) == {"batches": 3, "ok": 3, "failed": 3}
    for _ in range(3):
        worklog.work(root, laws, arts, extract)
    marks = {r.law_id: (r.status, r.attempts) for r in worklog.read(spark, root, "marks").collect()}
    assert marks[1] == ("failed", worklog.ATTEMPTS) and {marks[i] for i in (0, 2, 3)} == {("ok", 1)}
    assert worklog.lease(root, laws, arts) == (None, [])


def test_steps_apply_as_a_whole_once_and_in_order(spark, tmp_path):
    root = f"file://{tmp_path}/lib"
    old = "id BIGINT, title STRING"
    buckets.publish(spark, root, "000000000000", {"laws": (spark.createDataFrame([(i, f"法（{2000 + i}年修订）") for i in range(20)], old), "id", set())})
    widen = migrations.Step(1, "quality and version columns", {"laws": (old, "id", lambda df: schema.migrate(df, schema.LAWS))})
    label = migrations.Step(2, "version labels", {"laws": (schema.LAWS, "id", lambda df: df.withColumn("version_label", F.regexp_extract("title", r"（(\d{4}年修订)）", 1)))})
    broken = migrations.Step(3, "broken", {"laws": (schema.LAWS, "id", lambda df: df.withColumn("title", F.raise_error(F.lit("no")).cast("string")))})
    assert migrations.version(spark, root) == 0 and migrations.migrate(spark, root, [widen, label]) == 2
    rows = buckets.read(spark, root, "laws", schema.LAWS).orderBy("id").collect()
    assert [r.version_label for r in rows] == [f"{2000 + i}年修订" for i in range(20)]
    done = buckets.snapshots(spark, root)
    assert migrations.migrate(spark, root, [widen, label]) == 2 and buckets.snapshots(spark, root) == done
    with pytest.raises(Exception, match="no"):
        migrations.migrate(spark, root, [widen, label, broken])
    assert migrations.version(spark, root) == 2 and buckets.read(spark, root, "laws", schema.LAWS).orderBy("id").collect() == rows
    assert [(r.version, r.name) for r in migrations.ledger(spark, root).orderBy("version").collect()] == [(1, "quality and version columns"), (2, "version labels")]
    with pytest.raises(ValueError):
        migrations.migrate(spark, root, [label, widen])
