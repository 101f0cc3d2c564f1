"""Progress sessions: late, missing and double endings."""

import json
from datetime import timedelta

from sparkfolio.streaming import progress


def run(spark, landing, mark, out):
    stream = progress.events(spark.readStream.text(f"file://{landing}"))
    found = progress.sessions(stream, silence=timedelta(seconds=60), keep=timedelta(seconds=600), late=timedelta(seconds=10))
    found.writeStream.format("parquet").option("checkpointLocation", f"file://{mark}").outputMode("append").trigger(availableNow=True).start(f"file://{out}").awaitTermination(180)
    return {(r.session, r.kind, r.type, r.stages) for r in spark.read.schema(progress.OUT).parquet(f"file://{out}").collect()}


def land(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps({"session": r[0], "type": r[1], "stage": "s", "ts": f"2026-01-01T00:{r[2] // 60:02d}:{r[2] % 60:02d}Z"}) for r in rows))


def test_sessions_end_once(spark, tmp_path):
    landing, mark, out = tmp_path / "landing", tmp_path / "mark", tmp_path / "out"
    land(landing, "a.json", ("a", "stage", 1), ("a", "stage", 2), ("a", "result", 3), ("a", "stage", 4), ("b", "stage", 1), ("c", "stage", 5), ("c", "error", 6), "no json", ("d", "unknown", 1), ("e", "cancelled", 2))
    first = run(spark, landing, mark, out)
    assert first == {("a", "closed", "result", 2), ("a", "refused", "stage", 2), ("c", "closed", "error", 1), ("e", "closed", "cancelled", 0)}
    # a second end is refused in a later batch; b has been silent by then, f goes on
    land(landing, "b.json", ("a", "result", 100), ("c", "cancelled", 101), ("f", "stage", 120))
    run(spark, landing, mark, out)
    land(landing, "c.json", ("f", "stage", 130), ("b", "result", 131))
    third = run(spark, landing, mark, out)
    assert third - first == {("a", "refused", "result", 2), ("c", "refused", "cancelled", 1), ("b", "silent", None, 1), ("b", "closed", "result", 1)}
    # long after, closed sessions are forgotten
    land(landing, "d.json", ("f", "stage", 1900))
    run(spark, landing, mark, out)
    land(landing, "e.json", ("a", "stage", 1901), ("a", "error", 1902), ("f", "stage", 1903))
    assert ("a", "closed", "error", 1) in run(spark, landing, mark, out)
