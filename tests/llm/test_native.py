"""Quality rules, mixing, decontamination and URL filters against brute force."""

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import functions as F

from sparkfolio.llm import decontaminate, mixing, quality, urls
from sparkfolio.llm.common import cut

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, rows, more="kept int, w string"):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], f"doc_id long, text string, source string, {more}")


PROSE = "the river ran on past the old mill and nobody in town could say how long it had stood there " * 4
TEXTS = [
    (1, PROSE + "first one ended here", "b"),
    (2, PROSE.upper() + "!!", "b"),
    (3, None, "a"),
    (4, "", None),
    (5, "a b c " * 7000, "c"),
    (6, "x\ny\nx\n \n\ny\nz # $ % <> | &", "ä"),
    (7, " ".join(f"word{i}" for i in range(120)), None),
    (7, " ".join(f"word{i}" for i in range(120)), None),
    (8, "\x0b\x0c one\u00a0two \u2028three", "a"),
    (9, "y y y y y", "empty"),
]


def brute_base(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_base_rules(spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, None), (2, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge_quality(docs_of(spark, TEXTS), labels).collect()
    assert sorted(r.doc_id for r in got) == sorted(t[0] for t in TEXTS)
    by_id = {t[0]: t[1] for t in TEXTS}
    for r in got:
        want = brute_base(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


def test_filters_on_verdicts_stay_linear(spark):
    """A later filter must not be pushed into the operator's lambdas."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plan = quality.judge_quality(docs_of(spark, TEXTS), labels).where("kept and n_repeat_words < 9")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate")


def test_long_text_of_different_words_repeats_nothing(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long").selectExpr("doc_id", "array_join(transform(sequence(1, 700000), i -> cast(i as string)), ' ') as text")
    more = docs.selectExpr("doc_id + 1 as doc_id", "concat(text, ' 5 6 7') as text")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality.judge_quality(docs.union(more), labels).collect()}
    assert got == {1: (700_000, 0), 2: (700_003, 6)}


def test_log_ratio(spark):
    good = [(i, " ".join(f"g{(i * 7 + j) % 100}" for j in range(80)), "s") for i in range(60)]
    bad = [(100 + i, " ".join(f"JUNK{(i * 3 + j * j) % 60}!!" for j in range(80)), "s") for i in range(20)]
    slur = [(200 + i, " ".join(f"g{(i * 7 + j) % 100}" for j in range(79)) + " SLUR", "s") for i in range(12)]
    said = [(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(8)] + [(200 + i, 1, 1) for i in range(5)] + [(3, 1, None), (None, 0, 1)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    docs = docs_of(spark, good + bad + slur)
    p = quality.Quality(words=4096, pairs=1024)
    kinds = {r.doc_id: r.kind for r in quality.labelled(labels, p).collect()}
    assert {k for k, v in kinds.items() if v == "bad"} == {*range(100, 108), *range(200, 205)} and {kinds[i] for i in range(40)} == {"fit", "held"}
    ratios = quality.log_ratios(docs, quality.labelled(labels, p), p)
    u = F.transform(quality.words(F.col("text")), lambda w: F.xxhash64(w))
    one = {r.doc_id: r.g for r in docs.select("doc_id", quality.word_buckets(u, p).alias("g")).collect()}
    two = {r.doc_id: r.g for r in docs.select("doc_id", quality.pair_buckets(u, p).alias("g")).collect()}
    hashed = {i: one[i] + two[i] for i in one}
    raw, trusted = Counter(g for v in hashed.values() for g in v), Counter(g for i, k in kinds.items() if k == "fit" for g in hashed[i])
    n = p.words + p.pairs
    sr, st = sum(raw.values()) + n, sum(trusted.values()) + n
    for b in range(n):
        assert math.isclose(ratios[b], math.log((trusted[b] + 1) / st) - math.log((raw[b] + 1) / sr), abs_tol=1e-9)
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels, p).collect()}
    for i, v in hashed.items():
        assert math.isclose(got[i].score, sum(ratios[g] for g in v) / len(v), rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(got[i].worst_word, min(ratios[g] for g in one[i]), rel_tol=1e-6)
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in [*range(100, 120), *range(200, 212)])


def test_thresholds():
    assert quality.threshold([], [1.0], 0.1) == -math.inf and quality.threshold([1.0], [], 0.1) == -math.inf
    assert quality.threshold([1.0, 2.0, 3.0], [-1.0, 0.0], 0.0) == 0.5 and quality.threshold([1.0, 2.0], [5.0], 0.0) == -math.inf
    assert quality.threshold([float(i) for i in range(10)], [0.5, 1.5, 8.5], 0.2) == 1.75


def test_quality_of_an_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.judge_quality(docs_of(spark, TEXTS).limit(0), labels).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        left = budget - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in above}


def test_mixing(spark):
    rows = TEXTS + [(100 + i, "w " * (i % 50), ("hot", "hot", "b", None, "tiny")[i % 5] if i else "tiny") for i in range(400)]
    rows += [(77, "same row again", "hot")] * 9000  # more copies than one portion
    got = mixing.mix_documents(docs_of(spark, rows)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    targets = brute_targets(sizes)
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1, (s, taken[s], t)
    key = lambda r: (r.doc_id, r.size, r.taken)
    again = mixing.mix_documents(docs_of(spark, rows[::-1]).repartition(3)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_stream(spark):
    rows = [r for r in TEXTS if r[0] != 5] + [(100 + i, f" w{i} \n" + "x y  " * (i % 50), ("hot", "hot", "b", None, "tiny")[i % 5]) for i in range(200)]
    rows += [(None, f"no id {i % 7}", "hot") for i in range(90)] + [(999, "z " * 3000, "b")]
    docs = docs_of(spark, rows, "slot int, unit string").withColumn("pieces", F.lit(3))
    mix = mixing.Mix(block_words=16)
    taken = Counter()
    for r in mixing.mix_documents(docs, mix).collect():
        taken[r.doc_id, r.source] += r.taken
    stream = sorted(mixing.mixed_stream(docs, mix).collect(), key=lambda r: (r.slot, r.place))
    assert set(stream[0].asDict()) == set(docs.columns) | {"epoch", "place", "n_words"} and {r.pieces for r in stream} == {3}
    texts = {}
    for i, t, s in rows:
        texts.setdefault((i, s), []).append(t or "")
    said, slots = Counter(), {}
    for r in stream:
        said[r.doc_id, r.source] += r.n_words
        assert len(WORD.findall(r.text)) == r.n_words and any(r.text in t for t in texts[r.doc_id, r.source])
        slots.setdefault(r.slot, []).append(r)
    assert said == +taken
    for rows_ in slots.values():
        assert len({(r.source, r.epoch) for r in rows_}) == 1 and sum(r.n_words for r in rows_) <= 16
        assert all(a.place + a.n_words == b.place for a, b in zip(rows_, rows_[1:], strict=False))
    order = [v[0].source for _, v in sorted(slots.items())]
    share = Counter(order)
    for s, n in share.items():  # every source's slots are spread evenly over the sequence
        half = order[: len(order) // 2].count(s)
        assert abs(half - n / 2) <= 3, (s, half, n)
    assert mixing.mixed_stream(docs.limit(0)).count() == 0


def test_schedule_is_even(spark):
    rows = [(i, "w " * 40, "abc"[i % 3]) for i in range(300)]
    plan = cut(mixing.source_plan(mixing.units(docs_of(spark, rows)), mixing.Mix(block_words=4)))
    slots = sorted(mixing.schedule(plan).collect(), key=lambda r: r.slot)
    share = {r.source: r.n_slots / len(slots) for r in plan.collect()}
    seen = Counter()
    for n, r in enumerate(slots, 1):
        assert r["rank"] == seen[r.source]
        seen[r.source] += 1
        assert abs(seen[r.source] - n * share[r.source]) < 8
    f, g = mixing.golden_lattice(1000)
    assert sorted(k * f % g for k in range(g)) == list(range(g))


def test_mixing_of_empty_tables(spark):
    assert mixing.mix_documents(docs_of(spark, TEXTS).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix_documents(docs_of(spark, [(1, None, None), (2, " ", "a")])).collect()] == [0, 0]


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_leaks(text, items):
    w, inside, found = norm(text), set(), set()
    for item, t in items:
        v = norm(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            g = v[i : i + 10]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    inside |= set(range(j, j + len(g)))
                    found.add(str(item) if item is not None else "")
    return len(w), len(inside), sorted(found)


def test_decontamination(spark):
    item = " ".join(f"t{i}" for i in range(14))
    items = [(10, item), (9, item), (2, "Short, ITEM é"), (3, None), (4, "..."), (None, "lone word here now"), (5, "ab"), (6, "one two"), (7, " ".join(f"t{i}" for i in range(10)))]
    texts = [
        (1, "before " + item + " after"),
        (2, "t0 t1 t2 t3 t4 t5 t6 t7 t8"),
        (3, "A short; item É! but short item é yes, t3.T4-t5 " + " ".join(f"t{i}" for i in range(6, 14))),
        (4, None),
        (5, ""),
        (6, "ab"),
        (7, "x one_two ab. LONE word here now"),
        (8, "one two " * 3000),
        (9, "no hits at all in this text"),
        (9, "no hits at all in this text"),
        (10, item + " " + item),
        (None, item),
    ]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs, bench).withColumn("n", decontaminate.covered(F.col("hits"))).collect()}
    for i, t in texts:
        assert (got[i].n_words, got[i].n, got[i].item_ids) == brute_leaks(t, items), i
        assert got[i].copies == (2 if i == 9 else 1)
    clean = decontaminate.clean_documents(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [2, 4, 5, 9, 9] and clean.columns == docs.columns
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = decontaminate.find_leaks(docs, bench, most=0)
        assert "Broadcast" not in shuffled._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id: (r.n_words, r.copies, r.hits, r.item_ids) for r in shuffled.collect()} == {i: (r.n_words, r.copies, r.hits, r.item_ids) for i, r in got.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    odd = docs.withColumns({"leak_key": F.lit(1), "row": F.lit("r"), "key": F.lit(2)})
    assert decontaminate.clean_documents(odd, bench).columns == odd.columns
    none = decontaminate.find_leaks(docs, bench.limit(0)).collect()
    assert len(none) == 11 and not any(r.hits for r in none)
    assert decontaminate.find_leaks(docs.limit(0), bench).count() == 0


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.b", "", "allow"), ("a.b", "", "block"), (None, "/x", "block"), ("tie.io", "/q", "odd")]
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/71?x#y", "http://example.com/en/6", "http://xexample.com/en/7", "http://com/en/", "http://org/es", "http://org/es/",
    "http://É.Example.net/de/8/é", "http://a.b", "http://z.a.b#f", "http://x.tie.io/q/1", "a://b://c.com/en/1", "http://h.com/en/" + "p" * 50000, "http://" + "l." * 20000 + "net/de/1", "http://new\nline.com/en/\n?q",
]


def brute_verdict(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v != "allow", h + p) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits)
    return host, path, best[3], "block" if best[2] else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS + URLS[4:6])], "page_id long, url string, rule string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(URLS + URLS[4:6])}
    assert {r.verdict for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert urls.judge_urls(pages.limit(0), rules).count() == 0


def test_items_digest_is_of_sorted_strings(spark):
    import sparkfolio.llm.queries as q

    row = q.op8_decontaminate(spark, "/root/testdata/sf0.001").where("n_items = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest()
