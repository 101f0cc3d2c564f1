"""The corpus pipeline, stage by stage and as a whole, against brute force over a small fixture."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_free import brute_base as pii_spans
from test_free import brute_terms
from test_native import WORD, brute_leaks, brute_targets
from test_native import brute_base as rules
from test_near_and_spans import brute_print, shingle_set

import corpus_pipeline
from sparkfolio.llm import pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken long, target string, m_id int, gone_id int, leak_key int, hit_key int, masked string, row int, kept boolean"
EXTRA = (9, "t", 1, 2, 3, 4, "m", 5, True)


def corpus():
    rng = random.Random(21)
    say = lambda n, k=600: [f"w{rng.randrange(k)}" for _ in range(n)]
    items = [(i, " ".join(f"b{i}-{j}" for j in range(16))) for i in range(4)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(say(rng.randrange(60, 200))), f"src{i % 4}" if i % 9 else None))
    for i in range(120, 150):  # near copies: one word in forty is another
        w = rows[rng.randrange(0, 60)][1].split(" ")
        for at in range(0, len(w), 60):
            w[at] = f"n{i}"
        rows.append((i, " ".join(w), "src0"))
    rows += [(150 + i, rows[5][1], "src1") for i in range(12)] + [(5, rows[5][1], rows[5][2])] * 2
    rows += [(170 + i, " ".join(say(70) + items[i % 4][1].split(" ") + say(20)), "src2") for i in range(8)]
    rows += [(180 + i, " ".join(f"Zw{rng.randrange(50)}###" for _ in range(90)), "src3") for i in range(30)]
    rows += [(220 + i, " ".join([*say(60), "Wendelin", f"writes{i}", *say(30), "w.k@mail.example.com", *say(20), "Wendelin", "+1 (415) 555-2671"]), "src1") for i in range(5)]
    rows += [(230, None, "src0"), (231, "", "src0"), (232, "short text", "src0"), (None, " ".join(say(80)), "src2"), (233, " ".join(say(80, 10**6)) + " q" * 4000, "src3"), (234, " ".join(f"u{i}" for i in range(3000)), "src3")]
    labels = [(i, 1, 0) for i in range(0, 110)] + [(180 + i, 0, 0) for i in range(15)] + [(3, None, None), (None, 1, 0)]
    return rows, items, labels


@pytest.fixture(scope="module")
def fixture_dir(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, items, labels = corpus()
    spark.createDataFrame([(i, t, "en", s, len(t) if t else None, *EXTRA) for i, t, s in rows], SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def keys(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def brute_quality(spark, rows, labels):
    p = quality.Quality()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").distinct()
    u = F.transform(quality.words(F.col("text")), lambda w: F.xxhash64(w))
    buckets = {(r.doc_id, r.text): (r.a, r.b) for r in df.select("doc_id", "text", quality.word_buckets(u, p).alias("a"), quality.pair_buckets(u, p).alias("b")).collect()}
    kinds = {r.doc_id: r.kind for r in quality.labelled(labels, p).collect()}
    import math

    raw, good = Counter(), Counter()
    for i, t, _ in rows:
        a, b = buckets[i, t]
        raw.update(a + b)
        if kinds.get(i) == "fit":
            good.update(a + b)
    n = p.words + p.pairs
    st, sr = sum(good.values()) + n, sum(raw.values()) + n
    ratio = lambda g: math.log((good[g] + 1) / st) - math.log((raw[g] + 1) / sr)
    scores = {k: (sum(map(ratio, a + b)) / max(1, len(a + b)), min(map(ratio, a), default=0.0)) for k, (a, b) in buckets.items()}
    base = {}
    for i, t, _ in rows:
        w, *_, repeated = rules(t)
        base[i, t] = w >= 50 and 100 * repeated <= 50 * w
    of = lambda kind: [v for k, v in scores.items() if kinds.get(k[0]) == kind and base[k]]
    least = quality.threshold([a for a, _ in of("held")], [a for a, _ in of("bad")], p.lost)
    worst = quality.threshold([b for a, b in of("held") if a >= least], [b for a, b in of("bad") if a >= least], p.lost)
    return [r for r in rows if base[r[0], r[1]] and scores[r[0], r[1]][0] >= least and scores[r[0], r[1]][1] >= worst]


def brute_dedup(rows):
    sets, prints = [shingle_set(t) for _, t, _ in rows], [brute_print(t, 5) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if (prints[a] ^ prints[b]).bit_count() <= 3 or both and len(sets[a] & sets[b]) >= 0.8 * both:
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for n, r in enumerate(rows):
        groups[find(n)].append(r)
    out = []
    for g in groups.values():
        ids = [r[0] for r in g if r[0] is not None]
        out += [next(r for r in g if r[0] == min(ids))] if ids else list({r[1]: r for r in g}.values())
    return out


def brute_private(rows):
    p = pii.Disclosure()
    pairs = brute_terms([(i, t) for i, t, _ in rows], p)
    out = []
    for i, text, s in rows:
        spans = pii_spans(text)
        own = set(pii.entities(text or "", spans))
        spans = spans + [("term", b, e) for t, b, e in pii.term_places(text or "", spans) if any((x, t) in pairs for x in own)]
        for kind, b, e in sorted(spans, key=lambda x: -x[1]):
            text = f"{text[:b]}<{kind.upper()}>{text[e:]}"
        out.append((i, text, s))
    return out


def test_stages_and_run_equal_brute_force(spark, fixture_dir):
    rows, items, labels = corpus()
    docs = spark.read.parquet(f"{fixture_dir}/documents.parquet")
    want = {
        "quality rules": lambda now: brute_quality(spark, now, spark.read.parquet(f"{fixture_dir}/labels.parquet")),
        "SimHash near-dedup": brute_dedup,
        "benchmark decontamination": lambda now: [r for r in now if not brute_leaks(r[1], items)[1]],
        "PII": brute_private,
    }
    now, df = rows, docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, fixture_dir).cache()
        now = want[name](now)
        assert df.columns == docs.columns, name
        assert keys(df) == sorted(now, key=str), name
        assert {(r.taken, r.target, r.m_id, r.gone_id, r.leak_key, r.hit_key, r.masked, r.row, r.kept) for r in df.collect()} == {EXTRA}
        sizes.append(len(now))
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert any("<TERM>" in t for _, t, _ in now) and all(r.n_chars == len(r.text) for r in df.collect())
    held = Counter()
    for _, t, s in now:
        held[s] += len(WORD.findall(t))
    targets, taken, seen = brute_targets(held), Counter(), Counter()
    texts = {(i, s): t for i, t, s in now}
    stream = corpus_pipeline.run(spark, fixture_dir).collect()
    for r in stream:
        taken[r.source] += r.n_words
        seen[r.doc_id, r.source] += r.n_words
        assert r.text in texts[r.doc_id, r.source] and len(WORD.findall(r.text)) == r.n_words
    assert all(abs(taken[s] - t) <= 1 for s, t in targets.items()) and set(seen) <= set(texts)
    assert all(n <= 2 * len(WORD.findall(texts[k])) for k, n in seen.items())


def test_empty_tables(spark, fixture_dir):
    none = spark.read.parquet(f"{fixture_dir}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, fixture_dir).count() == 0, name
