"""SimHash near-duplicates and sentence spans against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import xxhash

from sparkfolio.llm import components, simhash, spans

SCHEMA = "doc_id long, text string, fp string"  # fp clashes with a made column


def brute_print(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Été", "日本", "A-Z", "É"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one two"), (5, "ONE\x0btwo"), (6, "x " * 70_000)]
    for i in range(10, 90):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 300)))))
    for i in range(90, 160):
        _, text = rows[rng.randrange(7, 87)]
        w = text.split(" ")
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_equal_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(docs, words=3).collect()}
    prints = {i: brute_print(t, 3) for i, t in rows}
    assert {i: v[0] % 2**64 for i, v in got.items()} == prints
    assert {i: v[1] for i, v in got.items()} == brute_components(prints)
    kept = {r.doc_id for r in simhash.keep_one(docs, words=3, similar=None).collect()}
    assert kept == set(brute_components(prints).values())


def test_covering_finds_every_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 300, dtype=np.int64)
    near = []
    for x in base[:150]:
        v = int(x) % 2**64
        for _ in range(4):
            y = v
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                y ^= 1 << int(b)
            near.append(y)
    every = sorted({int(x) % 2**64 for x in base} | set(near))
    signed = [v - 2**64 if v >= 2**63 else v for v in every]
    df = spark.createDataFrame([(f, n) for n, f in enumerate(signed)], "fp long, rep long")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.links(df).collect()}
    want = {(a, b) for a in range(len(every)) for b in range(a + 1, len(every)) if (every[a] ^ every[b]).bit_count() <= 3}
    assert got == want and want


def test_near_duplicates_of_odd_tables(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c", "x"), (7, "a b c", "x"), (7, "a b c", "x"), (None, "q r s t", "x")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == [(7, 7), (7, 7), (None, 7), (None, None)]
    more = [*rows, (None, "q r s t", "y"), (None, "u v w x y z", "x"), (8, None, "x"), (9, " ", "x")]
    for similar in (None, 0.8):
        docs = spark.createDataFrame(more, "doc_id long, text string, gone_id string")
        kept = simhash.keep_one(docs, similar=similar)
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(7, "a b c"), (8, None), (None, "q r s t"), (None, "u v w x y z")] and kept.columns == docs.columns


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(80)] + [(5, 5), (1, 0), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_spans(rows):
    """Cleaned texts by comparing whole runs of sentences, not hashes."""
    seen, found = {}, {}
    ordered = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: (r[0], r[1], xx(r[2])))
    for none, i, t in ordered:
        s = spans.sentences(t)
        low = [" ".join(t[b:e].lower().split()) for b, e, _ in s]
        ends = []
        for b in range(len(s)):
            e = b
            while e < len(s) and (e - b < spans.RUN_SENTENCES or sum(n for _, _, n in s[b:e]) < spans.RUN_WORDS):
                e += 1
            if e - b >= spans.RUN_SENTENCES and sum(n for _, _, n in s[b:e]) >= spans.RUN_WORDS:
                ends.append((b, e))
        if s and (not ends or ends[-1][1] < len(s)):
            b = len(s)
            while b and (len(s) - b < spans.RUN_SENTENCES or sum(n for _, _, n in s[b:]) < spans.RUN_WORDS):
                b -= 1
            ends.append((b, len(s)))
        bad = set()
        for b, e in ends:
            if tuple(low[b:e]) in seen:
                bad |= set(range(b, e))
            else:
                seen[tuple(low[b:e])] = (i, b)
        found[(none, i, t)] = bad
    return found


def xx(text):
    v = xxhash.xxh64_intdigest(text.encode(), 42)
    return v - 2**64 if v >= 2**63 else v


def test_spans_equal_brute_force(spark):
    rng = random.Random(11)
    sentence = lambda: " ".join(rng.choice("ab cd ef gh ij kl mn".split()) + str(rng.randrange(50)) for _ in range(rng.randrange(1, 30))) + rng.choice(".!?")
    passage = [" ".join(sentence() for _ in range(6)) for _ in range(3)]
    rows = [(i, " ".join(sentence() for _ in range(rng.randrange(1, 12)))) for i in range(40)]
    rows += [(i, f"{sentence()} {sentence()}\n{rng.choice(passage)}\n{sentence()}") for i in range(40, 80)]
    rows += [(80, None), (81, ""), (82, "Short."), (83, "Short."), (None, rows[0][1]), (84, "No! " * 3000), (85, rows[50][1]), (85, rows[50][1]), (86, "word " * 5000)]
    docs = spark.createDataFrame([(i, t, 7, 1, 2, 3) for i, t in rows], "doc_id long, text string, n_removed int, gone int, made int, row int")
    assert set(spans.remove_repeats(docs).columns) == {"doc_id", "text", "n_removed", "n_sentences", "gone", "made", "row"}
    got = defaultdict(list)
    for r in spans.remove_repeats(docs).collect():
        got[r.doc_id].append((r.text, r.n_sentences, r.n_removed))
    want = brute_spans(rows)
    for i, t in rows:
        bad = want[(i is None, i or 0, t)] if t is not None else set()
        n = len(spans.sentences(t))
        assert all(g[1:] == (n, len(bad)) for g in got[i]), (i, got[i], n, len(bad))
        if not bad:
            assert got[i][0][0] == t
    assert sum(map(len, got.values())) == len(rows)
    text = {i: g[0][0] for i, g in got.items()}
    assert text[82] == "Short." and text[83] == "" and text[None] == ""
    for p in passage:
        assert sum(p in (t or "") for t in text.values()) == 1
    assert len(text[86].split()) < 40 and text[86]


def test_pasted_passages_are_found_at_any_offset(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("bcdfgh") + rng.choice("aeiou") + str(rng.randrange(4000))
    rows, pasted = [], []
    for k, n in enumerate([51, 52, 55, 60, 70, 80, 100, 120] * 5):
        marks = k % 2
        passage = " ".join(word() + ("." if marks and rng.random() < 0.12 else "") for _ in range(n))
        for c in range(2):
            before, after = (" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(2))
            rows.append((2 * k + c, f"{before} {passage} {after}"))
        pasted.append(passage)
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, passage in enumerate(pasted):
        assert got[2 * k].n_removed == 0 and got[2 * k].text == rows[2 * k][1]
        lost = len(rows[2 * k + 1][1].split()) - len(got[2 * k + 1].text.split())
        assert 0.3 * len(passage.split()) <= lost <= len(passage.split()), (k, lost)


def test_spans_of_an_empty_table(spark):
    assert spans.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_set(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_similar_texts_equal_brute_force(spark):
    rng = random.Random(5)
    passage = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(60)]
    rows = [(0, None), (1, ""), (2, "one two")]
    for i in range(10, 40):  # unlike, but for a long passage in half of them
        rows.append((i, " ".join((passage if i % 2 else []) + [f"v{rng.randrange(5000)}" for _ in range(90)])))
    for i in range(40, 120):
        w = rows[rng.randrange(3, 33)][1].split(" ")
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"n{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    prints = {i: brute_print(t, 5) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    wide = 0
    for a in parent:
        for b in parent:
            if a < b:
                close = (prints[a] ^ prints[b]).bit_count() <= 3
                both = len(sets[a] | sets[b])
                if close or both and len(sets[a] & sets[b]) >= 0.8 * both:
                    wide += not close
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    assert wide > 20
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similar=0.8).collect()}
    assert got == {i: find(i) for i in parent}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(got.values())
    assert simhash.keep_one(docs.where("false")).count() == 0


def test_hub_links_all_its_satellites(spark):
    rng = random.Random(8)
    hub = [f"h{i}" for i in range(304)]
    rows = [(700, " ".join(hub)), (5000, " ".join(f"z{i}" for i in range(304)))]
    for i in range(1000):
        w = list(hub)
        at = rng.randrange(5)
        for k in range(6):  # 5 shingles each, so 270 of 330 are common with the hub
            w[at + 10 + 48 * k + rng.randrange(36)] = f"s{i}-{k}"
        rows.append((i + (i >= 700), " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert all(like(700, i) >= 0.8 for i in range(1001)) and sum(like(0, i) < 0.8 for i in range(1, 1001)) > 900
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, similar=0.8).collect()}
    assert got == {i: 0 if i <= 1000 else i for i, _ in rows}


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(2)
    common = np.unique(rng.integers(0, 2**64, 50, dtype=np.uint64))
    for n in (1, 2, 4, 5, 9, 10, 45, 300):
        for _ in range(40):
            whole = np.concatenate([common[: n // 3], rng.integers(0, 2**64, n - n // 3, dtype=np.uint64)])
            gone = rng.integers(0, n // 5 + 1)
            other = np.concatenate([rng.permutation(whole)[gone:], rng.integers(0, 2**64, rng.integers(0, n // 5 + 1), dtype=np.uint64)])
            a, b = np.unique(whole), np.unique(other)
            both = len(np.intersect1d(a, b))
            if both >= 0.8 * (len(a) + len(b) - both):
                x, y = (simhash.prefix(s, common, np.arange(len(common)) % 7 + 2, 0.8) for s in (a, b))
                assert len(np.intersect1d(x, y))
            differ = len(a) + len(b) - 2 * both
            assert sum(int(v).bit_count() for v in (simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)) <= differ
