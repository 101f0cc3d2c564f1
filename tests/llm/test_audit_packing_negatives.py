"""Filter audit, packing and hard negatives against brute force."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import audit, negatives, packing

# --- filter audit -----------------------------------------------------------


def brute_audit(rows, labels):
    """Every order run over every document, one after the other."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    texts = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""].append(i)
    kinds = Counter()
    for i, text, part in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ""
        fails += "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t))
        fails += "D" * bool(re.search(r"[#$%&*|]", t)) + "E" * (i is not None and min(texts[t]) < i)
        kinds[part or "", fails, i in good, i in toxic] += 1
    removed_by, out = Counter(), []
    for part in {k[0] for k in kinds}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                c = Counter()
                for (p, fails, g, t), n in kinds.items():
                    if p != part:
                        continue
                    gone = any(f in fails for f in order[: step - 1])
                    if gone:
                        c["redundant"] += n * (x in fails)
                    elif x in fails:
                        c["removed"] += n
                        c["good"] += n * g
                        c["toxic"] += n * t
                    else:
                        c["kept"] += n
                    c["unique"] += n * (fails == x)
                removed_by[part, x] += c["removed"]
                out.append([part, order, step, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], x])
    return sorted(tuple(r[:-1]) + (removed_by[r[0], r[-1]],) for r in out)


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS mask", "2 AS part", "'x' AS `a.b`")
    found = audit.audit_filters(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return sorted(tuple(r) for r in found.collect())


def test_audit_equals_running_every_order(spark):
    rng = random.Random(1)
    words = ["a", "B", "c#", "dd", "EE", "f", "g", "h|", "i", "日本"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words[: rng.choice((2, 10))] + [str(rng.random())] * rng.choice((0, 30))) for _ in range(rng.choice((0, 5, 199, 200, 450))))
        rows += [(i, text, rng.choice(("en", "de", None)))] * rng.choice((1, 1, 1, 2))
    rows += [(100 + i, rows[0][1], "fr") for i in range(20)]  # copies of one text
    rows += [(None, rows[0][1], "fr"), (None, None, None), (None, "", "en"), (7, "x" * 200_000 + " Y" * 300, "en"), (5, "again", "de"), (5, "again", "fr"), (6, "again", "fr")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in range(0, 120, 2)] + [(0, 1, 0), (0, 0, 1), (None, 1, 1)]
    assert audited(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_no_documents_has_no_rows(spark):
    assert audited(spark, [], []) == []
    assert len(audited(spark, [(1, None, None)], [])) == 600


def test_survivors_are_the_zeta_transform(spark):
    rng = random.Random(2)
    counts = {m: rng.randrange(9) for m in range(8)}
    found = audit.survivors(spark.createDataFrame([("p", m, n, n, 0) for m, n in counts.items()], "part string, mask int, documents long, good long, toxic long"), 3).first()
    assert found["documents"] == [sum(n for m, n in counts.items() if m & s == 0) for s in range(8)]
    assert found["toxic"] == [0] * 8


# --- packing ----------------------------------------------------------------


def fewest(lengths, room):
    """The least number of bins, by trying all ways."""
    best = len(lengths)

    def put(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for r in sorted({b for b in bins if b >= lengths[i]}):
            rest = list(bins)
            rest.remove(r)
            put(i + 1, rest + [r - lengths[i]])
        put(i + 1, bins + [room - lengths[i]])

    put(0, [])
    return best


def covered(made, room):
    out = Counter()
    for often, held in made:
        assert often > 0 and sum(n * k for n, k in held.items()) <= room
        for n, k in held.items():
            out[n] += often * k
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 19), min_size=0, max_size=9))
def test_plan_covers_all_pieces_in_nearly_the_fewest_sequences(lengths):
    made, bound = packing.plan(Counter(lengths), 20)
    assert covered(made, 20) == Counter(lengths)
    sequences = sum(n for n, _ in made)
    if lengths:
        least = fewest(sorted(lengths, reverse=True), 20)
        assert bound <= least + 1e-6 and least <= sequences <= least + 1


def best_fit_decreasing(lengths, room):
    rest = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rest if r >= n]
        if fits:
            rest.remove(min(fits))
            rest.append(min(fits) - n)
        else:
            rest.append(room - n)
    return len(rest)


def test_plan_beats_best_fit_where_fillings_matter():
    rng = random.Random(3)
    for low, high, n in ((256, 512, 1500), (330, 420, 1500)):
        lengths = [rng.randrange(low, high) for _ in range(n)]
        made, bound = packing.plan(Counter(lengths), 1024)
        assert covered(made, 1024) == Counter(lengths)
        assert bound <= sum(k for k, _ in made) < best_fit_decreasing(lengths, 1024)


def test_prices_bound_fillings_from_below():
    # pieces of 6 of 10: one a sequence, which lengths alone don't show
    made, bound = packing.plan({6: 50}, 10)
    assert made == [(50, {6: 1})] and math.isclose(bound, 50)


tokenizer = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="the tokenizer's file isn't here")
ODD = ["", " ", "  a", "a \n b", "\n\n x", "it's  <|endoftext|> don't 'll  ", "中文 测试　全角 空格", "a b c  d", "x\x1c y \x1f z", "tab\t tab \t", "é ü ß — “q” … €", "naïve 123 ½ ² ٣", "a" * 5000, " " * 5000, "​ a", "😀 b"]


@tokenizer
def test_encoder_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    own, plain = packing.Encoder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    plain.encode_special_tokens = True
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x250)] + list("–’“…€  \n")
    made = ["".join(rng.choice(letters) for _ in range(200)) for _ in range(200)]
    for text in ODD + made:
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@tokenizer
def test_packed_documents_against_plain_cutting(spark):
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(packing.TOKENIZER), random.Random(5)
    plain.encode_special_tokens = True
    rows = [(i, " ".join(str(rng.random()) for _ in range(rng.randrange(12)))) for i in range(300)]
    rows += [(1, None), (None, None), (None, "a b"), (2, rows[2][1]), (2, rows[2][1]), (900, "word " * 3000)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000 + i, "same text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS part", "1 AS `a.b`").repartition(5)
    packed = packing.pack_documents(docs, room=64)
    got = packed.collect()
    want = []
    for i, text in rows:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        ends = list(range(len(ids) % 64 or 64, len(ids) + 1, 64)) if len(ids) > 64 else [len(ids)]
        want += [(i, n, begin, end - begin, tuple(ids[begin:end])) for n, (begin, end) in enumerate(zip([0, *ends], ends))]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], tuple(r["ids"])) for r in got) == Counter(want)
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == list(itertools.accumulate([0, *(n for _, n in pieces)]))[:-1] and sum(n for _, n in pieces) <= 64
    assert len(held) <= best_fit_decreasing([w[3] for w in want], 64)
    whole = packing.sequences(packed).collect()
    assert sorted(len(r["ids"]) for r in whole) == sorted(sum(n for _, n in p) for p in held.values())
    assert sum(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got) == sum(zlib.crc32(np.array(w[4], "<u4").tobytes()) for w in want)


@tokenizer
def test_ranks_joined_by_a_shuffle_are_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 40)) for i in range(200)], "doc_id long, text string").repartition(3, "doc_id")
    pieces = packing.tokenised(docs, 64, packing.TOKENIZER, 2)
    some = sorted(map(str, packing.placed(pieces, 64).collect()))
    monkeypatch.setattr(packing, "MOST_BROADCAST", 0)
    assert sorted(map(str, packing.placed(pieces, 64).collect())) == some


@tokenizer
def test_no_documents_make_no_sequences(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- hard negatives ---------------------------------------------------------


def brute_negatives(rows, every=10, k=5):
    fit = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)]
    q = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in fit]
    out = []
    for a in sorted({i for i, _, _ in q if i % every == 0}):
        _, label, v = min(r for r in q if r[0] == a)
        scored = [(sum(x * y for x, y in zip(v, w)), i, own == label) for i, own, w in q if i != a]
        for p_score, p, _ in sorted((r for r in scored if r[2]), key=lambda r: (-r[0], r[1]))[:k]:
            inside = sorted(((s, n) for s, n, same in scored if not same and 80 * p_score <= 100 * s <= 100 * p_score), key=lambda r: (-r[0], r[1]))[:k]
            out += [(a, p, rank, n, p_score, s) for rank, (s, n) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").selectExpr("*", "1 AS score", "2 AS nth", "3 AS `a.b`").repartition(3)
    return sorted(tuple(r) for r in negatives.mine_negatives(vectors, "vec_id % 10 = 0").collect())


def vectors_of(seed, n, dims=6, labels=3, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(0.5, spread) for _ in range(dims)]) for i in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    rows = vectors_of(6, 300)
    assert mined(spark, rows) == brute_negatives(rows)
    monkeypatch.setattr(negatives, "BLOCK", 7)  # several blocks, several digits
    monkeypatch.setattr(negatives, "BUCKETS", 16)
    monkeypatch.setattr(negatives, "SLICE", 11)
    assert mined(spark, rows) == brute_negatives(rows)


def test_ties_odd_rows_and_copies_of_one_vector(spark):
    rows = vectors_of(7, 60, spread=0.1)
    rows += [(1000 + i, i % 2, [0.5] * 6) for i in range(300)]  # one vector many times
    rows += [(None, 1, [1.0] * 6), (61, None, [1.0] * 6), (62, 1, None), (63, 1, [1.0, None] + [0.0] * 4), (64, 1, [float("nan")] + [0.0] * 5), (65, 2, [float("inf")] * 6), (66, 1, [1e30] * 6)]
    rows += [rows[3], rows[10], (20, 0, [9.0] * 6), (67, 1, []), (68, 0, [0.5] * 3), (69, 2, [0.5] * 9), (70, 5, [3.0] * 6), (-10, 0, [0.25] * 6)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and got


def test_large_components_are_exact(spark):
    rows = [(i, label, [x * 40000.0 for x in v]) for i, label, v in vectors_of(8, 120, dims=3, spread=0.3)]
    assert mined(spark, rows) == brute_negatives(rows)


def test_without_rows_or_anchors_nothing_is_mined(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0]), (2, 1, [1.0])]) == []
    assert mined(spark, [(10, 1, [1.0])]) == []
