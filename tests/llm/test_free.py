"""Personal data, token edits, chat windows and archives against brute force and round trips."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkfolio.llm import chat, pii, tokens, warc
from sparkfolio.llm.common import scratch

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_luhn(s):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(s))) % 10 == 0


def brute_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab.@-+_%019 ()é\n2.5@."), max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_base(text)


def test_base_spans_of_given_cases():
    for text in ["a@b.c@d.e f@g.h.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (415) 555-2671 +12", "x" * 200_000 + "@", "1" * 200_000, "+1" + "(" * 100_000, None]:
        assert pii.base_spans(text) == (brute_base(text) if text is None or len(text) < 1000 else [])


def brute_terms(rows, p):
    """Disclosing (entity, term) pairs by plain counting."""
    mentioned, together, documents, texts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, text in rows:
        spans = pii.base_spans(text)
        terms = {t for t, _, _ in pii.term_places(text or "", spans)}
        documents.update(terms)
        for e in pii.entities(text or "", spans):
            mentioned[e] += 1
            texts[e].add(text)
            for t in terms:
                together[e, t] += 1
                texts[e, t].add(text)
    n = len(rows)
    ic = {e: math.log(n / m) for e, m in mentioned.items()}
    return {(e, t) for (e, t), k in together.items() if len(texts[e, t]) > 1 and ic[e] > 0 and math.log(k * n / (documents[t] * mentioned[e])) >= p.alpha * ic[e]}


def test_disclosing_terms(spark):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["alpha", "bravo", "delta", "gamma", "omega", "sigma", "kappa", "theta", "lambda"]) for _ in range(n))
    rows = [(i, f"{filler(8)} Wendelin writes to w.k@mail.example.com {filler(9)} 王小明在 {filler(60)} Old WENDELIN. w_wendelin {filler(9)}") for i in range(6)]
    rows += [(i, f"{filler(20)} nothing here") for i in range(10, 60)]
    rows += [(60, None), (61, ""), (62, rows[0][1]), (62, rows[0][1]), (None, "call +1 (415) 555-2671"), (63, "x " * 150_000), (64, "Zenobia at 4111 1111 1111 1111"), (65, "Zenobia at 4111 1111 1111 1111")]
    rows += [(i, rows[1][1]) for i in range(70, 100)]  # copies weigh alike in all counts
    docs = spark.createDataFrame([(i, t, "n", 1, "m", "h", "v") for i, t in rows], "doc_id long, text string, key string, terms int, masked string, hit_key string, version string")
    p = pii.Disclosure()
    got = pii.digest_columns(pii.find_pii(docs, p)).collect()
    pairs = brute_terms(rows, p)
    found = {t for _, t in pairs}
    assert {"wendelin", "王小", "小明"} <= found and not found & {"alpha", "bravo", "nothing", "zenobia"}
    want = []
    for i, text in rows:
        base = brute_base(text)
        own = set(pii.entities(text or "", base))
        terms = sorted({(b, e) for t, b, e in pii.term_places(text or "", base) if any((x, t) in pairs for x in own)})
        c = Counter(k for k, _, _ in base)
        said = pii.as_text(base)
        every = ",".join(x for x in [said, pii.as_text([("term", b, e) for b, e in terms])] if x)
        want.append((i, c["email"], c["ip"], c["card"], c["phone"], hashlib.sha256(said.encode()).hexdigest(), every, len(terms)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = {r.doc_id: r for r in pii.sanitise(docs, p).collect()}
    assert "<EMAIL>" in clean[0].text and "<TERM>" in clean[0].text and "wendelin" not in clean[0].text.lower()
    assert clean[20].text == rows[16][1] and clean[60].text is None and clean[None].text == "call <PHONE>" and clean[64].text == "Zenobia at <CARD>"
    assert clean[0].terms == 1 and clean[0].masked == "m" and pii.sanitise(docs, p).columns == docs.columns and pii.sanitise(docs.limit(0), p).count() == 0


def full_count(text):
    return len(tokens.encoder().encode_ordinary(text))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcZ é日1 2.,'s\n\t  　_"), max_size=120), st.lists(st.tuples(st.integers(-3, 130), st.integers(-3, 130), st.text(alphabet=st.sampled_from("xy 9.\n'"), max_size=12)), max_size=5))
def test_edited_counts_equal_whole_encodings(text, edits):
    was, tokens.SEGMENT = tokens.SEGMENT, 8
    try:
        tree = tokens.TokenTree.of(text, full_count)
        assert tree.tokens == full_count(text) and tree.text() == text
        for b, e, new in edits:
            n = len(text)
            b = min(max(0, b), n)
            e = min(max(b, e), n)
            text = text[:b] + new + text[e:]
            tree.edit(b, e, new)
            assert tree.text() == text and tree.tokens == full_count(text) and tree.chars == len(text)
            texts, counts = zip(*tree.leaves(), strict=True)
            tree = tokens.TokenTree(list(texts), list(counts), full_count)  # as read from a table
    finally:
        tokens.SEGMENT = was


def test_count_edited(spark):
    rows = [(1, "Some words, more words. " * 400), (2, None), (3, ""), (4, "a" * 5000), (4, "a" * 5000), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    edits = spark.createDataFrame([(1, 1, 50, 60, "EDIT"), (1, 0, 0, 1, None), (3, 0, 0, 0, "new text"), (2, 0, 5, 9, "z"), (1, 2, None, None, "start ")], "doc_id long, nth int, begin int, end int, replacement string")
    got = sorted((tuple(r) for r in tokens.count_edited(tokens.with_edits(docs, edits)).collect()), key=str)
    first = rows[0][1][1:]
    first = "start " + first[:50] + "EDIT" + first[60:]
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:6] == (9600, full_count(rows[0][1]), 3, len(first), full_count(first)) and 0 < by_id[1][6] < 6000
    assert by_id[2][1:6] == (0, 0, 1, 1, 1) and by_id[3][4:6] == (8, full_count("new text")) and by_id[4][2:6] == (full_count("a" * 5000), 0, 5000, full_count("a" * 5000))
    assert tokens.count_edited(tokens.with_edits(docs.limit(0), edits)).count() == 0
    assert tokens.with_edits(docs.withColumn("edited", F.lit(1)), edits).columns == ["doc_id", "text", "n_tokens", "edited", "edits"]


def test_later_edits_go_to_stored_trees(spark):
    rows = [(i, f"Document {i} says some words, and some more. " * (20 * i)) for i in range(8)]
    trees = tokens.plant(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "text" not in trees.columns
    edit = lambda k: spark.createDataFrame([(3, 0, 100 * k, 100 * k + 30, f"new{k}"), (7, 0, 5000, 5000, " put in ")], "doc_id long, nth int, begin int, end int, replacement string")
    text = dict(rows)
    for k in (1, 2, 3):
        done = tokens.apply_edits(tokens.with_edits(trees, edit(k)))
        text[3] = text[3][: 100 * k] + f"new{k}" + text[3][100 * k + 30 :]
        text[7] = text[7][:5000] + " put in " + text[7][5000:]
        got = {r.doc_id: r for r in done.collect()}
        for i, t in text.items():
            assert (got[i].n_chars_after, got[i].n_tokens_after) == (len(t), full_count(t)), (k, i)
            assert (0 < got[i].n_encoded < 4000) == (i in (3, 7)) and "".join(got[i].tree.texts) == t
        trees = done.select("doc_id", "tree")


def brute_chat(turns):
    by = defaultdict(list)
    for c, n, r, t, *_ in turns:
        by[c].append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in v)
        loss = "".join(t for _, _, r, t in v if r == "assistant")
        out[c] = (len(v), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    rng = random.Random(8)
    odd = ["<|turn|>", "<|end|>\n", "\\", "\\<|body|>", "</s>[INST] ok [/INST]", "<<SYS>>", "", None, "<", "|end|>", "é日本 " * 50, "word " * 3000]
    turns = [(-1, 0, "user", odd[4]), (-1, 1, "assistant", odd[4])]
    for c in [*range(12), None]:
        if rng.random() < 0.5:
            turns.append((c, 0, "system", rng.choice(odd)))
        turns += [(c, i + 1, ("user", "assistant")[i % 2] if rng.random() < 0.9 else rng.choice(["tool", None, "system", "a<|body|>"]), rng.choice(odd)) for i in range(rng.randrange(1, 40))]
    turns += [(5, 3, "assistant", "tie"), (5, 3, "assistant", "tie"), (5, None, "user", "no turn")]
    rng.shuffle(turns)
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, window string")
    p = chat.Windows(budget=300, history_turns=3, history_tokens=100)
    windows = chat.format_windows(df, p).cache()
    got = {r.conv_id: r for r in chat.read_back(windows.orderBy(F.desc("window"))).collect()}
    assert sum(r.n_repeated for r in got.values()) == sum(w.n_repeated for w in windows.collect()) > 0
    assert {c: tuple(r)[1:5] for c, r in got.items()} == brute_chat(turns)
    every = windows.collect()
    assert sum(len(w.text) for w in every) == sum(r.formatted_chars for r in got.values())
    for w in every:
        parsed = chat.parse_window(w.text)
        cost = [full_count(r) + full_count(t) + chat.MARKS for r, t in parsed]
        assert sum(cost) <= p.budget or len(parsed) - w.n_repeated == 1
        assert len(parsed) > w.n_repeated and len(w.loss) == sum(r == "assistant" for r, _ in parsed[w.n_repeated :])
        body = w.text.replace(chat.TURN, "").replace(chat.BODY, "").replace(chat.END, "")
        assert not re.search(r"</?s>|\[/?INST\]|<</?SYS>>|<\|", body)
    systems = {c: min((n is not None, n or 0, r or "", t or "") for x, n, r, t in turns if x == c) for c in {t[0] for t in turns}}
    for w in every:
        if systems[w.conv_id][2] == "system" and w.window:
            assert chat.parse_window(w.text)[0] == ("system", systems[w.conv_id][3])
    assert any(w.n_repeated for w in every)
    assert chat.read_back(chat.format_windows(df.limit(0))).count() == 0


@given(st.text(alphabet=st.sampled_from("<|\\/s>[]INSTYend\n"), max_size=40))
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and not re.search(r"<\||</?s>|\[/?INST\]", chat.escape(text))


def test_archives_round_trip(spark):
    rows = [(i, f"http://{'abc'[i % 3]}.example.com/p/{i % 7}?Q={i}", f"<p>é {i % 5}</p>\r\n\r\nWARC/1.1\r\n" * (i % 4), 1000 - i) for i in range(40)]
    rows += [(50, None, None, 1), (51, "no scheme\r\nX: y", "", 2), (None, "http://n/", "lone", 3), (52, "http://n/", "lone", None), (52, "http://n/", "lone", 9), (-5, "http://HOT.com/", "z" * 500_000, 4)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, t long, archive string")
    pages = pages.selectExpr("page_id", "url", "html", "timestamp_seconds(t) as captured", "archive")
    for least in (0, 10):
        got = warc.archive_pages(pages, scratch(spark, "warc"), least).collect()
        last = {}
        for i, _, h, _ in rows:
            if i is not None:
                last[h or ""] = max(i, last.get(h or "", i))
        want = []
        for i, _, h, _ in rows:
            h = h or ""
            same = last.get(h) if len(h.encode()) >= least else i
            response = same is None or same == i
            want.append((i, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if response else "revisit", None if response else same))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    ordered = sorted(got, key=lambda r: (r.index_part, r.index_pos))
    keys = [warc.order((r.url_key, r.timestamp, r.page_id)) for r in ordered]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0), scratch(spark, "warc")).count() == 0


def test_merge_of_many_runs(spark):
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 7, 33):
        runs = [sorted((rng.randrange(50), n) for n in range(rng.randrange(0, 30))) for _ in range(k)]
        merged = list(warc.LoserTree([[((a,), b) for a, b in r] for r in runs]))
        assert [m[0][0] for m in merged] == sorted(a for r in runs for a, _ in r) and len(merged) == sum(map(len, runs))
    was, warc.MERGE_ROWS, size = warc.MERGE_ROWS, 20, warc.FILE_BYTES
    warc.FILE_BYTES = 7 * (warc.HEADER_BYTES + 3)
    try:
        pages = spark.range(200).selectExpr("id as page_id", "concat('http://h', cast(id % 3 as string), '.org/') as url", "cast(id as string) as html", "timestamp_seconds(500 - id) as captured")
        got = sorted(warc.archive_pages(pages.repartition(3), scratch(spark, "warc")).collect(), key=lambda r: (r.index_part, r.index_pos))
    finally:
        warc.MERGE_ROWS, warc.FILE_BYTES = was, size
    assert [(r.url_key, r.timestamp) for r in got] == sorted((r.url_key, r.timestamp) for r in got) and len(got) == 200
    assert len({r.index_part for r in got}) > 3 and len({r.archive for r in got}) > 10


def test_url_keys():
    assert warc.url_key("https://www.Example.com:80/A?b#c") == "com,example)/a?b#c"
    assert [warc.page_of(f"<urn:uuid:00000000-0000-4000-{v:016x}"[:-12] + f"-{v % 2**64:016x}"[5:] + ">") for v in (5,)] == [5]


def test_chat_query_makes_windows(spark):
    import sparkfolio.llm.queries as q

    got = q.op5_chat_windows(spark, "/root/testdata/sf0.001").collect()
    assert sum(r.n_windows > 1 for r in got) >= 10 and sum(r.n_repeated for r in got) >= 10
