"""What the fourth round's review found."""

import difflib
import random

import duckdb
from pyspark.sql import functions as F

from sparkfolio.operators import citations, governance
from sparkfolio.plans import catalogue


def test_units_without_words_are_not_missing(spark, tmp_path):
    rows = [
        (1, "en", "some words"), (2, "en", "--- !"), (3, "en", ""), (4, "en", None), (5, "de", "Wort"), (6, "de", ""), (7, "fr", None), (8, None, "words"),
        (9, "en", "one"), (9, "de", "eins"), (10, "de", "zwei"), (10, "de", "zwei"), (None, "en", "none"), (None, "de", "keins"), (None, None, None), (11, "", "x"),
    ]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.queries()["index_missing_units"](spark, str(tmp_path))
    wanted = duckdb.sql(catalogue.oracle_sql()["index_missing_units"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert made.columns == ["id"] and sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, wanted)) and len(wanted) == 8


def test_line_items_move_twice_at_most_to_become_chips(spark, tmp_path):
    """Marks and citations are dealt to tasks by their order, as narrow rows, and by nothing else; odd rows give what the SQL gives."""
    lines = [(o, s, n, f) for o in (1, 2, None) for s in (10, 11, 12, 13, 14, 10) for n, f in ((1, "N"), (2, "A"), (1, "R"), (3, None), (None, "N"))][::2] + [(3, 99, 1, "N"), (4, None, 1, "N"), (5, 12, None, "N"), (5, 15, 1, "A"), (5, 12, 1, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None), (14, 3), (14, 2), (15, 2), (None, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    made = catalogue.queries()["citation_chips"](spark, str(tmp_path))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    sql = catalogue.oracle_sql()["citation_chips"]
    for t in ("lineitem", "supplier"):
        sql = sql.replace(f"FROM {t} ", f"FROM '{tmp_path}/{t}.parquet/*.parquet' ").replace(f"JOIN {t} ", f"JOIN '{tmp_path}/{t}.parquet/*.parquet' ")
    wanted = duckdb.sql(sql).fetchall()
    found = sorted(map(str, map(tuple, made.collect())))
    assert made.columns == ["id", "nth", "law_id", "article_id"] and found == sorted(map(str, wanted)) and sum(r[2] is not None for r in wanted) > 5


def test_a_citation_without_number_has_the_title_too(spark):
    """A title that meets a citation of its answer isn't looked for without years, also if that citation says no number."""
    cited = [(1, "证券法", None, None, 10, 101), (1, "证券法（2019年修订）", None, "第一条", 11, 111), (2, "证券法（2019年修订）", None, "第一条", 11, 111)]
    marks = [(1, 1, "证券法", "第1条"), (2, 1, "证券法", "第1条"), (2, 2, "证券法", None)]
    got = citations.chips(
        spark.createDataFrame(marks, "id long, nth long, title string, no string"), spark.createDataFrame(cited, "id long, title string, ref_title string, no string, law_id long, article_id long")
    )
    assert {(r.id, r.nth): r.article_id for r in got.collect()} == {(1, 1): None, (2, 1): 111, (2, 2): None}


def test_long_texts_are_compared_to_their_ends(spark):
    """Equal beginnings of 20,000 characters don't make two texts similar, nor do other ones keep them from it."""
    rng = random.Random(7)
    some = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    base = some(40_000)
    texts = [base + "尾", base[:20_000] + some(20_000), some(1_500) + base[1_500:], base[:-2_500], base[:-5_000]]
    laws = spark.createDataFrame([(i, "同名法", "s", t) for i, t in enumerate(texts)], "id long, title string, source_name string, full_text string").withColumn("content_hash", F.md5("full_text"))
    laws = laws.withColumns({c: F.lit(None).cast("long") for c in ("duplicate_of", "superseded_by")}).withColumn("quality_flag", F.lit(None).cast("string"))
    want = {i: difflib.SequenceMatcher(None, t, texts[0]).ratio() for i, t in enumerate(texts) if i}
    got = {r.id: r.similarity for r in governance.duplicates(laws).collect()}
    assert got == {i: x for i, x in want.items() if x >= governance.SIMILAR} and set(got) == {2, 3}


def test_runs_are_looked_up_as_difflib_finds_them(monkeypatch):
    """Of texts most of whose characters are too common for difflib, blocks are found without meeting all places of the others; they are difflib's."""
    rng = random.Random(5)
    for rare in (0.02, 0.1, 0.3):
        some = lambda n: "".join(rng.choice("0123456789" if rng.random() < 0.2 else "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉") if rng.random() < rare else rng.choice("etaoin shrdlu") for _ in range(n))  # noqa: E731, B023
        b = some(3000)
        a = b[:300] + some(9) + b[300:900] + b[950:1200] + b[100:110] + b[1200:]
        matcher = difflib.SequenceMatcher(None, a, b)
        stretches = [sorted(rng.randrange(len(t) + 1) for _ in range(2)) for _ in range(100) for t in (a, b)]
        want = [tuple(matcher.find_longest_match(*x, *y)) for x, y in zip(stretches[::2], stretches[1::2], strict=True)]
        share = matcher.ratio()
        with monkeypatch.context() as m:
            m.delattr(difflib.SequenceMatcher, "find_longest_match")
            find = governance.longest_match(a, b)
            assert [find(*x, *y) for x, y in zip(stretches[::2], stretches[1::2], strict=True)] == want
            assert governance.ratio(a, b) == (share if share >= governance.SIMILAR else None)
            assert governance.ratio(a, a[:-1] + "甲") >= 0.99
