"""Index, retrieval legs and their fusion.

Every leg gives scores (id, score) of all its candidates, and ranks from 0;
nothing is cut to k before fusion, since totals count every candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import segment
from ..functions import text as X
from ..functions import visibility as V
from ..functions.numerals import normalize_article_no
from ..sources.shared import numbered, stored
from . import grams

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
RRF_K = 60
EXACT_SCORE = 10.0
LEGS = ["segment", "keyword", "vector"]


def occurrences(units: DataFrame, tokens=X.tokens) -> DataFrame:
    """(term, id, dl) of every token of units (id, text); dl is the unit's number of tokens.

    ``tokens`` is a segmenter, or a function from a text column to an array column.
    """
    words = segment.words_of(units, tokens).select("id", F.size("w").cast("long").alias("dl"), F.explode_outer("w").alias("term"))
    return words.where("term is not null").select("term", "id", "dl")


def postings(units: DataFrame, tokens=X.tokens, ranged: bool = False, ranges: int | None = None) -> DataFrame:
    """(term, id, tf, dl) of units (id, text), counted with map-side combine per unit and term, or ``ranged`` by (term, id), into so many ``ranges`` if given, which leaves nothing to shuffle for who stores them so."""
    rows = occurrences(units, tokens)
    rows = rows.repartitionByRange(*([ranges] if ranges else []), "term", "id") if ranged else rows
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl"))


def of_terms(units: DataFrame, terms: list[str], tokens=X.tokens) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) as of an index, but with the given terms only, of all units: what a search of texts that aren't indexed needs, in one pass over them."""
    w = segment.words_of(units, tokens)
    found = stored(w.select("id", F.size("w").cast("long").alias("dl"), F.filter("w", lambda t: t.isin(terms)).alias("held")), "terms")
    rows = found.select("id", "dl", F.explode("held").alias("term"))
    stats = found.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return rows.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"), F.max("dl").alias("dl")), stored(stats, "terms-stats")


def corpus_stats(units: DataFrame, tokens=X.tokens) -> DataFrame:
    """One row (n, avgdl)."""
    return segment.words_of(units, tokens).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))


def missing_from_index(units: DataFrame, index: DataFrame) -> DataFrame:
    """Units that the index's units (id) don't name yet; its postings don't name those without words."""
    return units.join(index.select("id").distinct(), "id", "left_anti")


def idf_of(n, df):
    """A term's weight by the units that hold it; a common one keeps a small weight."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf > 0, idf).otherwise(F.lit(IDF_FLOOR))


def bm25(index: DataFrame, stats: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of the units that hold any of the terms. Only their postings are read; the one-row statistics are a scalar subquery."""
    hits = index.where(F.col("term").isin(terms)) if terms else index.where("false")
    n, avgdl = stats.select("n").scalar(), stats.select("avgdl").scalar()
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = idf_of(F.col("n"), F.col("df"))
    tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.join(F.broadcast(df), "term").withColumns({"n": n, "avgdl": avgdl}).groupBy("id").agg(F.sum(idf * tf).alias("score"))


#: Candidates of all legs that are numbered leg by leg; more are numbered by ranges.
MOST_NUMBERED = 1_000_000


def ranked(scores: list[tuple[str, DataFrame]], most: int = MOST_NUMBERED) -> tuple[DataFrame, dict[str, int]]:
    """((leg, id, rank), candidates by leg) of legs of scores (id, score): best first, then by id, in the vector leg the higher id first.

    Scores that agree to nine digits are equal. Ranks of all candidates are
    needed. Up to a number of them a leg is sorted by one task; more are
    numbered by ranges of (leg, score, id): however many share a score, they
    span several ranges.
    """
    every = None
    for name, rows in scores:
        tie = -F.col("id") if name == "vector" else F.col("id")
        rows = rows.select(F.lit(LEGS.index(name)).alias("leg"), (-F.round("score", 9)).alias("minus"), tie.alias("tie"), "id")
        every = rows if every is None else every.unionByName(rows)
    every = stored(every, "legs")
    held = {LEGS[r["leg"]]: r["n"] for r in every.groupBy("leg").agg(F.count(F.lit(1)).alias("n")).collect()}
    if sum(held.values()) <= most:
        place = F.row_number().over(W.partitionBy("leg").orderBy("minus", "tie"))
        return every.select("leg", "id", (place - 1).cast("long").alias("rank")), held
    dealt = numbered(every, "leg", "minus", "tie")
    first = dealt.groupBy("leg").agg(F.min("nth").alias("first"))  # as many rows as legs
    return dealt.join(F.broadcast(first), "leg").select("leg", "id", (F.col("nth") - F.col("first")).alias("rank")), held


def phrase_scores(units: DataFrame, phrases: list[str]) -> DataFrame:
    """BM25 of substrings: (id, score) of units (id, text) with any phrase of 3 characters or more; shorter ones are left out.

    Reads every text; ``grams.phrase_scores`` has the same scores from stored trigrams.
    """
    phrases = [p for p in phrases if len(p) >= 3]
    if not phrases:
        return units.where("false").select("id", F.lit(0.0).alias("score"))
    low, size = F.lower(F.coalesce("text", F.lit(""))), F.greatest(F.length("text") - 2, F.lit(0))
    counted = units.select("id", size.alias("dl"), *[((F.length(low) - F.length(F.replace(low, F.lit(p.lower())))) / len(p)).alias(f"tf{i}") for i, p in enumerate(phrases)])
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))])
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df, tf = F.col(f"df{i}"), F.col(f"tf{i}")
        score += idf_of(F.col("n"), df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    names = ["n", "avgdl", *[f"df{i}" for i in range(len(phrases))]]
    any_hit = F.greatest(*[F.col(f"tf{i}") for i in range(len(phrases))], F.lit(0.0)) > 0
    return counted.where(any_hit).withColumns({c: stats.select(c).scalar() for c in names}).select("id", score.alias("score"))


def keyword_scores(units: DataFrame, query: str) -> DataFrame:
    """(id, score): BM25 of the whole query, lifted above all scores of its single terms."""
    terms = X.split_terms(query)
    scores = phrase_scores(units, [query]).withColumn("score", F.col("score") + 1e6)
    if len(terms) > 1:
        scores = scores.unionByName(phrase_scores(units, terms))
    return scores.groupBy("id").agg(F.max("score").alias("score"))


def cosine(a, b):
    """Cosine of two vectors of equal size; 0 if sizes differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(F.lit(0.0))


def vector_scores(vectors: DataFrame, query: list[float]) -> DataFrame:
    """(id, score) of every vector."""
    q = F.array(*[F.lit(float(v)) for v in query])
    return vectors.where("embedding is not null").select("id", cosine(F.col("embedding"), q).alias("score"))


def like_scores(units: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of units with any term whatever its case; the score is the characters that removing exact occurrences takes away."""
    low = F.lower("text")
    any_hit = F.lit(False)
    score = F.lit(0)
    for t in terms:
        any_hit |= F.contains(low, F.lit(t.lower()))
        score += F.length("text") - F.length(F.replace(F.col("text"), F.lit(t)))
    return units.where(any_hit).select("id", score.cast("long").alias("score"))


def rrf(ranks: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (leg, id, rank): (id, score, reasons, first), one row per candidate; ties keep the first leg and rank that met them."""
    names = F.array(*[F.lit(n) for n in LEGS])
    return ranks.groupBy("id").agg(
        F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"),
        F.transform(F.array_sort(F.collect_set("leg")), lambda i: F.element_at(names, i + 1)).alias("reasons"),
        F.min(F.struct("leg", "rank")).alias("first"),
    )


def best_title(laws: DataFrame, title: str) -> DataFrame:
    """(law_id): the law of that title, else the one with the shortest title that holds it; null if there is none."""
    return laws.where(F.contains("title", F.lit(title))).select(F.min_by("id", F.struct(F.col("title") != title, F.length("title"), F.col("id"))).alias("law_id"))


def exact_hits(articles: DataFrame, laws: DataFrame, title: str, article_no: str) -> DataFrame:
    """(id): the article a query cites. The title is met exactly, else as part of the shortest title; then its number."""
    found = best_title(laws, title)
    wanted = articles.join(F.broadcast(found.where("law_id is not null")), "law_id").where(normalize_article_no(F.col("article_no")) == article_no)
    return wanted.select(F.min_by("id", F.struct(F.col("article_no") != article_no, "id")).alias("id")).where("id is not null")


def fuse(ranks: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """(id, score, match_type, reasons, order columns): fused candidates of (leg, id, rank), an exact hit first."""
    fused = rrf(ranks)
    exact_ids = exact if exact is not None else fused.where("false").select("id")
    both = fused.join(exact_ids.select("id", F.lit(True).alias("is_exact")), "id", "full")
    hit = F.coalesce("is_exact", F.lit(False))
    reasons = F.coalesce("reasons", F.array().cast("array<string>"))
    return both.select(
        "id",
        F.when(hit, F.lit(EXACT_SCORE)).otherwise(F.round("score", 6)).alias("score"),
        F.when(hit, "exact_article").otherwise("keyword").alias("match_type"),
        F.when(hit, F.concat(F.array(F.lit("exact_article")), reasons)).otherwise(reasons).alias("reasons"),
        F.struct((~hit).alias("later"), (-F.round(F.coalesce("score", F.lit(0.0)), 12)).alias("minus"), "first").alias("place"),
    )


def page(candidates: DataFrame, articles: DataFrame, laws: DataFrame, keep=None, number: int = 1, size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(page, total) of fused candidates whose law passes ``keep``.

    Filters go by the narrow columns. The page's rows, ``size`` at most, are
    looked up at once, so that texts are read by their ids, which reach the scan.
    """
    number, size = clamp_page(number, size)
    seen = laws.where(keep) if keep is not None else laws
    ids = candidates.join(articles.select("id", "law_id"), "id").join(seen.select(F.col("id").alias("law_id"), "title", "level", "status", "source_url"), "law_id")
    total = ids.agg(F.count(F.lit(1)).alias("total"))
    rows = ids.orderBy("place", "id").offset((number - 1) * size).limit(size)
    found = rows.collect()
    shown = articles.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(found)], T.StructType([T.StructField("nth", T.IntegerType()), *rows.schema]))
    texts = articles.select("id", "article_no", "text").where(F.col("id").isin([r["id"] for r in found]))
    return texts.join(F.broadcast(shown), "id").repartition(1).sortWithinPartitions("nth").drop("nth"), total


def clamp_page(number, size, most: int = 100, default: int = 10) -> tuple[int, int]:
    """Page from 1 and size from 1 to ``most``; what isn't a number gives the defaults."""
    try:
        number = max(1, int(number))
    except (TypeError, ValueError):
        number = 1
    try:
        size = min(most, max(1, int(size)))
    except (TypeError, ValueError):
        size = default
    return number, size


def safe_top_k(value, default: int = 8, most: int = 50) -> int:
    """A tool's number of results: what isn't a number gives the default, others are clamped."""
    try:
        return min(most, max(1, int(value)))
    except (TypeError, ValueError):
        return default


def search_topk(articles: DataFrame, laws: DataFrame, index: DataFrame, stats: DataFrame, query: str, k: int = 8, **more) -> DataFrame:
    """The first ``k`` results as one page."""
    return search(articles, laws, index, stats, query, number=1, size=safe_top_k(k), **more)[0]


def has_more(total: int, number: int, size: int, shown: int) -> bool:
    return (number - 1) * size + shown < total


def unified(articles: DataFrame, laws: DataFrame, index: DataFrame, stats: DataFrame, query: str, law_page: int = 1, article_page: int = 1, size: int = 10, phrases: tuple[DataFrame, DataFrame] | None = None, **filters) -> tuple[DataFrame, DataFrame | None]:
    """(laws, articles) that a query finds, each with its own page; without a query only the laws that pass the filters.

    Laws are found by articles that hold the query: with ``phrases``, the stored trigrams and their statistics, without reading a text.
    """
    from . import catalog

    seen = V.active() & V.law_filters(**filters)
    if not query.strip():
        return catalog.list_laws(laws, number=law_page, size=size, **filters)[0], None
    if phrases is not None and len(query) >= 3:
        matched = articles.select("id", "law_id").join(grams.hits(phrases[0], [query]).select("id"), "id").select("law_id")
    else:
        matched = articles.where(V.contains_ci(F.coalesce("text", F.lit("")), query)).select("law_id")
    found = catalog.list_laws(laws, number=law_page, size=size, q=query, matched=matched, **filters)[0]
    return found, search(articles, laws, index, stats, query, keep=seen, number=article_page, size=size, phrases=phrases)[0]


def search(
    articles: DataFrame, laws: DataFrame, index: DataFrame, stats: DataFrame, query: str, keep=None, vector: list[float] | None = None, number: int = 1, size: int = 10,
    phrases: tuple[DataFrame, DataFrame] | None = None, tokens=X.tokens,
) -> tuple[DataFrame, DataFrame, str]:
    """(page, total, mode) of a query: segment, keyword and vector legs, a cited article first.

    ``phrases`` are the stored trigrams and their statistics; without them the keyword
    leg reads all texts. ``tokens`` has to be what the index was cut by. Only if
    neither word leg has a candidate, texts are read for the query's terms. The
    mode is hybrid if the vector leg has candidates, else keyword.
    """
    spark = articles.sparkSession
    units = articles.select("id", F.concat_ws(" ", "article_no", "text").alias("text"))
    dictionary = isinstance(tokens, segment.Segmenter)
    asked = spark.sql("SELECT * FROM VALUES (:q) AS t(q)", args={"q": query})  # a local row: no job
    row = asked.select(parse(F.col("q")).alias("cited"), X.query_terms(F.col("q"), X.tokens if dictionary else tokens).alias("terms")).first()
    cited, terms = row["cited"], tokens.query_terms(query) if dictionary else row["terms"]
    scores = [("segment", bm25(index, stats, terms)), ("keyword", grams.keyword_scores(*phrases, query) if phrases is not None else keyword_scores(units, query))]
    if vector is not None:
        scores.append(("vector", vector_scores(articles, vector)))
    ranks, held = ranked(scores)
    if not held.keys() & {"segment", "keyword"}:
        ranks = ranks.unionByName(ranked([("keyword", like_scores(units, [t for t in X.split_terms(query) if t]))])[0])
    exact = exact_hits(articles, laws, cited["title"], cited["article_no"]) if cited else None
    shown, total = page(fuse(ranks, exact), articles, laws, keep, number, size)
    return shown.withColumn("snippet", X.snippet(F.col("text"), terms)), total, "hybrid" if "vector" in held else "keyword"


def parse(query):
    from ..functions.numerals import parse_citation

    return parse_citation(query)


def backfill_embeddings(articles: DataFrame, embed, batch: int = 64, chars: int = 3000) -> DataFrame:
    """(id, embedding, error) of articles without one; a batch whose call fails gives its error and is left for the next run."""

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), batch):
                some = frame.iloc[at : at + batch]
                try:
                    vectors = embed([t[:chars] for t in some["text"].fillna("")])
                except Exception as e:  # whatever the injected function raises
                    yield some[["id"]].assign(embedding=None, error=f"{type(e).__name__}: {e}"[:200])
                    continue
                yield some[["id"]].assign(embedding=list(vectors), error=None)

    return articles.where("embedding is null").select("id", "text").mapInPandas(run, "id long, embedding array<float>, error string")


def offline_search(units: DataFrame, query: str, title: str = "title") -> DataFrame:
    """Units (id, law_id, title, text) that hold every term in title or text: count in text and three times that in title, best first."""
    terms = [t.lower() for t in query.split()]
    text, name = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    count = lambda c, t: (F.length(c) - F.length(F.replace(c, F.lit(t)))) / len(t)
    test, score = F.lit(bool(terms)), F.lit(0.0)
    for t in terms:
        test &= F.contains(text, F.lit(t)) | F.contains(name, F.lit(t))
        score += count(text, t) + 3 * count(name, t)
    return units.where(test).select("id", "law_id", score.cast("long").alias("score"))
