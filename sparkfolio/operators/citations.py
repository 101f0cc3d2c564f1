"""Citations in answers: extraction, and joins with laws and articles in order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import titles as T
from ..functions import visibility as V
from ..functions.numerals import ARTICLE_NO, let, normalize_article_no
from ..sources.shared import stored

BLOCK = "【([^】]+)】"


def extract(text: Column) -> Column:
    """(title, raw_no) of every citation 【title·第N条、第M条；title·全文】 in order, repeated numbers of an item once."""
    items = F.flatten(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(BLOCK), F.lit(1)), lambda b: F.split(b, "[；;]")))
    shape = r"(?s)^(.+?)·(.+)$"

    def named(x: Column) -> Column:
        numbers = F.when(F.startswith(x["rest"], F.lit("全文")), F.array(F.lit("全文"))).otherwise(F.array_distinct(F.regexp_extract_all(x["rest"], F.lit(ARTICLE_NO), F.lit(0))))
        return F.transform(numbers, lambda n: F.struct(x["title"].alias("title"), n.alias("raw_no")))

    def one(trimmed: Column) -> Column:
        parts = F.struct(T.strip(F.regexp_extract(trimmed, shape, 1)).alias("title"), T.strip(F.regexp_extract(trimmed, shape, 2)).alias("rest"))
        return F.when(trimmed.rlike(shape), let(parts, named)).otherwise(F.array().cast("array<struct<title:string,raw_no:string>>"))

    return F.flatten(F.transform(items, lambda item: let(T.strip(item), one)))


def citations(answers: DataFrame, text: str = "text") -> DataFrame:
    """(id, nth, title, raw_no, article_no) of the answers' citations.

    Answers are dealt to tasks by their id first, since patterns take far
    longer than reading: a small file would be one task's work.
    """
    n = int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = answers.select("id", F.col(text).alias(text)).repartition(n, "id")
    return answers.select("id", F.posexplode_outer(extract(F.col(text))).alias("nth", "c")).where("c is not null").select("id", "nth", "c.title", "c.raw_no", normalize_article_no(F.col("c.raw_no")).alias("article_no"))


#: Characters of the grams by which parts are looked up.
GRAM = 4


def _grams(text: Column, n: Column) -> Column:
    """A text's different grams of n characters."""
    size = F.length(text)
    places = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    return F.when((size >= n) & (n > 0), F.array_distinct(F.transform(places, lambda i: F.substring(text, i, n)))).otherwise(F.array().cast("array<string>"))


def candidates(parts: DataFrame, part: str, names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """(low, ...) pairs of different lower-cased parts with the rows of ``names`` that hold the part's rarest gram.

    Every gram of a contained part is in the name, so any one of them finds it;
    the one that the fewest names hold finds the fewest others. A part with a
    gram that no name holds has no candidate. Parts below GRAM characters are
    one gram; ``least`` says how short parts are, so that names needn't be
    spread by shorter grams.
    """
    sizes = range(min(least, GRAM), GRAM + 1)
    spread = names.withColumn("gram", F.explode(F.concat(*[_grams(F.lower(F.col(name)), F.lit(n)) for n in sizes])))
    held = spread.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    low = parts.select(F.lower(part).alias("low")).where(F.length("low") >= least).distinct()
    own = low.select("low", F.explode(_grams(F.col("low"), F.least(F.length("low"), F.lit(GRAM)))).alias("gram"))
    rarest = own.join(held, "gram", "left").groupBy("low").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r"))
    return rarest.where("r.df > 0").select("low", F.col("r.gram").alias("gram")).join(spread, "gram").drop("gram")


def containing(parts: DataFrame, part: str, names: DataFrame, name: str, least: int = 1) -> DataFrame:
    """Rows of ``parts`` joined with those of ``names`` whose name contains the part, whatever the case: candidates, then the whole part is compared."""
    found = candidates(parts, part, names, name, least).where(F.contains(F.lower(F.col(name)), F.col("low")))
    return parts.withColumn("low", F.lower(part)).join(found, "low").drop("low")


def match_titles(cited: DataFrame, laws: DataFrame, variants=T.title_variants, keys=T.fuzzy_keys, guard=T.match_ok) -> DataFrame:
    """(title, law_id): the law each different title means.

    Exact names come first, in the order of the title's variants, each also
    with and without the country's name: an equi-join. Titles that found none
    are looked for as parts of laws' names, the best key and the shortest name
    first.
    """
    names = cited.select("title").distinct()
    seen = laws.where(V.indexable()).select(F.col("id").alias("law_id"), F.col("title").alias("law_title"))
    forms = names.select("title", F.posexplode(variants(F.col("title"))).alias("p", "v"))
    with_country = F.array(F.col("v"), F.concat(F.lit(T.COUNTRY), F.col("v")), F.when(F.startswith("v", F.lit(T.COUNTRY)), F.expr(f"substring(v, {len(T.COUNTRY) + 1})")))
    forms = forms.select("title", "p", F.posexplode(F.array_compact(with_country)).alias("q", "law_title"))
    best = F.min_by("law_id", F.struct("p", "q", "law_id"))
    exact = forms.join(seen, "law_title").where(guard(F.col("title"), F.col("law_title"))).groupBy("title").agg(best.alias("law_id"))
    left = names.join(exact, "title", "left_anti")
    parts = left.select("title", F.posexplode(variants(F.col("title"))).alias("p", "v")).where(F.length("v") >= 4)
    parts = parts.select("title", "p", F.posexplode(keys(F.col("v"))).alias("q", "key")).where(F.length("key") >= 4)
    found = containing(parts, "key", seen, "law_title", least=4).where(guard(F.col("title"), F.col("law_title")))
    fuzzy = found.groupBy("title").agg(F.min_by("law_id", F.struct("p", "q", F.length("law_title"), "law_id")).alias("law_id"))
    return exact.unionByName(fuzzy)


def resolve(answers: DataFrame, laws: DataFrame, articles: DataFrame, text: str = "text") -> DataFrame:
    """(id, nth, ref_title, ref_no, article_no, law_id, article_id), each (title, number) of an answer once; unmatched ones stay with nulls.

    Answers are read once, though their titles are looked up in several ways: what they cite is stored.
    """
    first = stored(citations(answers, text).groupBy("id", "title", "article_no").agg(F.min("nth").alias("nth"), F.min_by("raw_no", "nth").alias("ref_no")), "cited")
    matched = first.join(match_titles(first, laws), "title", "left")
    own = articles.select("law_id", F.col("id").alias("a_id"), F.col("article_no").alias("raw"), normalize_article_no(F.col("article_no")).alias("article_no"))
    placed = own.groupBy("law_id", "article_no").agg(F.min_by("a_id", F.struct(F.col("raw") != F.col("article_no"), "a_id")).alias("article_id"))
    return matched.join(placed, ["law_id", "article_no"], "left").select("id", "nth", F.col("title").alias("ref_title"), "ref_no", "article_no", "law_id", "article_id")


def unique_targets(candidates: DataFrame, key: str = "key", target: str = "target") -> DataFrame:
    """(key, target) where a key has one target only; ambiguous ones get null."""
    one = F.count_distinct(target) == 1
    return candidates.groupBy(key).agg(F.when(one, F.min(target)).alias(target))


def chips(marks: DataFrame, cited: DataFrame) -> DataFrame:
    """(id, nth, law_id, article_id) of an answer's marks (id, nth, title, no): the citation that each one means.

    ``cited`` (id, title, ref_title, no, law_id, article_id) are the citations
    that came with the answers. A mark goes by its title, in either of the
    citation's two titles, and its number. Years in titles count; only a mark
    without year whose title meets no citation of its answer goes by titles
    without years. A mark whose citations have different targets, or none, gets
    nulls; id and nth name a mark. Marks and citations meet by their answer alone, so those that are
    dealt to tasks by it already don't move again.
    """
    bare = lambda c: F.regexp_replace(c, f"^{T.COUNTRY}", "")
    number = lambda c: F.when(T.strip(F.coalesce(c, F.lit(""))) == "全文", F.lit("全文")).otherwise(normalize_article_no(c))

    def keys(title: Column, years: bool) -> Column:
        clean = T.clean_title(title)
        bases = [clean] if years else [clean, T.strip(F.regexp_replace(clean, T.ANY_VERSION, ""))]
        longer = [F.when(F.contains(b, F.lit(short)), F.replace(b, F.lit(short), F.lit(full))) for b in bases for short, full in T.ALIASES]
        return F.array_remove(F.array_distinct(F.array_compact(F.transform(F.array(*bases, *longer), bare))), "")

    # expressions of titles and numbers are worked out once for each different one; these are stored, so that their size is known before marks and citations are joined with them
    said = lambda df, **of: df.select(F.explode(F.array(*[F.struct(F.lit(of[c]).alias("kind"), F.col(c).cast("string").alias("said")) for c in of])).alias("s")).select("s.*")
    every = said(marks, title="title", no="no").union(said(cited, title="title", ref_title="title", no="no"))
    every = stored(every.where("said is not null").distinct(), "chips-said")
    titles = every.where("kind = 'title'").select(F.col("said").alias("title"), keys(F.col("said"), True).alias("full"), keys(F.col("said"), False).alias("bare"), bare(T.clean_title(F.col("said"))).alias("name"), (~F.col("said").rlike(T.ANY_VERSION)).alias("loose"))
    # keys with years are among those without
    titles = titles.withColumn("bare", F.array_union("full", "bare"))
    numbers = every.where("kind = 'no'").select(F.col("said").alias("no"), number(F.col("said")).alias("number"))
    left = marks.join(numbers, "no", "left").join(titles, "title", "left").select("id", "nth", "number", "loose", "full", "bare")
    # a mark meets the citations of one title and number as one
    pair = F.struct("law_id", "article_id")
    right = cited.groupBy("id", "title", "ref_title", "no").agg(F.min(pair).alias("least"), F.max(pair).alias("most"))
    right = right.join(numbers.toDF("no", "cited_no"), "no", "left").join(titles.drop("loose"), "title", "left")
    right = right.join(titles.select(F.col("title").alias("ref_title"), F.col("full").alias("ref_full"), F.col("bare").alias("ref_bare")), "ref_title", "left")
    both = lambda *of: F.array_union(*[F.coalesce(c, F.array().cast("array<string>")) for c in of])
    target = lambda c: F.struct(f"{c}.law_id", f"{c}.article_id", F.when(F.col(f"{c}.law_id").isNull(), F.coalesce("name", "ref_title")).alias("name"))
    right = right.select(F.col("id").alias("of_id"), "cited_no", target("least").alias("least"), target("most").alias("most"), both("full", "ref_full").alias("cited_full"), both("bare", "ref_bare").alias("cited_bare"))
    full = F.arrays_overlap("full", "cited_full")
    met = left.join(right, (F.col("id") == F.col("of_id")) & F.when(F.col("loose"), F.arrays_overlap("bare", "cited_bare")).otherwise(full), "left")
    # a mark has one target if the least is the greatest
    same = F.col("number") == F.col("cited_no")
    hit = {"full": full & same, "loose": F.col("loose") & same}
    seen = met.groupBy("id", "nth").agg(F.max(full).alias("any_full"), *[f(F.when(fits, F.col(c))).alias(f"{kind}_{c}") for kind, fits in hit.items() for f, c in ((F.min, "least"), (F.max, "most"))])
    one = lambda kind: F.when(F.col(f"{kind}_least") == F.col(f"{kind}_most"), F.col(f"{kind}_least"))
    return seen.select("id", "nth", F.when(F.col("any_full"), one("full")).otherwise(one("loose")).alias("target")).select("id", "nth", "target.law_id", "target.article_id")


def match_references(refs: DataFrame, laws: DataFrame) -> DataFrame:
    """(ref_title, law_id): exact variants in order, then laws whose name contains the shortest variant, the shortest name first; every law may be met."""
    names = refs.select("ref_title").distinct()
    forms = names.select("ref_title", F.posexplode(T.reference_variants(F.col("ref_title"))).alias("p", "v"))
    seen = laws.select(F.col("id").alias("law_id"), F.col("title").alias("law_title"))
    exact = forms.join(seen, F.col("v") == F.col("law_title")).groupBy("ref_title").agg(F.min_by("law_id", F.struct("p", "law_id")).alias("law_id"))
    left = forms.join(exact, "ref_title", "left_anti")
    fuzzy = containing(left, "v", seen, "law_title").groupBy("ref_title").agg(F.min_by("law_id", F.struct(F.length("v"), "p", F.length("law_title"), "law_id")).alias("law_id"))
    return exact.unionByName(fuzzy)


def require(wanted: DataFrame, laws: DataFrame, articles: DataFrame) -> DataFrame:
    """(article_id, law_id, title, article_no, text) of fixed citations (article_id); one that isn't there is an error."""
    own = articles.select(F.col("id").alias("article_id"), "law_id", "article_no", "text")
    named = wanted.select("article_id").join(own, "article_id", "left").join(laws.select(F.col("id").alias("law_id"), "title"), "law_id", "left")
    missing = F.assert_true(F.col("title").isNotNull(), F.concat(F.lit("no article "), F.col("article_id").cast("string")))
    return named.where(missing.isNull()).select("article_id", "law_id", "title", "article_no", "text")


def preset(questions: DataFrame, asked: str) -> DataFrame:
    """Questions (id, question, ...) that are what was asked, white space apart."""
    plain = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    return questions.where((plain(F.col("question")) == plain(F.lit(asked))) & (plain(F.lit(asked)) != ""))


def within(answers: DataFrame, title: str, text: str = "text") -> DataFrame:
    """(id, inside): whether all of an answer's citations name that law; an answer without citations is inside."""
    return answers.select("id", F.forall(extract(F.col(text)), lambda c: T.clean_title(c["title"]) == T.clean_title(F.lit(title))).alias("inside"))


def first_articles(articles: DataFrame, *more: str) -> DataFrame:
    """(law_id, id, ...) of each law's first article, with further columns of it."""
    return articles.groupBy("law_id").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in more])


def new_relations(items: DataFrame, laws: DataFrame, articles: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, outcome) of extracted items (law_id, ref_title, rel_type, note).

    An edge goes from a law's first article to the first of the law it names.
    Items that name no law, their own, or one without articles are unmatched;
    ``saved`` counts matched items, also where the edge is there already.
    """
    first = first_articles(articles).select("law_id", F.col("id").alias("first_id"))
    target = match_references(items, laws).withColumnRenamed("law_id", "target_law")
    joined = items.join(target, "ref_title", "left").join(first.select("law_id", F.col("first_id").alias("from_id")), "law_id", "left").join(first.select(F.col("law_id").alias("target_law"), F.col("first_id").alias("to_id")), "target_law", "left")
    ok = F.col("from_id").isNotNull() & F.col("to_id").isNotNull() & (F.col("law_id") != F.col("target_law"))
    rows = joined.withColumn("ok", F.coalesce(ok, F.lit(False)))
    edges = rows.where("ok").groupBy("from_id", "to_id", "rel_type").agg(F.min(F.substring("note", 1, 200)).alias("note"))
    edges = edges.join(relations.select("from_id", "to_id", "rel_type"), ["from_id", "to_id", "rel_type"], "left_anti")
    outcome = rows.groupBy("law_id").agg(F.count(F.lit(1)).cast("int").alias("extracted"), F.count_if("ok").cast("int").alias("saved"), F.count_if(~F.col("ok")).cast("int").alias("unmatched"))
    return edges, outcome
