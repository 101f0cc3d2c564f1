"""Text: articles, snippets, digests, masks, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numerals import NUMBER
from .titles import strip

# Stop words and terms of the field.
STOP_WORDS = [
    "的", "了", "和", "与", "及", "或", "是", "在", "对", "为",
    "有", "什么", "怎么", "如何", "哪些", "多少", "吗", "呢", "请", "问",
    "关于", "以及", "或者", "应当", "可以", "要求", "规定", "进行", "相关", "有关",
]
TERMS = [
    "内幕交易", "短线交易", "信息披露", "信息披露义务", "减持", "注册制", "退市整理期", "关联交易", "独立董事", "融资融券",
    "要约收购", "合格投资者", "债券违约", "股权激励", "操纵市场", "虚假陈述", "内幕信息", "控股股东", "实际控制人", "一致行动人",
    "证券发行", "上市公司", "证券交易所", "证券公司", "证券投资基金", "行政处罚", "行政复议", "听证",
]
ARTICLE_START = rf"(?Udm)(?=^第{NUMBER}条)"
ARTICLE_HEAD = rf"(?Us)^(第{NUMBER}条(?:之[一二三四五六七八九十\d]+)?)\s*(.*)$"
QUERY_GAP = r"(?U)[\s，。、；：？！·,.:;?!]+"
CUT_MARK = "\n……（中略）……\n"


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def articles(full_text: Column) -> Column:
    """(article_no, text) of the articles that begin a line; what stands before the first is dropped, none gives an empty array."""
    parts = F.filter(F.split(F.coalesce(full_text, F.lit("")), ARTICLE_START), lambda p: p.rlike(ARTICLE_HEAD))
    whole = lambda p: strip(p)
    body = lambda p: strip(F.regexp_extract(whole(p), ARTICLE_HEAD, 2))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, ARTICLE_HEAD, 1).alias("article_no"), F.coalesce(F.nullif(body(p), F.lit("")), whole(p)).alias("text")))


def split_articles(laws: DataFrame) -> DataFrame:
    """(law_id, pos, article_no, text): one row per article; a law without articles gives its whole text with an empty number."""
    found = articles(F.col("full_text"))
    whole = F.array(F.struct(F.lit("").alias("article_no"), F.coalesce("full_text", F.lit("")).alias("text")))
    rows = laws.select(F.col("id").alias("law_id"), found.alias("found"), whole.alias("whole"))
    rows = rows.select("law_id", F.when(F.size("found") > 0, F.col("found")).otherwise(F.col("whole")).alias("a"))
    return rows.select("law_id", F.posexplode_outer("a").alias("pos", "a")).select("law_id", F.col("pos").cast("long").alias("pos"), "a.article_no", "a.text")


def digest(text: Column, n: int) -> Column:
    """The text, or of one longer than ``n`` the first two thirds of n, a mark, and the last third rounded up."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n * 2 // 3), F.lit(CUT_MARK), F.right(t, F.lit(-(-n // 3)))))


def snippet(text: Column, terms: list[str], window: int = 260) -> Column:
    """A window centred on the earliest hit of any term, the longer at one place; without hit the text's beginning."""
    t = F.coalesce(text, F.lit(""))
    hits = [F.struct(F.locate(x.lower(), F.lower(t)).alias("pos"), F.lit(-len(x)).alias("len")) for x in terms]
    found = F.array_min(F.filter(F.array(*hits), lambda h: h["pos"] > 0)) if hits else F.lit(None)
    middle = found["pos"] - 1 + F.floor(-found["len"] / 2) if hits else F.lit(0)
    begin = F.least(F.greatest(F.coalesce(middle, F.lit(0)) - window // 2, F.lit(0)), F.length(t) - window)
    begin = F.when(found.isNull(), 0).otherwise(begin) if hits else F.lit(0)
    return F.when(F.length(t) <= window, t).otherwise(F.substring(t, (begin + 1).cast("int"), F.lit(window)))


def highlight(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Hits marked from the left, the longest first, whatever their case."""
    if not terms:
        return text
    every = "|".join(rf"\Q{t}\E" for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, f"(?iu)({every})", f"{before}$1{after}")


def split_terms(query: str) -> list[str]:
    """Terms of a query of 2 characters or more between white space and punctuation, else the query itself."""
    found = [t for t in re.split(QUERY_GAP.removeprefix("(?U)"), query) if len(t) >= 2]
    return found or [query]


def mask_secret(secret: Column) -> Column:
    """First and last four characters around stars; of a short one stars only."""
    s = F.coalesce(secret, F.lit(""))
    return F.when(F.length(s) < 8, F.repeat(F.lit("*"), F.length(s))).otherwise(F.concat(F.left(s, F.lit(4)), F.lit("****"), F.right(s, F.lit(4))))


def tokens(text: Column) -> Column:
    """Words for the index: lower-cased runs of letters and digits; of Chinese runs the pairs of neighbours and the terms they hold. Texts without Chinese take one pass."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(r"\p{IsHan}"), _mixed_tokens(low)).otherwise(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def _mixed_tokens(low: Column) -> Column:
    latin = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    runs = F.regexp_extract_all(low, F.lit(r"(\p{IsHan}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    terms = F.regexp_extract_all(low, F.lit("(" + "|".join(sorted((t for t in TERMS if len(t) > 2), key=len, reverse=True)) + ")"), F.lit(1))
    return F.concat(latin, pairs, terms)


def query_terms(query: Column, cut=tokens) -> Column:
    """Different tokens of 2 characters or more that aren't stop words, in order."""
    return F.filter(F.array_distinct(cut(query)), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))


def highlight_terms(query: Column) -> Column:
    """Split terms and tokens, of 2 characters or more and no stop words, the longer first."""
    split = F.filter(F.split(F.coalesce(query, F.lit("")), QUERY_GAP), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))
    every = F.array_distinct(F.concat(split, query_terms(query)))
    ranked = F.transform(every, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(ranked), lambda s: s["t"])


def offline_snippet(text: Column, terms: list[str], before: int = 100, size: int = 260) -> Column:
    """White space collapsed; from some characters before the first hit, with dots where text is left out."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    places = F.filter(F.array(*[F.locate(x.lower(), F.lower(t)) for x in terms]), lambda p: p > 0)
    first = F.coalesce(F.array_min(places), F.lit(1)) if terms else F.lit(1)
    begin = F.greatest(first - 1 - before, F.lit(0))
    head, tail = F.when(begin > 0, "…").otherwise(""), F.when(begin + size < F.length(t), "…").otherwise("")
    return F.concat(head, F.substring(t, begin + 1, F.lit(size)), tail)


def salvage_json(reply: Column, schema: str) -> Column:
    """What a reply holds between its first { and last }, parsed; null if it can't be."""
    return F.from_json(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)(\{.*\})", 1), schema)


def tool_result(title: Column, no: Column, status: Column, text: Column, n: int = 500) -> Column:
    return F.concat(F.lit("【"), title, F.lit("·"), no, F.lit("】（"), status, F.lit("）"), F.substring(text, 1, n))
