"""Chinese numerals up to 9999 and article numbers, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = "零一二三四五六七八九"
NUMBER = r"[一二三四五六七八九十百千零〇\d]+"
ARTICLE_NO = rf"(?U)第{NUMBER}条(?:之{NUMBER})?"


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once; without this Spark writes its code out at every place of use."""
    return F.element_at(F.transform(F.array(value), use), 1)


def to_chinese(n: Column) -> Column:
    """Numeral of 1..9999: 十 to 十九 without 一 in front, one 零 for a gap; null outside."""
    said = F.translate(F.lpad(n.cast("int").cast("string"), 4, "0"), "0123456789", DIGITS)
    full = F.regexp_replace(said, "^(.)(.)(.)(.)$", "$1千$2百$3十$4")
    short = F.regexp_replace(F.regexp_replace(full, "零[千百十]", "零"), "零+", "零")
    return F.when(n.between(1, 9999), F.regexp_replace(F.regexp_replace(short, "^零|零$", ""), "^一十", "十"))


def _spoken(s: Column) -> Column:
    """Value of digits with units."""

    def place(digits: Column, unit: str, value: int) -> Column:
        d = F.nullif(F.regexp_extract(digits, rf"(\d?){unit}", 1).try_cast("int"), F.lit(0))
        return F.when(F.contains(digits, F.lit(unit)), F.coalesce(d, F.lit(1)) * value).otherwise(0)

    last = lambda digits: F.coalesce(F.regexp_extract(digits, r"(\d)$", 1).try_cast("int"), F.lit(0))
    return let(F.translate(s, DIGITS, "0123456789"), lambda d: place(d, "千", 1000) + place(d, "百", 100) + place(d, "十", 10) + last(d))


def to_int(numeral: Column) -> Column:
    """Value of a Chinese or decimal numeral of 1..9999, else null; 〇 is 零, a unit without digit has one of it."""
    read = lambda s: F.when(s.rlike(r"^\d{1,4}$"), s.try_cast("int")).when(s.rlike(rf"^[{DIGITS}十百千]+$"), _spoken(s))
    return let(let(F.translate(numeral, "〇０１２３４５６７８９", "零0123456789"), read), lambda v: F.when(v.between(1, 9999), v))


def _canonical(raw: Column) -> Column:
    """The numeral in canonical form; null where digits and characters mix, the form isn't canonical, or the value is out of range."""
    return let(F.struct(raw.alias("raw"), to_chinese(to_int(raw)).alias("made")), lambda x: F.when(x["raw"].rlike(r"(?U)^\d+$") | (F.translate(x["raw"], "〇", "零") == x["made"]), x["made"]))


def normalize_article_no(no: Column) -> Column:
    """第N条 or 第N条之M with canonical numerals, a remark in parentheses dropped; whatever can't be read stays as it is."""
    shape = rf"(?U)^第({NUMBER})条(?:之({NUMBER}))?(?:[（(][^（）()]+[）)])?$"

    def normal(original: Column) -> Column:
        behind = let(F.regexp_extract(original, shape, 2), lambda sub: F.when(sub == "", "").otherwise(F.concat(F.lit("之"), _canonical(sub))))
        return F.coalesce(F.when(original.rlike(shape), F.concat(F.lit("第"), _canonical(F.regexp_extract(original, shape, 1)), F.lit("条"), behind)), original)

    return let(F.regexp_replace(F.coalesce(no, F.lit("")), r"(?U)^\s+|\s+$", ""), normal)


# The pattern of a citation.
CITATION = rf"(?U)《?([^《》\s，。；：？！]{{2,30}}?)》?\s*第({NUMBER})条"


def parse_citation(query: Column) -> Column:
    """(title, article_no) of the first title with article number in a query; null without one or if the number is out of range."""

    def cited(q: Column) -> Column:
        no = F.concat(F.lit("第"), to_chinese(to_int(F.regexp_extract(q, CITATION, 2))), F.lit("条"))
        return let(F.struct(F.regexp_extract(q, CITATION, 1).alias("title"), no.alias("article_no")), lambda x: F.when(q.rlike(CITATION) & x["article_no"].isNotNull(), x))

    return let(F.coalesce(query, F.lit("")), cited)
