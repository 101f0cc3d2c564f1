"""Cutting Chinese text into the words of a dictionary: the most probable path through all words that a text holds.

Every dictionary word at every place is an edge of a graph over the places of a
run of Chinese characters, as is every single character; the path with the
greatest product of word frequencies is found from the right by dynamic
programming. Long words give their inner words too, and what no word covers
gives pairs of neighbours, so that words the dictionary lacks are still found.
"""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import STOP_WORDS, TERMS
from .titles import strip

#: A title's count, and the lengths of titles that become words.
TITLE_COUNT, TITLE_LENGTHS = 10_000, (2, 20)
#: Words a dictionary may have to be shipped to every task, some 100 MB; larger ones are joined with the texts.
MOST_SHIPPED = 500_000
#: Characters by which texts look up the words of a larger dictionary.
KEY = 2

#: The characters of Java's script Han.
_HAN = re.compile(r"[\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U000323af]+")
_RUN = re.compile(rf"{_HAN.pattern}|[^\W_]+")


def dictionary(spark: SparkSession, titles: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, n): the field's terms, a vocabulary (term, n), and titles (title) of 2 to 20 characters without outer 《》; of a term's counts the greatest."""
    found = spark.createDataFrame([(t, 1) for t in TERMS], "term string, n long")
    if vocabulary is not None:
        found = found.unionByName(vocabulary.select(F.lower("term").alias("term"), F.greatest(F.col("n").cast("long"), F.lit(1)).alias("n")))
    if titles is not None:
        plain = F.regexp_replace(strip(F.lower("title")), "^[《》]+|[《》]+$", "")
        found = found.unionByName(titles.select(plain.alias("term"), F.lit(TITLE_COUNT).cast("long").alias("n")).where(F.length("term").between(*TITLE_LENGTHS)))
    return found.where("term <> ''").groupBy("term").agg(F.max("n").alias("n"))


class Words:
    """Words with their log frequencies; one character always is a word, of count 1 if it isn't known."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        self.total = math.log(total or sum(counts.values()) or 1)
        self.logs = {t: math.log(n) - self.total for t, n in counts.items()}
        self.unknown = -self.total
        self.lengths: dict[str, list[int]] = {}
        for t in counts:  # by first character, so that only lengths that occur are tried
            self.lengths.setdefault(t[0], []).append(len(t))
        self.lengths = {c: sorted(set(n)) for c, n in self.lengths.items()}

    def path(self, run: str) -> list[str]:
        """The most probable words of a run; of equal paths the one with the longer first word."""
        size = len(run)
        best = [0.0] * (size + 1)
        ends = [0] * size
        for i in range(size - 1, -1, -1):
            top, end = self.logs.get(run[i], self.unknown) + best[i + 1], i + 1
            for n in self.lengths.get(run[i], ()):
                if n > 1 and i + n <= size and (log := self.logs.get(run[i : i + n])) is not None and log + best[i + n] >= top:
                    top, end = log + best[i + n], i + n
            best[i], ends[i] = top, end
        out, at = [], 0
        while at < size:
            out.append(run[at : ends[at]])
            at = ends[at]
        return out

    def inner(self, word: str) -> list[str]:
        """Inner words of two and three characters, and pairs of what they leave uncovered, in order; none for words up to two characters."""
        found, covered = [], set()
        for n in (2, 3):
            if len(word) > n:
                for i in range(len(word) - n + 1):
                    if word[i : i + n] in self.logs:
                        found.append((i, n))
                        covered.update(range(i, i + n))
        if len(word) > 3:
            found += [(i, 2) for i in range(len(word) - 1) if i not in covered or i + 1 not in covered]
        return [word[i : i + n] for i, n in sorted(set(found))]

    def cut(self, text: str, inner: bool = True) -> list[str]:
        """Words for a search: of other scripts the runs of letters and digits. Without ``inner`` the plain path."""
        out: list[str] = []
        han = self._han if inner else self.path
        for m in _RUN.finditer(text):
            run = m[0]
            if not _HAN.match(run):
                # letters and Chinese characters that touch are runs of their own
                at = 0
                for h in _HAN.finditer(run):
                    out += [run[at : h.start()]] * (h.start() > at)
                    out += han(h[0])
                    at = h.end()
                out += [run[at:]] * (len(run) > at)
            else:
                out += han(run)
        return out

    def _han(self, run: str) -> list[str]:
        out, single = [], ""
        for word in [*self.path(run), ""]:
            if len(word) == 1 and word not in self.logs:
                single += word
                continue
            out += [single[i : i + 2] for i in range(len(single) - 1)] or [single] * bool(single)
            single = ""
            if word:
                out += [*self.inner(word), word]
        return out


class Segmenter:
    """Cuts texts by a dictionary (term, n) whose size is looked at first.

    A small dictionary goes to every task. A larger one is joined: texts meet
    the dictionary's words by their first two characters, and each text is cut
    by those words that it holds. Both give the same words, since the others
    can't be on a text's path.
    """

    def __init__(self, terms: DataFrame, most: int = MOST_SHIPPED):
        self.terms = terms
        some = terms.limit(most + 1).collect()  # bounded
        self.small = {r["term"]: r["n"] for r in some} if len(some) <= most else None
        self.total = sum(self.small.values()) if self.small is not None else terms.agg(F.sum("n")).first()[0]
        self.fingerprint = f"{terms.agg(F.sum(F.xxhash64('term', 'n').cast('decimal(38,0)'))).first()[0] or 0}"

    def words(self, units: DataFrame, inner: bool = True) -> DataFrame:
        """(id, w) of units (id, text): the lower-cased text's words in order. Null texts have none; texts without Chinese don't leave the JVM.

        Without ``inner`` Chinese runs give their path only: no inner words, no pairs.
        """
        low = units.select("id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
        return self._shipped(low, inner) if self.small is not None else self._joined(low, inner)

    def _shipped(self, low: DataFrame, inner: bool) -> DataFrame:
        counts, total, held = self.small, self.total, []

        @F.pandas_udf("array<string>")
        def cut(text: pd.Series) -> pd.Series:
            if not held:
                held.append(Words(counts, total))
            return text.map(lambda t: held[0].cut(t, inner))

        return _by_script(low, cut(F.when(F.col("low").rlike(r"\p{IsHan}"), F.col("low")).otherwise("")))

    def _joined(self, low: DataFrame, inner: bool) -> DataFrame:
        total = self.total
        keys = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - KEY + 1, F.lit(1))), lambda i: F.substring("low", i, F.lit(KEY))))
        chinese = low.where(F.col("low").rlike(r"\p{IsHan}"))
        terms = self.terms.withColumn("key", F.substring("term", 1, KEY))
        short = terms.where(F.length("term") < KEY)
        singles = F.array_distinct(F.split("low", ""))
        met = chinese.select("id", "low", F.explode(keys).alias("key")).join(terms.where(F.length("term") >= KEY), "key").where(F.contains("low", F.col("term"))).select("id", "term", "n")
        met = met.unionByName(chinese.select("id", F.explode(singles).alias("term")).join(short.select("term", "n"), "term").select("id", "term", "n"))
        own = met.distinct().groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("own"))

        @F.pandas_udf("array<string>")
        def cut(text: pd.Series, own: pd.Series) -> pd.Series:
            return pd.Series([Words(dict(o) if o is not None else {}, total).cut(t, inner) for t, o in zip(text, own)])

        return _by_script(low.join(own, "id", "left"), cut(F.when(F.col("low").rlike(r"\p{IsHan}"), F.col("low")).otherwise(""), F.col("own")))

    def query_terms(self, query: str) -> list[str]:
        """Different words of two characters or more that aren't stop words, in order."""
        spark = self.terms.sparkSession
        found = self.words(spark.createDataFrame([(0, query)], "id long, text string")).first()["w"]
        return [w for w in dict.fromkeys(found) if len(w) >= 2 and w not in STOP_WORDS]


def _by_script(low: DataFrame, cut: Column) -> DataFrame:
    plain = F.regexp_extract_all("low", F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    return low.withColumn("cut", cut).select("id", F.when(F.col("low").rlike(r"\p{IsHan}"), F.col("cut")).otherwise(plain).alias("w"))


def words_of(units: DataFrame, tokens) -> DataFrame:
    """(id, w) by a segmenter or by a function from a text column to an array column."""
    return tokens.words(units) if isinstance(tokens, Segmenter) else units.select("id", tokens(F.col("text")).alias("w"))
