"""Edit-aware token counts over trees of text segments."""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: The pattern that splits text into pre-tokens for the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A space between letters or digits always begins a pre-token, so texts may be cut there.
SAFE = re.compile(r"(?<=[^\W_]) (?=[^\W_])")
#: Least characters of a segment.
SEGMENT = 512


def ship(spark: SparkSession, path: str) -> str:
    """Hand the driver's rank file to all executors; returns the name for ``shipped_encoder``."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


@lru_cache(maxsize=2)
def shipped_encoder(name: str):
    return encoder(SparkFiles.get(name))


@lru_cache(maxsize=2)
def encoder(path: str = RANKS):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str) -> list[str]:
    """The text in pieces that begin at safe places, each of at least SEGMENT characters but the last."""
    out, at = [], 0
    while m := SAFE.search(text, at + SEGMENT):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


class TokenTree:
    """A document's segments as leaves of a binary tree whose nodes hold sums of characters and tokens.

    An edit goes down the tree to the leaves it touches, adds neighbours while
    a border isn't a safe place, encodes only that text again into the first of
    the leaves and renews the sums above them. ``encoded`` counts the
    characters that edits made it encode.
    """

    def __init__(self, texts: list[str], counts: list[int], count):
        self.count, self.texts, self.encoded = count, list(texts), 0
        self.width = 1 << max(0, len(self.texts) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        for i, (t, n) in enumerate(zip(texts, counts, strict=True)):
            self.sums[self.width + i] = len(t), n
        for i in range(self.width - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @classmethod
    def of(cls, text: str, count) -> TokenTree:
        texts = segments(text)
        return cls(texts, [count(t) for t in texts], count)

    def leaves(self) -> list[tuple[str, int]]:
        """(text, tokens) of the leaves that hold text; one of an empty document."""
        held = [(t, int(self.sums[self.width + i, 1])) for i, t in enumerate(self.texts) if t]
        return held or [("", 0)]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for the text's end, and the place within it."""
        place, i = min(place, max(0, self.chars - 1)), 1
        while i < self.width:
            i *= 2
            if place >= self.sums[i, 0] and self.sums[i + 1, 0]:
                place -= int(self.sums[i, 0])
                i += 1
        return i - self.width, place

    def _set(self, leaf: int, text: str) -> None:
        self.texts[leaf] = text
        i = self.width + leaf
        self.sums[i] = len(text), self.count(text) if text else 0
        while i > 1:
            i //= 2
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    def edit(self, begin: int, end: int, new: str) -> None:
        """Replace characters begin to end; places past the text's end mean its end."""
        begin = min(max(0, begin), self.chars)
        end = min(max(begin, end), self.chars)
        first, at = self.leaf(begin)
        if begin == self.chars:
            at = len(self.texts[first])
        last = first if end == begin else self.leaf(end - 1)[0]
        old = "".join(self.texts[first : last + 1])
        text = old[:at] + new + old[at + end - begin :]
        while True:
            before = next((i for i in range(first - 1, -1, -1) if self.texts[i]), None)
            after = next((i for i in range(last + 1, len(self.texts)) if self.texts[i]), None)
            if before is not None and not (text and SAFE.match(self.texts[before][-1] + text[:2], 1)):
                text, first = self.texts[before] + text, before
            elif after is not None and not SAFE.match(text[-1:] + self.texts[after][:2], 1):
                text, last = text + self.texts[after], after
            else:
                break
        self.encoded += len(text)
        for i in range(first + 1, last + 1):
            self._set(i, "")
        self._set(first, text)

    def text(self) -> str:
        return "".join(self.texts)


TREE = "texts array<string>, counts array<int>"


def plant(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """``docs`` with tree, the leaves (texts, counts) of their tokens' trees, in place of text: stored in the shared folder, so later edits encode no text again but what they touch.

    Null text is an empty document; null ids, repeated rows, ties, long texts
    and extra columns stay as they are, but a column called tree is replaced;
    an empty table gives one.
    """
    name = ship(docs.sparkSession, ranks)

    @F.pandas_udf(TREE)
    def grow(texts: pd.Series) -> pd.DataFrame:
        encode = shipped_encoder(name).encode_ordinary
        cut = [segments(t or "") for t in texts]
        return pd.DataFrame({"texts": cut, "counts": [[len(encode(t)) for t in some] for some in cut]})

    return stored(docs.select(*[docs[c] for c in docs.columns if c not in ("text", "tree")], grow(docs["text"]).alias("tree")), "trees")


def apply_edits(trees: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, n_chars, n_tokens, n_edits, n_chars_after, n_tokens_after, n_encoded, tree) per row of ``trees`` (doc_id, tree, edits).

    ``edits`` is an array of (begin, end, replacement), done in order, each on
    the text the last one left; null stands for none, a null place for 0 and a
    null replacement for the empty string. The tree that comes out can be
    stored for the next edits. Null ids and repeated rows stay, ties and extra
    columns make no difference, an empty table gives no rows. ``n_encoded`` is
    the characters that all edits encoded again, however long the text.
    """
    name = ship(trees.sparkSession, ranks)
    shape = f"n_chars long, n_tokens long, n_edits long, n_chars_after long, n_tokens_after long, n_encoded long, {TREE}"

    @F.pandas_udf(shape)
    def run(tree: pd.DataFrame, edits: pd.Series) -> pd.DataFrame:
        encode = shipped_encoder(name).encode_ordinary
        rows = []
        for texts, counts, todo in zip(tree["texts"], tree["counts"], edits, strict=True):
            own = TokenTree(texts, counts, lambda t: len(encode(t)))
            chars, tokens, n = own.chars, own.tokens, 0
            for e in todo if todo is not None else ():
                if e is not None:
                    own.edit(int(e["begin"] or 0), int(e["end"] or 0), e["replacement"] or "")
                    n += 1
            left = own.leaves()
            rows.append((chars, tokens, n, own.chars, own.tokens, own.encoded, [t for t, _ in left], [k for _, k in left]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in shape.split(", ")])

    made = trees.select("doc_id", run("tree", "edits").alias("r"))
    return made.select("doc_id", *[F.col("r")[c.split()[0]].alias(c.split()[0]) for c in shape.split(", ")[:6]], F.struct("r.texts", "r.counts").alias("tree"))


def count_edited(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """The counts of ``apply_edits`` for ``docs`` (doc_id, text, edits) whose trees aren't stored yet; cases as there."""
    return apply_edits(plant(docs, ranks), ranks).drop("tree")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` or stored trees with the rows of ``edits`` (doc_id, nth, begin, end, replacement) gathered per document, in order of nth.

    A column called edits is replaced, all others stay. Edits without doc_id
    belong to no document, ties in nth go by place, then replacement.
    """
    rows = edits.where("doc_id is not null").groupBy(F.col("doc_id").alias("edited")).agg(F.array_sort(F.collect_list(F.struct("nth", "begin", "end", "replacement"))).alias("e"))
    gathered = rows.select("edited", F.transform("e", lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end"), x["replacement"].alias("replacement"))).alias("todo"))
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = packed.join(gathered, F.col("row.doc_id") == F.col("edited"), "left")
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "edits"], F.col("todo").alias("edits"))


def review_edits(text: Column) -> Column:
    """A reviewer's three edits, placed by the text's length: a word put in at a quarter, 20 characters cut at half, a closing line."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("int")
    quarter, half = F.expr("cast(0 as int)") + F.floor(n / 4).cast("int"), F.floor(n / 2).cast("int")
    edit = lambda b, e, r: F.struct(b.cast("int").alias("begin"), e.cast("int").alias("end"), F.lit(r).alias("replacement"))
    return F.array(edit(quarter, quarter, " reviewed"), edit(half, half + 20, ""), edit(n + 9, n + 9, "\nChecked."))
