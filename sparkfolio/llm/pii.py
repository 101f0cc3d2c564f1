"""Personal data: patterns, and terms that corpus co-occurrence shows to disclose a protected entity."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, row_key, stored

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: A term is a run of letters; of scripts without spaces, each pair of neighbours in a run.
RUN = re.compile(r"[^\W\d_]+")
DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff]+")


@dataclass(frozen=True)
class Disclosure:
    """A term discloses an entity if they meet in two different texts at least and their pointwise mutual
    information reaches ``alpha`` times the entity's information content. All counts are of documents."""

    alpha: float = 0.8


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from each @: the local part before it, a dotted domain after it; linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of e-mail addresses, IP addresses, card and telephone numbers, by kind, then start."""
    text = text or ""
    out = [("email", b, e) for b, e in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m[0])) <= 15]
    return out


def as_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def term_places(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(lower-cased term, start, end) of the terms that don't touch a span."""
    taken, at = sorted((b, e) for _, b, e in spans), 0
    dense = DENSE.search(text)
    for m in RUN.finditer(text):
        b, e = m.span()
        while at < len(taken) and taken[at][1] <= b:
            at += 1
        if any(x < e for x, y in taken[at : at + len(KINDS)] if y > b):
            continue
        if not dense or not DENSE.search(m[0]):
            yield m[0].lower(), b, e
            continue
        for d in re.finditer(f"({DENSE.pattern})|[^\\W\\d_]", m[0]):
            yield from ((text[i : i + 2], i, i + 2) for i in range(b + d.start(), b + d.end() - 1))


def entities(text: str, spans: list[tuple[str, int, int]]) -> list[int]:
    """Hashes of the different entities: an e-mail address whatever its case, a number by its digits."""
    import xxhash

    value = lambda kind, v: v.lower() if kind == "email" else "".join(DIGIT.findall(v))
    return sorted({xxhash.xxh64_intdigest(f"{k}:{value(k, text[b:e])}".encode("utf-8", "surrogatepass")) - 2**63 for k, b, e in spans})


def scan(docs: DataFrame) -> DataFrame:
    """(key, doc_id, version, n_email, n_ip, n_card, n_phone, base, entities, places) of each row; computed once. Only texts with entities have places."""
    shape = "n_email long, n_ip long, n_card long, n_phone long, base string, entities array<long>, places array<struct<term: string, start: int, end: int>>"

    @F.pandas_udf(shape)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = base_spans(text)
            places = [{"term": t, "start": b, "end": e} for t, b, e in term_places(text, spans)] if spans else []
            rows.append((*[sum(k == kind for k, _, _ in spans) for kind in KINDS], as_text(spans), entities(text, spans) if spans else [], places))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "entities", "places"])

    return stored(docs.select(row_key(docs, "doc_id", "text").alias("key"), "doc_id", F.xxhash64("text").alias("version"), find("text").alias("found")).select("key", "doc_id", "version", "found.*"), "personal")


def document_counts(docs: DataFrame) -> DataFrame:
    """(term, documents): how many documents hold each term, with map-side combine."""

    @F.pandas_udf("array<string>")
    def held(texts: pd.Series) -> pd.Series:
        return pd.Series([list({t for t, _, _ in term_places(text or "", base_spans(text))}) for text in texts], dtype="object")

    return docs.select(F.explode_outer(held("text")).alias("term")).where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("documents"))


def disclosing(docs: DataFrame, found: DataFrame, p: Disclosure) -> DataFrame:
    """(entity, term): the pairs whose co-occurrence exceeds the disclosure threshold.

    p(entity | term) is the share of the term's documents that hold the entity;
    a pair is kept if PMI(term; entity) >= alpha * IC(entity). An entity or a
    pair that only one text holds, however often copied, shows nothing.
    Everything is counted with map-side combine.
    """
    two = F.min("version") != F.max("version")
    common = found.select("version", F.explode_outer("entities").alias("entity")).where("entity is not null").groupBy("entity").agg(F.count(F.lit(1)).alias("mentioned"), two.alias("two")).where("two").drop("two")
    common = stored(common, "entities")
    rows = found.select("version", F.array_distinct(F.transform("places", lambda x: x["term"])).alias("terms"), F.explode_outer("entities").alias("entity")).where("entity is not null")
    near = rows.join(common.select("entity"), "entity", "left_semi").select("entity", "version", F.explode_outer("terms").alias("term")).where("term is not null")
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("together"), two.alias("two")).where("two").drop("two")
    pairs = stored(pairs.join(common, "entity"), "pairs")
    n = F.lit(float(found.count()))
    pmi = F.log(F.col("together") * n / (F.col("documents") * F.col("mentioned")))
    content = F.log(n / F.col("mentioned"))
    return pairs.join(document_counts(docs), "term").where((content > 0) & (pmi >= p.alpha * content)).select("entity", "term")


def find_pii(docs: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """One row per row of ``docs``: (key, doc_id, n_email, n_ip, n_card, n_phone, base, terms).

    ``base`` holds the pattern spans as text, ``terms`` the sorted spans
    (start, end) of all places of disclosing terms in a text that holds their
    entity. Null text is empty and null ids stay; repeated rows have equal
    results, ties have none to break; extra columns are left out; an empty
    table gives no rows. Texts of any length are scanned as a whole and aren't
    shuffled.
    """
    found = scan(docs)
    shown = stored(disclosing(docs, found, p), "disclosing")
    held = found.select("key", "places", F.explode_outer("entities").alias("entity")).where("entity is not null").join(shown.select("entity").distinct(), "entity", "left_semi")
    placed = held.select("key", "entity", F.explode_outer("places").alias("x")).where("x is not null").select("key", "entity", F.col("x.term").alias("term"), F.struct("x.start", "x.end").alias("span"))
    hit = placed.join(shown, ["entity", "term"], "left_semi").groupBy(F.col("key").alias("hit_key")).agg(F.array_sort(F.collect_set("span")).alias("terms"))
    return found.drop("version", "entities", "places").join(hit, F.col("key") == F.col("hit_key"), "left").drop("hit_key")


def sanitise(docs: DataFrame, p: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with personal data in text generalised to its kind in angle brackets, disclosing terms to ``<TERM>``, and n_chars renewed if present.

    Null text stays null, null ids and repeated rows stay, ties and very long
    texts are treated like others, extra columns keep names and values, an
    empty table stays empty.
    """
    terms = find_pii(docs, p).where("terms is not null").select(F.col("key").alias("hit_key"), "terms").dropDuplicates(["hit_key"])

    @F.pandas_udf("string")
    def mask(texts: pd.Series, terms: pd.Series) -> pd.Series:
        out = []
        for text, more in zip(texts, terms, strict=True):
            spans = base_spans(text) + [("term", s["start"], s["end"]) for s in (more if more is not None else ())]
            if spans:
                pieces, at = [], 0
                for kind, b, e in sorted(spans, key=lambda s: (s[1], -s[2])):
                    if b >= at:
                        pieces += [text[at:b], f"<{kind.upper()}>"]
                    at = max(at, e)
                text = "".join([*pieces, text[at:]])
            out.append(text)
        return pd.Series(out, dtype="object")

    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), row_key(docs, "doc_id", "text").alias("row_key"))
    joined = rows.join(terms, F.col("row_key") == F.col("hit_key"), "left").select("row", mask("row.text", "terms").alias("masked"))
    made = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return joined.select(*[(made[c] if c in made else F.col("row")[c]).alias(c) for c in docs.columns])


def digest_columns(found: DataFrame) -> DataFrame:
    terms = F.array_join(F.transform(F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")), lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        F.concat_ws(",", F.nullif("base", F.lit("")), F.nullif(terms, F.lit(""))).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_terms"),
    )


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(as_text(spans).encode()).hexdigest()
