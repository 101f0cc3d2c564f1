"""The operators applied to their whole tables, as thin queries."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import audit, chat, decontaminate, mixing, negatives, packing, pii, quality, simhash, spans, tokens, urls, warc
from .common import scratch
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the table has no capture times: one second per page stands in
    captured = F.timestamp_seconds(F.lit(1735689600) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31536000)))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html", captured.alias("captured"))
    index = warc.archive_pages(pages, scratch(spark, "warc"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", simhash.hex_print().alias("fingerprint"), "component_id")


def op3_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: A conversation whose texts are made of a chat template's control strings.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(turns.unionByName(more)))


def op6_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.covered(F.col("hits"))
    return leaks.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


#: host, path, verdict
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = tokens.plant(docs.withColumn("edits", tokens.review_edits(F.col("text"))))
    return tokens.apply_edits(trees).drop("tree")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@F.pandas_udf(LongType())
def crc32_of_ids(ids: pd.Series) -> pd.Series:
    return ids.map(lambda x: zlib.crc32(np.asarray(x, dtype="<u4").tobytes()))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", crc32_of_ids("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index,
        op2_simhash_anchors,
        op3_quality_llr,
        op4_mix_sources,
        op5_chat_windows,
        op6_sentence_spans,
        op7_pii_disclosure,
        op8_decontaminate,
        op9_url_filter,
        op10_token_edits,
        op11_filter_audit,
        op12_best_fit_packing,
        op13_hard_negatives,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}
