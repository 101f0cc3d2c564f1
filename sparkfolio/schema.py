"""Schemas of the stored tables, as DDL strings, and the driver tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LAWS = (
    "id BIGINT, title STRING, doc_number STRING, issuer STRING, level STRING, topic_tags STRING, issue_date STRING, "
    "published_at STRING, effective_date STRING, status STRING, source_name STRING, source_url STRING, content_hash STRING, "
    "full_text STRING, created_at STRING, updated_at STRING, quality_flag STRING, duplicate_of BIGINT, superseded_by BIGINT, version_label STRING"
)
ARTICLES = "id BIGINT, law_id BIGINT, article_no STRING, text STRING, embedding ARRAY<FLOAT>"
RELATIONS = "id BIGINT, from_id BIGINT, to_id BIGINT, rel_type STRING, note STRING, created_at STRING"
MARKS = "law_id BIGINT, status STRING, attempts INT, extracted INT, saved INT, unmatched INT, note STRING, attempted_at STRING"
WIKI = "id BIGINT, law_id BIGINT, markdown STRING, model_used STRING, generated_at STRING"
SYNC_LOG = "id BIGINT, source_name STRING, started_at STRING, finished_at STRING, new_count INT, updated_count INT, status STRING, detail STRING"
TABLES = {"laws": LAWS, "articles": ARTICLES, "relations": RELATIONS, "relation_extractions": MARKS, "wiki_pages": WIKI, "sync_log": SYNC_LOG}



def migrate(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with the schema's columns in its order: those it lacks are null, others are cast; run again it changes nothing."""
    wanted = [x.strip().split(" ", 1) for x in ddl.split(", ")]
    return df.select(*[(F.col(n).cast(kind) if n in df.columns else F.lit(None).cast(kind)).alias(n) for n, kind in wanted])


# Fixed values.
STATUSES = ["现行有效", "已修订", "已废止"]
RELATION_TYPES = ["引用", "修订替代", "上位法", "同一事项", "程序衔接"]
LEVELS = ["法律", "行政法规", "部门规章", "司法解释", "自律规则", "规范性文件"]
NO_LEVEL = "未分类"
