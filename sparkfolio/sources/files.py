"""Files in a landing folder, snapshots of tables, extracts and reports."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Text runs of legacy files: letters, digits and usual marks, 8 or more.
RUN = re.compile(r"[一-鿿　-〿＀-￯\w，。、；：？！《》（）“”‘’—…·%./ \n\r-]{8,}")


def landing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files that acquisition left in a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with a line per row."""
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{WORD}body")
    said = lambda x: "".join(t.text or "" for t in x.iter(f"{WORD}t")).strip()
    out = [said(p) for p in body.findall(f"{WORD}p")]
    for row in body.iter(f"{WORD}tr"):
        out.append(" | ".join(c for c in map(said, row.findall(f"{WORD}tc")) if c))
    return "\n".join(x for x in out if x)


def legacy_text(data: bytes) -> str:
    return "\n".join(RUN.findall(data.decode("utf-16-le", errors="ignore")))


def pdf_text(data: bytes) -> str:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(data)) as pdf:
        return "\n".join(p.extract_text() or "" for p in pdf.pages)


READERS = {"docx": docx_text, "doc": legacy_text, "pdf": pdf_text}


@F.pandas_udf(StructType().add("text", "string").add("error", "string"))
def file_text(path: pd.Series, content: pd.Series) -> pd.DataFrame:
    """Text of a file by its extension; a file that fails gives its error and fails no other."""
    out = []
    for p, data in zip(path, content, strict=True):
        kind = p.rpartition(".")[2].lower()
        try:
            out.append((READERS[kind](bytes(data)) if kind in READERS else bytes(data).decode("utf-8", errors="replace"), None))
        except Exception as e:
            out.append((None, f"{type(e).__name__}: {e}"[:200]))
    return pd.DataFrame(out, columns=["text", "error"])


def archive_name(url):
    """Name under which a fetched page is kept."""
    return F.substring(F.md5(url), 1, 16)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, path: str) -> str:
    """Changes with the names, sizes or times of the files under a path."""
    import hashlib

    fs, p = _fs(spark, path)
    found, rows = fs.listFiles(p, True), []
    while found.hasNext():
        f = found.next()
        rows.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.md5(repr(sorted(rows)).encode(), usedforsecurity=False).hexdigest()


def snapshots(spark: SparkSession, root: str) -> list[str]:
    """Complete snapshots under a root, oldest first."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    made = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_COMPLETE"))]
    return sorted(made)


def write_snapshot(tables: dict[str, DataFrame], root: str, name: str, keep: int = 5) -> None:
    """Write all tables as one snapshot; it counts once its marker is there. Of the older ones the newest stay, ``keep`` in all, at least 1."""
    spark = next(iter(tables.values())).sparkSession
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{t}")
    fs, marker = _fs(spark, f"{root}/{name}/_COMPLETE")
    fs.create(marker).close()
    for old in snapshots(spark, root)[: -max(1, keep)]:
        fs, p = _fs(spark, f"{root}/{old}")
        fs.delete(p, True)


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{snapshots(spark, root)[-1]}/{table}")


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def extract(laws: DataFrame, articles: DataFrame, relations: DataFrame, law_ids: list[int]) -> dict[str, DataFrame]:
    """The given laws, their articles, and the relations with both ends among them."""
    own = articles.where(F.col("law_id").isin(law_ids))
    ids = own.select("id")
    inside = relations.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    return {"laws": laws.where(F.col("id").isin(law_ids)), "articles": own, "relations": inside}


SECRET = r"(?i)(sk-[A-Za-z0-9]{16,}|api[_-]?key\W{1,4}[A-Za-z0-9_-]{12,}|bearer\s+[A-Za-z0-9._-]{16,})"


def with_secrets(df: DataFrame, *cols: str) -> DataFrame:
    """Rows in whose columns something looks like a key."""
    return df.where(F.concat_ws("\n", *cols).rlike(SECRET))


def stats_snapshot(reply: DataFrame, fields: list[str]) -> DataFrame:
    """Whole-number fields of a JSON reply (value); a reply that lacks one is an error."""
    parsed = reply.select(F.from_json("value", ", ".join(f"{f} BIGINT" for f in fields)).alias("s")).select("s.*")
    missing = F.concat_ws(", ", *[F.when(F.col(f).isNull(), f) for f in fields])
    return parsed.withColumn("checked", F.assert_true(missing == "", F.concat(F.lit("missing: "), missing))).where("checked is null").drop("checked")
