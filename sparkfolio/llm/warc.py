"""WARC archives and the external merge of their capture runs into one ordered index."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

CRLF = "\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive file before compression, a record's headers, and index rows of a merge task.
FILE_BYTES, HEADER_BYTES, MERGE_ROWS = 64 << 20, 600, 50_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1 of a string's UTF-8 bytes: 8 times 5 hex digits make 4 letters each."""
    hexed = F.sha1(payload)
    parts = [F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int") for i in range(8)]
    letters = F.lit(BASE32)
    return F.concat(*[F.substring(letters, F.call_function("shiftright", v, F.lit(s)).bitwiseAND(31) + 1, F.lit(1)) for v in parts for s in (15, 10, 5, 0)])


def record_id(page: Column) -> Column:
    """<urn:uuid:...> whose digits hold the page_id."""
    h = F.lower(F.lpad(F.hex(page.cast("long")), 16, "0"))
    return F.concat(F.lit("<urn:uuid:00000000-0000-4000-"), F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 12), F.lit(">"))


def header(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; white space and control characters in it are taken out."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\x00-\x20\x7F]+", "%20"), F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record): the WARC record of each row of ``pages`` (page_id, url, html, captured).

    Of rows with equal payloads of at least ``least_bytes`` bytes those with
    the largest page_id are responses, the others revisits of it. The largest
    page_id of each digest comes from an aggregation with map-side combine and
    is joined back, so copies need no window of their own.
    """
    x = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), "captured")
    x = x.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload"))
    last = x.where(F.col("payload_bytes") >= least_bytes).groupBy(F.col("payload_digest").alias("last_digest")).agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    x = x.join(last, (F.col("payload_digest") == F.col("last_digest")) & (F.col("payload_bytes") >= least_bytes), "left")
    revisit = F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    return x.select(
        F.concat(
            F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(CRLF),
            header("WARC-Record-ID", record_id(F.col("page_id"))),
            header("WARC-Target-URI", F.col("url")),
            header("WARC-Date", F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            header("WARC-Refers-To", F.when(revisit, record_id(F.col("last_id")))),
            header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
            F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
            F.lit(CRLF + CRLF), block,
        ).alias("record")
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write gzip-compressed archives under ``path`` with Spark's writer, whose commit makes lost tasks harmless.

    Files roll over at about FILE_BYTES: after as many records as make that
    much at the mean size of a record, which digests deal to files at random.
    """
    mean = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit("")))).alias("n")).first()["n"] or 0
    (
        records(pages, least_bytes)
        .write.option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(1, int(FILE_BYTES // (mean + HEADER_BYTES))))
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records in an archive's bytes, by their Content-Length."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode("utf-8").split(CRLF)
        fields = dict(line.split(": ", 1) for line in lines[1:])
        begin, n = stop + 4, int(fields["Content-Length"])
        yield fields, data[begin : begin + n]
        at = begin + n + 4


def page_of(record: str) -> int | None:
    """The page_id in a record id."""
    if not record:
        return None
    v = int(record[-22:-1].replace("-", "")[-16:], 16)
    return v - 2**64 if v >= 2**63 else v


def url_key(url: str) -> str:
    """Sortable form of a URL: host labels from the right, then the rest, lower-cased."""
    m = re.match(r"[^:/?#]+://(?:[^@/?#]*@)?([^/?#:]*)(?::\d+)?(.*)", url, re.DOTALL)
    if not m:
        return url.lower()
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/").lower()


CAPTURE = "archive string, run_pos int, url_key string, timestamp string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archives under ``path``: each archive file gives one run, sorted by URL key, timestamp and page_id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64
        import hashlib

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for fields, block in parse(zlib.decompress(content, wbits=31)):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    kind = fields["WARC-Type"]
                    n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        n, digest = int(re.search(rb"Content-Length: (\d+)", head)[1]), said
                    elif digest != said:
                        raise ValueError(f"{name}: a payload's digest is {digest}, its record says {said}")
                    rows.append((url_key(fields.get("WARC-Target-URI", "")), re.sub(r"\D", "", fields.get("WARC-Date", "")), page_of(fields.get("WARC-Record-ID", "")), kind, n, digest, page_of(fields.get("WARC-Refers-To", ""))))
                rows.sort(key=order)
                frame = pd.DataFrame(rows, columns=["url_key", "timestamp", "page_id", "record_type", "payload_bytes", "payload_digest", "refers_to"]).astype({"page_id": "Int64", "refers_to": "Int64"})
                frame.insert(0, "archive", name.rpartition("/")[2])
                frame.insert(1, "run_pos", range(len(rows)))
                yield frame

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("path", "content").mapInPandas(run, CAPTURE)


def order(row: tuple) -> tuple:
    """Sort key of (url_key, timestamp, page_id, ...); code points as Spark's bytes, null ids first."""
    return row[0].encode("utf-8"), row[1], row[2] is not None, row[2] or 0


class LoserTree:
    """Merge of k sorted runs: inner nodes keep the loser of each match, so a step replays one path."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._build(1)

    def _key(self, run: int) -> tuple:
        """The key of a run's next row; ended runs sort last, equal keys go by run."""
        if run < 0 or run >= len(self.runs) or self.at[run] >= len(self.runs[run]):
            return (1,)
        return 0, self.runs[run][self.at[run]][0], run

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._key(b) < self._key(a):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while len(self._key(self.winner)) > 1:
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.k) // 2
            while node >= 1:
                if self._key(self.losers[node]) < self._key(run):
                    run, self.losers[node] = self.losers[node], run
                node //= 2
            self.winner = run


MERGED = f"{CAPTURE}, index_part int, index_pos long"


def merge_index(captures: DataFrame) -> DataFrame:
    """All captures in global order by URL key, timestamp and page_id; index_part and index_pos number them.

    Each task merges its key range of every run by a loser tree. Ranges are cut
    by the whole key, then by archive and place, so one URL with a third of all
    captures, or one capture repeated so often, spans many of them, and hold about MERGE_ROWS rows whatever the table's size. ``captures``
    is computed once before, since range bounds take a sample of it.
    """
    captures = cut(captures)
    parts = max(1, -(-captures.count() // MERGE_ROWS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                key = order((row.url_key, row.timestamp, None if pd.isna(row.page_id) else int(row.page_id)))
                runs.setdefault(row.archive, []).append((key, tuple(row)))
        merged = [row for _, row in LoserTree(list(runs.values()))]
        if merged:
            frame = pd.DataFrame(merged, columns=[c.split()[0] for c in CAPTURE.split(", ")]).astype({"page_id": "Int64", "refers_to": "Int64"})
            frame["index_part"] = TaskContext.get().partitionId()
            frame["index_pos"] = range(len(frame))
            yield frame

    ranged = captures.repartitionByRange(parts, "url_key", "timestamp", "page_id", "archive", "run_pos").sortWithinPartitions("archive", "run_pos")
    return ranged.mapInPandas(run, MERGED)


def archive_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html, captured) as archives under ``path`` and return the merged index read back from them.

    Null html is an empty payload, a null url leaves its header out and has an
    empty URL key, a null page_id is neither referred to nor returned as other
    than null (such a row revisits the largest page_id with its payload, if
    any), a null capture time has an empty timestamp. A payload may be as long as
    a string can be; its archive is as large then. Repeated rows are records
    of their own; equal page_ids with equal payloads are all responses if
    theirs is the largest. Ties in the whole key go by archive and place. Extra columns aren't archived; no
    pages, no rows.
    """
    write_archives(pages, path, least_bytes)
    return merge_index(capture_runs(pages.sparkSession, path))
