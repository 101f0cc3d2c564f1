"""Hard-negative mining by distributed radix selection.

For a block of anchors at a time every row is scored in the tasks that read it,
and only histograms leave them: counts of scores by bucket for each window, a
window being an anchor, or an anchor and one of its positives. The bucket that
holds the kth score is refined digit by digit until the kth score is known, and
only then the qualifying rows are gathered. Scores are never stored, rows are
never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.shared import numbered
from .common import scratch

#: Anchors a block: bounds what tasks and the driver hold, whatever the number of anchors. A block reads all rows once a digit.
BLOCK = 1024
#: Buckets a digit.
BUCKETS = 1024
#: Rows scored at once in a task.
SLICE = 1024
#: Components are scaled by this and rounded down; scaled components are below 2 ** LARGEST in size, so that scores fit a long.
SCALE, LARGEST = 256, 24


def eligible(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part."""
    fit = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float(2**LARGEST // SCALE), F.lit(False)))
    return vectors.where("vec_id is not null and label is not null and embedding is not null").where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Scaled vectors as rows of whole numbers, cut to ``width`` or filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    ends = np.cumsum(sizes)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        out[i, : min(size, width)] = values[end - size : end][:width]
    return out


class Block:
    """A block of anchors, as every task holds it."""

    def __init__(self, rows: list, width: int):
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.labels = np.array([r["label"] for r in rows], dtype=np.int64)
        self.width = width
        self.vectors = _matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), width)

    def scored(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, labels and scores (row by anchor) of slices of a batch."""
        ids, labels, column = (batch.column(i) for i in range(3))
        for at in range(0, batch.num_rows, SLICE):
            vectors = _matrix(column.slice(at, SLICE), self.width)
            largest = max(1.0, np.abs(vectors).max(initial=0)) * max(1.0, np.abs(self.vectors).max(initial=0)) * max(1, self.width)
            if largest < 2**53:  # then sums of doubles are exact
                scores = (vectors @ self.vectors.T).astype(np.int64)
            else:
                scores = vectors.astype(np.int64) @ self.vectors.T.astype(np.int64)
            yield ids.slice(at, SLICE).to_numpy(), labels.slice(at, SLICE).to_numpy(), scores


class Windows:
    """Score windows over a block's anchors, each with the interval that still holds its kth score.

    ``low`` and ``high`` bound the window, ``left`` rows are still to be found
    between ``from_`` and ``to``; better scores are known to qualify.
    """

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, same_label: bool, k: int):
        self.anchor, self.low, self.high, self.same_label, self.k = anchor, low, high, same_label, k
        self.from_, self.to, self.left = low.copy(), high.copy(), np.full(len(anchor), k, dtype=np.int64)
        self.done = low > high

    def widths(self) -> np.ndarray:
        return np.maximum(1, -(-(self.to - self.from_ + 1) // BUCKETS))

    def hits(self, block: Block, low: np.ndarray, high: np.ndarray, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, score, id) of the rows of a batch whose score lies within low and high of a window."""
        by_anchor = np.argsort(self.anchor, kind="stable")
        starts = np.searchsorted(self.anchor[by_anchor], np.arange(len(block.ids) + 1))
        many = np.diff(starts)
        least, most = np.full(len(block.ids), np.iinfo(np.int64).max), np.full(len(block.ids), np.iinfo(np.int64).min)
        np.minimum.at(least, self.anchor, np.where(low <= high, low, np.iinfo(np.int64).max))
        np.maximum.at(most, self.anchor, np.where(low <= high, high, np.iinfo(np.int64).min))
        for ids, labels, scores in block.scored(batch):
            fits = (scores >= least) & (scores <= most) & ((labels[:, None] == block.labels) == self.same_label) & (ids[:, None] != block.ids)
            row, anchor = np.nonzero(fits)
            score = scores[row, anchor]
            for nth in range(many.max(initial=0)):  # the nth window of each anchor
                own = many[anchor] > nth
                window = by_anchor[starts[anchor[own]] + nth]
                inside = (score[own] >= low[window]) & (score[own] <= high[window])
                yield window[inside], score[own][inside], ids[row[own][inside]]


def _refined(rows: DataFrame, block: Block, windows: Windows) -> None:
    """One digit: a histogram of the open intervals over all rows, then the bucket that holds the kth score."""
    spark, widths, low = rows.sparkSession, windows.widths(), np.where(windows.done, 1, windows.from_)
    high = np.where(windows.done, 0, windows.to)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(widths) * BUCKETS, dtype=np.int64)
        for batch in batches:
            for window, score, _ in windows.hits(block, low, high, batch):
                place, n = np.unique(window * BUCKETS + (high[window] - score) // widths[window], return_counts=True)
                held[place] += n
        found = np.nonzero(held)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found // BUCKETS), pa.array(found % BUCKETS), pa.array(held[found])], ["window", "bucket", "n"])

    counts = rows.mapInArrow(count, "window long, bucket long, n long").groupBy("window", "bucket").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("window").orderBy("bucket")
    left = spark.createDataFrame([(int(i), int(windows.left[i])) for i in np.nonzero(~windows.done)[0]], "window long, wanted long")
    summed = counts.withColumn("upto", F.sum("n").over(upto)).join(F.broadcast(left), "window")
    kth = {r["window"]: (r["bucket"], r["before"]) for r in summed.where("upto >= wanted and upto - n < wanted").select("window", "bucket", (F.col("upto") - F.col("n")).alias("before")).collect()}
    for i in np.nonzero(~windows.done)[0]:
        if int(i) not in kth:  # fewer rows than wanted: all qualify
            windows.done[i], windows.to[i], windows.left[i] = True, windows.from_[i], windows.k
            continue
        bucket, before = kth[int(i)]
        windows.to[i] -= bucket * widths[i]
        windows.from_[i] = max(windows.from_[i], windows.to[i] - widths[i] + 1)
        windows.left[i] -= before
        windows.done[i] = windows.from_[i] == windows.to[i]


def _selected(rows: DataFrame, block: Block, windows: Windows) -> DataFrame:
    """(window, nth, score, vec_id): the k best rows of each window, by score and then the smaller id."""
    while not windows.done.all():
        _refined(rows, block, windows)
    kth, left, k = windows.from_, windows.left, windows.k

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows above the kth score, fewer than k a window; of those at it the least ids of the task."""
        held = np.zeros((0, 3), dtype=np.int64)
        for batch in batches:
            for window, score, ids in windows.hits(block, kth, windows.high, batch):
                held = np.concatenate([held, np.stack([window, score, ids], axis=1)])
                held = held[np.lexsort((held[:, 2], -held[:, 1], held[:, 0]))]
                begins = np.searchsorted(held[:, 0], held[:, 0])
                held = held[np.arange(len(held)) - begins < k]
        yield pa.RecordBatch.from_arrays([pa.array(held[:, i]) for i in range(3)], ["window", "score", "vec_id"])

    best = W.partitionBy("window").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(gather, "window long, score long, vec_id long")
    return found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)


def _mined(rows: DataFrame, block: Block, bound: int, k_positives: int, k_negatives: int, least_percent: int) -> DataFrame:
    everywhere = np.arange(len(block.ids))
    positives = _selected(rows, block, Windows(everywhere, np.full(len(everywhere), -bound), np.full(len(everywhere), bound), True, k_positives)).collect()
    positives.sort(key=lambda r: (r["window"], r["nth"]))
    anchor, score = (np.array([r[c] for r in positives], dtype=np.int64) for c in ("window", "score"))
    # least_percent * p <= 100 * n <= 100 * p, in whole numbers
    windows = Windows(anchor, -(-least_percent * score // 100), score, False, k_negatives)
    pairs = [(i, int(block.ids[r["window"]]), r["vec_id"], r["score"]) for i, r in enumerate(positives)]
    named = rows.sparkSession.createDataFrame(pairs, "window long, anchor_id long, positive_id long, positive_score long")
    found = _selected(rows, block, windows).withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    return found.join(F.broadcast(named), "window").select("anchor_id", "positive_id", F.col("nth").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def mine_negatives(
    vectors: DataFrame, is_anchor: str = "vec_id % 100 = 0", k_positives: int = 5, k_negatives: int = 5, least_percent: int = 80
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows of vec_id, label, embedding.

    An anchor's positives are its ``k_positives`` best other rows of the same
    label; a positive's negatives are the best rows of another label that score
    from ``least_percent`` to 100 percent of the positive. Scores are inner
    products of the scaled components, ties go to the smaller id.

    Rows without id or label, without vector, or with a component that is null,
    not finite or of 2 ** 16 and more in size take no part. Vectors of another
    length than the anchor's count as cut or filled up with zeros. Repeated
    rows are rows of their own, but an id is one anchor (of differing rows the
    one with the least label and vector) and never its own positive or
    negative. Further columns aren't read, whatever their names; without
    anchors, positives or negatives there are no rows.
    """
    spark, rows = vectors.sparkSession, eligible(vectors)
    anchors = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding")
    dealt, path = numbered(anchors, "vec_id"), scratch(spark, "negatives")
    n, width = dealt.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    # no score is larger than the square of the longest vector's length
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + F.pow(F.floor(SCALE * x).cast("double"), F.lit(2.0)))
    bound = int((rows.agg(F.max(squares)).first()[0] or 0) * 1.000001) + 1
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    empty.write.parquet(path)
    for at in range(0, n, BLOCK):
        block = Block(dealt.where(f"nth > {at} and nth <= {at + BLOCK}").orderBy("nth").collect(), width)
        _mined(rows, block, bound, k_positives, k_negatives, least_percent).write.mode("append").parquet(path)
    return spark.read.schema(empty.schema).parquet(path)
