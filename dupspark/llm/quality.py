"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax, stochastic gradient descent."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import BASE, MIX, bounded_batches, bounded_sample, byte_blocks, extended, fold_of, runs, span_hashes

BUCKETS, GRAMS, SIZE = 1 << 17, (3, 4), 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(data: np.ndarray, offsets: np.ndarray):
    """Yields (starts, buckets) for each kind of feature, starts ascending; a feature belongs to the row that holds its start.

    Words are runs of non-space bytes. Word pairs are hashed too; all pairs of a word with itself share bucket 0. Character n-grams are byte n-grams, those at a row's end reach into the next row
    and are masked by a bucket of -1.
    """
    starts, stops, rows = runs(~_SPACE[data], offsets)
    words = span_hashes(data, starts, stops)
    yield starts, (words >> np.uint64(47)).astype(np.int64)
    if len(words) > 1:
        with np.errstate(over="ignore"):
            pairs = ((words[:-1] * np.uint64(MIX) + words[1:]) * np.uint64(BASE) >> np.uint64(47)).astype(np.int64)
        pairs[words[1:] == words[:-1]] = 0
        pairs[rows[1:] != rows[:-1]] = -1
        yield starts[:-1], pairs
    wide = data.astype(np.uint32)
    for n in GRAMS:
        if len(data) >= n:
            key = np.zeros(len(data) - n + 1, np.uint32)
            for j in range(n):
                key |= wide[j : len(data) - n + 1 + j] << np.uint32(8 * j)
            with np.errstate(over="ignore"):
                key = (key * np.uint32(2654435761 + 2 * n)) >> np.uint32(15)
            buckets = key.astype(np.int64)
            for end in range(1, n):
                late = offsets[1:] - end
                buckets[late[(late >= 0) & (late < len(buckets)) & (late >= offsets[:-1])]] = -1
            yield np.arange(len(buckets)), buckets


@dataclass
class SubwordNet:
    """vectors: one a bucket; out: two columns, one a class. Rows without a feature have the mean vector zero."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row. The mean of vectors times out is the mean of vector-times-out, so one number a bucket does."""
        worth = np.append((self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64), 0.0)
        total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
        for starts, buckets in features(data, offsets):
            sums = np.concatenate([[0.0], np.cumsum(worth[buckets])])
            seen = np.concatenate([[0], np.cumsum(buckets >= 0)])
            at = np.searchsorted(starts, offsets) if len(starts) != len(data) else np.minimum(offsets, len(starts))
            at = np.minimum(at, len(starts))
            total += sums[at[1:]] - sums[at[:-1]]
            count += seen[at[1:]] - seen[at[:-1]]
        z = total / np.maximum(count, 1) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def step(net: SubwordNet, buckets: np.ndarray, counts: np.ndarray, label: int, rate: float) -> None:
    """One text's step against the gradient of its loss; the two columns and their bias move by smaller parts of the rate."""
    share = counts / max(1, counts.sum())
    mean = share @ net.vectors[buckets]
    z = mean @ net.out + net.bias
    p = np.exp(z - z.max())
    p /= p.sum()
    p[label] -= 1
    vectors = share[:, None] * (net.out @ p)[None, :]
    net.out -= 0.01 * rate * np.outer(mean, p)
    net.bias -= 0.002 * rate * p
    if len(buckets):
        net.vectors[buckets] -= rate * vectors


def train(texts: list[bytes], labels: list[int], epochs: int = 8, rate: float = 30.0, seed: int = 11) -> SubwordNet:
    """Text by text, in a new order each epoch; classes weigh as their counts do, so that scores stay calibrated."""
    rng = np.random.default_rng(seed)
    net = SubwordNet(rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)), np.zeros((SIZE, 2)), np.zeros(2))
    bags = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        found = [b[b >= 0] for _, b in features(data, np.array([0, len(data)]))]
        bags.append(np.unique(np.concatenate(found), return_counts=True))
    net.out[:] = rng.normal(0, 0.5, net.out.shape)
    if len(set(labels)) == 1:  # one class only: its share, smoothed
        net.out[:], net.bias[labels[0]] = 0, np.log(len(labels) + 1)
        return net
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            buckets, counts = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            step(net, buckets, counts, labels[i], now)
    return net


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_label: int, most_bytes: int = 12 << 20) -> tuple[list[bytes], list[int]]:
    """A bounded sample of labelled texts outside the held-out fold, whole ones: at most per_label documents a class, by a
    hash of doc_id, and most_bytes in all.

    Of several labels of a document the largest counts; null labels and null ids are left out. Texts are taken in the
    order of their hashes; one that doesn't fit in what is left of most_bytes is passed over, and so are rows beyond
    4 * per_label where ids repeat. The chosen ids are few, so they are broadcast; sizes come to the driver first, then
    only the texts that fit.
    """
    marks = labels.where(F.col(label).isNotNull() & (fold_of("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))
    few = bounded_sample(marks.where("_y in (0, 1)"), "_y", "doc_id", per_label)
    few = docs.sparkSession.createDataFrame(few.select("doc_id", "_y").collect(), few.select("doc_id", "_y").schema)
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("b")).join(F.broadcast(few), "doc_id")
    named = texts.select("doc_id", F.xxhash64("doc_id").alias("at"), F.xxhash64("b").alias("h"), F.octet_length("b").alias("n"))
    fit, room = [], most_bytes
    for r in named.distinct().orderBy("at", "doc_id", "h", "n").limit(4 * per_label).collect():
        if r.n <= room:
            fit.append((r.doc_id, r.h))
            room -= r.n
    if not fit:
        return [], []
    chosen = docs.sparkSession.createDataFrame(fit, few.select("doc_id", F.lit(0).cast("long").alias("h")).schema)
    found = texts.withColumn("h", F.xxhash64("b")).join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"])
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "h").collect()
    return [bytes(r.b) for r in rows], [r._y for r in rows]


def apply_scores(docs: DataFrame, net, keep: list[str], text: str = "text") -> DataFrame:
    """The columns to keep beside score; net is a dataclass with scores(data, offsets). Null texts count as empty."""
    bounded_batches(docs.sparkSession)
    kind, shared = type(net), docs.sparkSession.sparkContext.broadcast(vars(net))
    kept = docs.select(*keep)

    def score(batches):
        net = kind(**shared.value)
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(batch, "_bytes"):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(net.scores(data, offsets))], [*keep, "score"])

    return docs.select(*keep, F.col(text).cast("binary").alias("_bytes")).mapInArrow(score, extended(kept, "score", T.DoubleType()))


def quality_of(docs: DataFrame, labels: DataFrame, per_label: int = 1500, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), from labels(doc_id, quality).

    Rows whose crc32(doc_id) mod 5 is 0 are held out. Null doc_id: held_out is null. Without any label the score is 0.5
    or near it. Null and empty texts get the bias alone. Repeated rows are scored each, an empty table gives no rows;
    other columns are not read.
    """
    texts, marks = labelled(docs, labels, "quality", per_label)
    net = train(texts, marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", 5) == 0).alias("held_out"), "text")
    got = apply_scores(rows, net, ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
