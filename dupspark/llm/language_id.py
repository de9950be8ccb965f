"""Language ID by a byte convolutional network: filters of several widths, max pooling over a window, softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from .common import bounded_batches, bounded_sample, byte_blocks, fold_of, released

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
REACH = max(WIDTHS) - 1


@dataclass
class ByteNet:
    """taps: for each width, one table (byte, filter) an offset, so a convolution is a sum of table rows."""

    labels: list[str]
    taps: list[np.ndarray]  # (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    weights: np.ndarray  # (len(WIDTHS) * FILTERS, labels)
    offset: np.ndarray

    def pooled(self, cells: np.ndarray) -> np.ndarray:
        """Features of the windows in a flat array of WINDOW-sized pieces; a filter may look REACH bytes past its window."""
        n = len(cells) // WINDOW
        idx = np.concatenate([cells, np.zeros(REACH, np.uint8)]).astype(np.intp)
        out = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        acc, row = np.empty((len(cells), FILTERS), np.float32), np.empty((len(cells), FILTERS), np.float32)
        for k, table in enumerate(self.taps):
            np.take(table[0], idx[: len(cells)], axis=0, out=acc, mode="clip")
            for j in range(1, len(table)):
                acc += np.take(table[j], idx[j : j + len(cells)], axis=0, out=row, mode="clip")
            out[:, k * FILTERS : (k + 1) * FILTERS] = acc.reshape(n, WINDOW, FILTERS).max(axis=1) + self.bias[k]
        return np.maximum(out, 0)

    def log_probabilities(self, cells: np.ndarray) -> np.ndarray:
        z = self.pooled(cells) @ self.weights + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def padded_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes from a window border on, with at least REACH zeros after them; the n + 1 window numbers of the rows."""
    counts = (np.diff(offsets) + REACH + WINDOW - 1) // WINDOW
    first = np.concatenate([[0], np.cumsum(counts)])
    cells = np.zeros(first[-1] * WINDOW, np.uint8)
    for at, lo, hi in zip((first[:-1] * WINDOW).tolist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        cells[at : at + hi - lo] = data[lo:hi]
    return cells, first


def train(windows: list[bytes], labels: list[str], rounds: int = 8, seed: int = 7) -> ByteNet:
    """Adam on windows of at most WINDOW bytes; labels weigh equally. No window gives a net with the one label 'und'."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels)) or ["und"]
    width = len(WIDTHS) * FILTERS
    net = ByteNet(
        names, [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros((len(WIDTHS), FILTERS), np.float32),
        rng.normal(0, 0.3, (width, len(names))).astype(np.float32), np.zeros(len(names), np.float32),
    )
    if len(names) < 2:
        return net
    x, y = np.zeros((len(windows), WINDOW), np.uint8), np.array([names.index(label) for label in labels])
    for row, window in zip(x, windows, strict=True):
        row[: len(window)] = np.frombuffer(window, np.uint8)
    each = 1 / np.bincount(y, minlength=len(names))
    params = [*net.taps, net.bias, net.weights, net.offset]
    m, v, t, size = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 128
    for epoch in range(rounds):
        for at in range(0, len(x), size):
            if at == 0:
                order = rng.choice(len(x), len(x), p=each[y] / each[y].sum())
            rows = order[at : at + size]
            b = np.pad(x[rows], ((0, 0), (0, REACH))).astype(np.intp)
            best, feats = [], []
            for table in net.taps:
                a = sum(table[j][b[:, j : j + WINDOW]] for j in range(len(table)))
                best.append(a.argmax(axis=1))
                feats.append(np.take_along_axis(a, best[-1][:, None], axis=1)[:, 0])
            pre = np.stack(feats, 1) + net.bias
            hidden = np.maximum(pre, 0).reshape(len(rows), -1)
            z = hidden @ net.weights + net.offset
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            back = (p @ net.weights.T).reshape(pre.shape) * (pre > 0)
            grads = []
            for k, table in enumerate(net.taps):
                g = np.zeros_like(table)
                for j in range(len(table)):
                    at_byte = np.take_along_axis(b, best[k] + j, axis=1)
                    np.add.at(g[j], (at_byte, np.arange(FILTERS)[None, :]), back[:, k])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            t += 1
            rate = 0.02 * (1 - epoch / rounds)
            for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                q -= (rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-7)).astype(np.float32)
    return net


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_label: int = 800, most_bytes: int = 3 << 20, most_rows: int = 1 << 15) -> ByteNet:
    """Trains on all windows of a bounded sample of whole texts: at most per_label of each non-null label, chosen by a hash of
    the key, and most_bytes and most_rows in all.

    Every label's first text comes before any label's second; a text that doesn't fit in what is left of most_bytes is passed
    over. Sizes come to the driver first, then only the texts that fit.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(lang).alias("label"), F.col(text).cast("binary").alias("b"))
    known = known.withColumn("h", F.xxhash64("b"))
    few = bounded_sample(known.select("label", "k", "h", F.octet_length("b").alias("n")), "label", "k", per_label)
    turn = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("sample"), F.col("k")), "k", "h"))
    fits, room = set(), most_bytes
    for r in few.withColumn("turn", turn).orderBy("turn", "label", "k", "h").limit(most_rows).collect():
        if r.n <= room and (r.label, r.k, r.h) not in fits:
            fits.add((r.label, r.k, r.h))
            room -= r.n
    if not fits:
        return train([], [])
    chosen = docs.sparkSession.createDataFrame(sorted(fits, key=repr), few.select("label", "k", "h").schema)
    same = [F.col("label") == F.col("_label"), F.col("k").eqNullSafe(F.col("_k")), F.col("h") == F.col("_h")]
    found = known.join(F.broadcast(chosen.toDF("_label", "_k", "_h")), same, "left_semi").dropDuplicates(["label", "k", "h"]).orderBy("label", "k", "h").collect()
    windows = [(bytes(r.b[at : at + WINDOW]), r.label) for r in found for at in range(0, len(r.b), WINDOW)]
    return train([w for w, _ in windows], [label for _, label in windows])


def predict(docs: DataFrame, net: ByteNet, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns of docs (all, or those to keep) beside lang_pred and score: the mean log-probability over all windows of the whole text picks the label.

    score is the label's probability after softmax of those means. Null texts and texts without a letter get 'und', 0.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vars(net))
    keep = docs.columns if keep is None else keep
    sent = [*keep, *([] if text in keep else [text])]
    rows = docs.select(*sent, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"))

    def score(batches):
        net = ByteNet(**shared.value)
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(batch, text, 1 << 20):
                part = batch.slice(lo, hi - lo)
                cells, first = padded_windows(data, offsets)
                sums = np.zeros((hi - lo, len(net.labels)))
                for at in range(0, len(cells), WINDOW * 2048):
                    got = net.log_probabilities(cells[at : at + WINDOW * 2048]).astype(np.float64)
                    row = np.searchsorted(first, np.arange(at // WINDOW, at // WINDOW + len(got)), side="right") - 1
                    np.add.at(sums, row, got)
                means = sums / np.diff(first)[:, None]
                p = np.exp(means - means.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                letter = np.asarray(part.column(len(sent)))
                said = [net.labels[k] if ok else "und" for k, ok in zip(best.tolist(), letter, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(said, pa.string()), pa.array(np.where(letter, p.max(axis=1), 0.0))], [*keep, "lang_pred", "score"])

    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(released(score), schema)


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs(doc_id, text, lang).

    Only rows whose crc32(doc_id) mod 4 is not 2 train. Null doc_id: held_out is null and the row does not train. An
    empty table, or one without labels, predicts 'und'. Rows repeat as often as they come; other columns are not read.
    """
    fold = fold_of("doc_id", 4) == 2
    net = fit(docs.where(~fold))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "text")
    return predict(rows, net, keep=["doc_id", "held_out"])


def keep_known_language(docs: DataFrame, least: float = 0.35) -> DataFrame:
    """docs without the rows whose language stays undetermined: 'und', or a score below least. All columns stay.

    The least score is one that a text of any learned language passes; a label of docs that is wrong is no reason to drop. Null
    texts and those without a letter go, long texts are judged by all their windows, repeated rows stay or go together, an
    empty table stays empty.
    """
    net = fit(docs.where(~(fold_of("doc_id", 4) == 2)))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)])
    text = names[docs.columns.index("text")]
    got = predict(rows, net, text).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return got.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)])
