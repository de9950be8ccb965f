"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import fold_of, runs, span_hashes
from .quality import apply_scores, labelled

LENGTH, STRIDE, BITS, WORD, CHAR, STATE, ATT = 24, 12, 16, 6, 4, 8, 8
INPUT = WORD + CHAR
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, stops, hashes (A-Z as a-z) and rows. A word is a run of ASCII letters and bytes of other scripts."""
    low = _FOLD[data]
    starts, stops, rows = runs(_LETTER[data], offsets)
    return starts, stops, span_hashes(low, starts, stops), rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def gru(gates: np.ndarray, u: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, list]:
    """States (steps, windows, STATE) from the inputs' share of the gates (steps, windows, 3 * STATE); a dead step keeps the state."""
    h = np.zeros((gates.shape[1], STATE), np.float32)
    out, kept = np.empty((len(gates), gates.shape[1], STATE), np.float32), []
    for t, g in enumerate(gates):
        zr = sigmoid(g[:, : 2 * STATE] + h @ u[:, : 2 * STATE])
        z, r = zr[:, :STATE], zr[:, STATE:]
        c = np.tanh(g[:, 2 * STATE :] + (r * h) @ u[:, 2 * STATE :])
        z = z * live[t][:, None]
        kept.append((h, z, r, c))
        h = h + z * (c - h)
        out[t] = h
    return out, kept


def gru_back(d_out: np.ndarray, kept: list, u: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d_gates, d_u, d_h = np.zeros((*d_out.shape[:2], 3 * STATE), np.float32), np.zeros_like(u), np.zeros(d_out.shape[1:], np.float32)
    for t in reversed(range(len(d_out))):
        h, z, r, c = kept[t]
        d_h = d_h + d_out[t]
        d_c = d_h * z * (1 - c * c)
        d_z = d_h * (c - h) * z * (1 - z) * live[t][:, None]
        d_rh = d_c @ u[:, 2 * STATE :].T
        d_r = d_rh * h * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], axis=1)
        d_u[:, : 2 * STATE] += h.T @ d_gates[t][:, : 2 * STATE]
        d_u[:, 2 * STATE :] += (r * h).T @ d_c
        d_h = d_h * (1 - z) + d_rh * r + d_gates[t][:, : 2 * STATE] @ u[:, : 2 * STATE].T
    return d_gates, d_u


@dataclass
class Network:
    """p: word (2**BITS, WORD) and char (2**BITS, CHAR) vectors by hash, w* and u* of both directions, attention a, v, output o, b."""

    p: dict[str, np.ndarray]

    def inputs(self, data, starts, stops, hashes) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of the distinct words, and each word's place among them. A word's character part pools the vectors of its 4-grams."""
        _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        word = self.p["word"][(hashes[first] >> np.uint64(64 - BITS)).astype(np.intp)]
        return np.concatenate([word, gram_means(self.p["char"], *grams(data, starts[first], stops[first]))], axis=1), at

    def forward(self, x: np.ndarray, slots: np.ndarray):
        """Logits of windows; slots (LENGTH, windows) are rows of x, the last row being the empty word."""
        live = (slots < len(x) - 1).astype(np.float32)
        gf, gb = x @ self.p["wf"] + self.p["bf"], x @ self.p["wb"] + self.p["bb"]
        hf, kf = gru(gf[slots], self.p["uf"], live)
        hb, kb = gru(gb[slots[::-1]], self.p["ub"], live[::-1])
        h = np.concatenate([hf, hb[::-1]], axis=2)
        a = np.tanh(h @ self.p["a"])
        s = a @ self.p["v"] - 1e9 * (1 - live)
        w = np.exp(s - s.max(axis=0))
        w *= live
        w /= np.maximum(w.sum(axis=0), 1e-20)
        pooled = np.einsum("tn,tnk->nk", w, h)
        return pooled @ self.p["o"] + self.p["b"][0], (live, kf, kb, h, a, w, pooled)

    def backward(self, x, slots, cache, d_logit) -> tuple[dict, np.ndarray]:
        live, kf, kb, h, a, w, pooled = cache
        g = {"o": pooled.T @ d_logit, "b": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * self.p["o"][None, :]
        d_w = (h * d_pooled[None]).sum(axis=2)
        d_s = w * (d_w - (w * d_w).sum(axis=0))
        d_a = d_s[:, :, None] * self.p["v"] * (1 - a * a)
        g["v"] = np.tensordot(d_s, a, ([0, 1], [0, 1]))
        g["a"] = np.tensordot(h, d_a, ([0, 1], [0, 1]))
        d_h = w[:, :, None] * d_pooled[None] + d_a @ self.p["a"].T
        d_x = np.zeros_like(x)
        for d, k, d_out, order in (("f", kf, d_h[:, :, :STATE], slice(None)), ("b", kb, d_h[::-1, :, STATE:], slice(None, None, -1))):
            d_gates, g["u" + d] = gru_back(d_out, k, self.p["u" + d], live[order])
            at = slots[order].reshape(-1)
            flat = d_gates.reshape(-1, 3 * STATE)
            g["w" + d] = x[at].T @ flat
            g["b" + d] = flat.sum(axis=0)
            np.add.at(d_x, at, flat @ self.p["w" + d].T)
        return g, d_x

    def windows(self, data, offsets):
        """Word vectors (the empty word last), each word's vector, the row of each window, its first word, the end of its row's words, word hashes.

        Every row has a window, every word one or two.
        """
        starts, stops, hashes, rows = words_of(data, offsets)
        if len(starts):
            x, at = self.inputs(data, starts, stops, hashes)
        else:
            x, at = np.zeros((0, INPUT), np.float32), np.zeros(0, np.intp)
        x = np.concatenate([x, np.zeros((1, INPUT), np.float32)]).astype(np.float32)
        counts = np.bincount(rows, minlength=len(offsets) - 1)
        many = np.maximum(1, (counts - LENGTH + STRIDE - 1) // STRIDE + 1)
        row = np.repeat(np.arange(len(counts)), many)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        lead = np.cumsum(counts) - counts
        return x, at, row, lead[row] + nth * STRIDE, (lead + counts)[row], hashes

    def logits(self, x, at, begin, end, page: int = 2048) -> np.ndarray:
        """Of windows given by first word and end; their slots are laid out a page at a time, so a text may have any number."""
        parts = [self.forward(x, slots_of(at, begin[k : k + page], end[k : k + page], len(x) - 1))[0] for k in range(0, len(begin), page)]
        return np.concatenate([np.zeros(0, np.float32), *parts])

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest window probability of each row, over all overlapping windows of the whole text."""
        x, at, row, begin, end, _ = self.windows(data, offsets)
        z = self.logits(x, at, begin, end)
        best = np.maximum.reduceat(z, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])) if len(row) else z
        return sigmoid(np.clip(best.astype(np.float64), -50, 50))


def slots_of(at: np.ndarray, begin: np.ndarray, end: np.ndarray, empty: int) -> np.ndarray:
    """Rows of x of each window's words (LENGTH, windows); places at or after a window's end hold the empty word."""
    place = begin + np.arange(LENGTH)[:, None]
    inside = place < end
    slots = np.full(place.shape, empty, np.int32)
    slots[inside] = at[place[inside]]
    return slots


def grams(data, starts, stops) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte 4-grams of the spans, each span with a mark before it, and the number of grams of each span."""
    count = np.maximum(1, stops - starts - 2)
    owner = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    low = np.append(_FOLD[data], np.zeros(4, np.uint8)).astype(np.uint32)
    at, end = starts[owner] + nth - 1, stops[owner]
    key = np.where(nth == 0, ord("<"), low[np.maximum(at, 0)]).astype(np.uint32)
    for j in (1, 2, 3):
        key |= np.where(at + j < end, low[at + j], 0).astype(np.uint32) << np.uint32(8 * j)
    with np.errstate(over="ignore"):
        return ((key * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.intp), count


def gram_means(table: np.ndarray, found: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per span the sum of its grams' vectors over the root of their number."""
    if not len(count):
        return np.zeros((0, CHAR), np.float32)
    sums = np.add.reduceat(table[found], np.cumsum(count) - count, axis=0)
    return (sums / np.sqrt(count)[:, None]).astype(np.float32)


def contrast(parts, marks: np.ndarray) -> np.ndarray:
    """Per hashed key, how much likelier it is in a toxic text: the log ratio of document rates, zero where chance explains it.

    parts yields (keys, rows); all of a row's keys come in one part.
    """
    yes, no = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for keys, rows in parts:
        pair = np.unique(rows.astype(np.int64) << BITS | keys)
        row, key = pair >> BITS, pair & ((1 << BITS) - 1)
        yes += np.bincount(key[marks[row] == 1], minlength=1 << BITS)
        no += np.bincount(key[marks[row] == 0], minlength=1 << BITS)
    n1, n0 = max(1, (marks == 1).sum()), max(1, (marks == 0).sum())
    rate1, rate0 = yes / n1, no / n0
    z = (rate1 - rate0) / np.sqrt((rate1 * (1 - rate1) + 0.5 / n1) / n1 + (rate0 * (1 - rate0) + 0.5 / n0) / n0)
    return np.where(np.abs(z) > 3.5, np.log((yes + 0.5) / (n1 + 1)) - np.log((no + 0.5) / (n0 + 1)), 0).clip(-4, 4).astype(np.float32)


def train(texts: list[bytes], labels: list[int], steps: int = 300, again: int = 4, leaders: int = 8, seed: int = 13) -> Network:
    """Texts have labels, windows don't: each round the likeliest window of every text takes the text's label (Adam).

    Every `again` rounds all windows of the whole texts are scored; the rounds between choose among each text's `leaders`
    likeliest ones of then. Word and gram vectors start with the contrast of their document rates in the first component;
    all vectors are then learned.
    """
    rng = np.random.default_rng(seed)
    f = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    p = {"word": f(1 << BITS, WORD, s=0.05), "char": f(1 << BITS, CHAR, s=0.05), "a": f(2 * STATE, ATT, s=0.4), "v": f(ATT, s=0.4), "o": f(2 * STATE, s=0.4), "b": np.zeros(1, np.float32)}
    for d in "fb":
        p |= {"w" + d: f(INPUT, 3 * STATE, s=0.4), "u" + d: f(STATE, 3 * STATE, s=0.3), "b" + d: np.zeros(3 * STATE, np.float32)}
    net, y = Network(p), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        p["o"][:], p["b"][0] = 0, np.log((sum(labels) + 0.5) / (len(labels) - sum(labels) + 0.5)) if labels else 0
        return net
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, stops, hashes, rows = words_of(data, offsets)
    p["word"][:, 0] = contrast([((hashes >> np.uint64(64 - BITS)).astype(np.int64), rows)], y)
    cuts = np.searchsorted(rows, np.arange(0, len(texts) + 100, 100))

    def gram_parts():
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            found, count = grams(data, starts[lo:hi], stops[lo:hi])
            yield found, np.repeat(rows[lo:hi], count)

    p["char"][:, 0] = contrast(gram_parts(), y)
    x, at_word, all_rows, all_begin, all_end, _ = net.windows(data, offsets)
    distinct, first = np.unique(hashes, return_index=True)
    word_at = (distinct >> np.uint64(64 - BITS)).astype(np.intp)
    found, count = grams(data, starts[first], stops[first])
    lead = np.cumsum(count) - count
    del hashes, rows
    m, v, t = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}, 0
    batches = max(1, len(texts) // 128)
    rounds = max(12, -(-steps // batches))
    weight = np.sqrt(len(y) / 2 / np.where(y == 1, max(1, y.sum()), max(1, (1 - y).sum())))
    for n in range(rounds):
        x[:-1] = np.concatenate([p["word"][word_at], gram_means(p["char"], found, count)], axis=1)
        if n % again == 0:
            row, begin, end = all_rows, all_begin, all_end
        z = net.logits(x, at_word, begin, end)
        order = np.lexsort((-z, row))
        nth = np.arange(len(row)) - np.searchsorted(row, row)  # row ascends, so row[order] is row
        best, lead_rows = order[nth == 0], np.sort(order[nth < leaders])
        row, begin, end, best = row[lead_rows], begin[lead_rows], end[lead_rows], np.searchsorted(lead_rows, best)
        for part in np.array_split(rng.permutation(best), batches):
            used, inner = np.unique(slots_of(at_word, begin[part], end[part], len(x) - 1), return_inverse=True)
            words = used[used < len(distinct)]
            local = np.concatenate([x[used], np.zeros((1 if len(words) == len(used) else 0, INPUT), np.float32)])
            logit, cache = net.forward(local, inner.reshape(LENGTH, -1))
            d = ((sigmoid(logit) - y[row[part]]) * weight[row[part]] / len(part)).astype(np.float32)
            g, d_x = net.backward(local, inner.reshape(LENGTH, -1), cache, d)
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], word_at[words], d_x[: len(words), :WORD])
            owner = np.repeat(np.arange(len(words)), count[words])
            at = lead[words][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count[words]) - count[words], count[words])
            np.add.at(g["char"], found[at], (d_x[: len(words), WORD:] / np.sqrt(count[words])[:, None])[owner])
            t += 1
            rate = 0.015 * (1 - 0.7 * n / rounds)
            for k, q in p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                q -= (rate * (0.1 if k in ("word", "char") else 1) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    return net


def toxicity_of(docs: DataFrame, labels: DataFrame, per_label: int = 2000, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs(doc_id, text), from labels(doc_id, toxic).

    Rows whose crc32(doc_id) mod 5 is 0 are held out; null doc_id: held_out is null. A null or empty text has one empty
    window. Without labels of both kinds the score is their smoothed share. Repeated rows are scored each; an empty
    table gives no rows. Other columns are not read.
    """
    texts, marks = labelled(docs, labels, "toxic", per_label)
    net = train(texts, marks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", 5) == 0).alias("held_out"), "text")
    got = apply_scores(rows, net, ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
