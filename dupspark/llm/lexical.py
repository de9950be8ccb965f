"""Ranked lexical search: Block-Max MaxScore over compressed posting lists, shard by shard, then a merge of the shards' heaps."""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from .common import bounded_batches, byte_blocks, released, runs, span_hashes, written

#: Postings of a block; texts and bytes of a shard; item-term pairs of a batch of queries; documents of the first and of the longest window of a search.
BLOCK, SHARD_ROWS, SHARD_BYTES, MOST, WINDOWS = 32, 1 << 16, 64 << 20, 1 << 18, (1024, 16384)
#: What a term is made of: letters and digits of ASCII and every character above it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
INSIDE = np.array([c >= 128 or chr(c) in string.ascii_letters + string.digits for c in range(256)])
LOWER = np.array([ord(chr(c).lower()) if c < 128 else c for c in range(256)], np.uint8)
INDEX = "shard long, term binary, df long, total long, lasts binary, ends binary, tops binary, top_ends binary, data binary"
#: Steps of a 63-bit number's varint, seven bits each.
STEPS = [1 << (7 * k) for k in range(1, 9)]


def terms_of(text: Column) -> Column:
    """The terms of a text in order, repeats included, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative numbers, seven bits each and the high bit set on all but a number's last, and where each number ends."""
    size = 1 + np.searchsorted(STEPS, values, side="right")
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        has = size > k
        out[(ends - size)[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, ends


def numbers(data: np.ndarray) -> np.ndarray:
    """The numbers that varints() wrote."""
    last = np.flatnonzero(data < 128)
    starts = np.concatenate([[0], last[:-1] + 1])
    if len(last) == len(data):
        return data.astype(np.int64)
    nth = np.arange(len(data)) - np.repeat(starts, last - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * nth), starts)


class Vocabulary:
    """Terms that are asked for, found in a text by a hash of each span and told apart by their bytes."""

    def __init__(self, terms: list[bytes]):
        data = np.frombuffer(b"".join(terms), np.uint8)
        ends = np.cumsum([len(t) for t in terms]) if terms else np.zeros(0, np.int64)
        base = 0x9E3779B97F4A7C15
        while len(np.unique(h := span_hashes(data, ends - np.diff(ends, prepend=0), ends, base=base))) < len(terms):
            base = (base + 2) % (1 << 64)
        order = np.argsort(h)
        self.base, self.keys, self.at = base, h[order], order
        self.data, self.ends, self.sizes = data, ends, np.diff(ends, prepend=0)

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which spans are terms of this vocabulary, and which term each of them is."""
        if not len(self.keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = span_hashes(data, starts, stops, base=self.base)
        place = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[place] == h)
        term = self.at[place[hit]]
        same = self.sizes[term] == (stops - starts)[hit]
        hit, term = hit[same], term[same]
        size = self.sizes[term]
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        equal = data[np.repeat(starts[hit], size) + step] == self.data[np.repeat(self.ends[term] - size, size) + step]
        wrong = np.zeros(len(hit), bool)
        wrong[np.repeat(np.arange(len(hit)), size)[~equal]] = True
        return hit[~wrong], term[~wrong]


def slices(data: np.ndarray, offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A block of texts as it is, or one long text in pieces of about `most` bytes that end between two terms."""
    lo = 0
    while len(data) - lo > most and len(offsets) == 2:
        gap = np.flatnonzero(~INSIDE[data[lo + most : lo + 2 * most]])
        if not len(gap):
            most *= 2
            continue
        hi = lo + most + int(gap[0])
        yield data[lo:hi], np.array([0, hi - lo])
        lo = hi
    yield data[lo:], offsets if lo == 0 else np.array([0, len(data) - lo])


def lists_of(term: np.ndarray, doc: np.ndarray, tf: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """(term, df, lasts, ends, tops, top_ends, data) of postings in order of term and doc; n tells each document's terms.

    A block's data are its steps from document to document and then its counts, as varints; lasts has its last
    document, ends the end of its bytes. tops has the (tf, n) of a block that no other of the block beats in both, so
    the largest score of a block is one of theirs, whatever the collection's figures turn out to be.
    """
    firsts = np.flatnonzero(np.diff(term, prepend=-1))
    sizes = np.diff(np.append(firsts, len(term)))
    blocks = -(-sizes // BLOCK)
    nth = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = np.repeat(firsts, blocks) + nth * BLOCK
    count = np.minimum(np.repeat(sizes, blocks) - nth * BLOCK, BLOCK)
    step = np.diff(doc, prepend=-1)
    step[firsts] = doc[firsts] + 1
    block_of = np.repeat(np.arange(len(begin)), count)
    inside = np.arange(len(term)) - begin[block_of]
    at = 2 * begin[block_of] + inside
    values = np.empty(2 * len(term), np.int64)
    values[at], values[at + count[block_of]] = step, tf
    data, ends = varints(values)
    ends = ends[2 * (begin + count) - 1]
    keep = np.zeros(len(term), bool)
    order = np.lexsort((-tf, n[doc], block_of))
    for lo in range(0, len(begin), 4096):  # the running largest tf in order of n, a few thousand blocks at a time
        some = slice(int(begin[lo]), int(begin[min(lo + 4096, len(begin)) - 1] + count[min(lo + 4096, len(begin)) - 1]))
        grid = np.zeros((block_of[some.stop - 1] - lo + 1, BLOCK), np.int64)
        grid[block_of[some] - lo, inside[some]] = tf[order[some]]
        before = np.maximum.accumulate(np.pad(grid, ((0, 0), (1, 0)))[:, :-1], axis=1)
        keep[some] = (grid > before)[block_of[some] - lo, inside[some]]
    best = order[keep]
    tops = np.stack([tf[best], n[doc[best]]], axis=1).astype("<i4")
    top_ends = np.cumsum(np.bincount(block_of[keep], minlength=len(begin)))
    lasts = doc[begin + count - 1]
    cuts = np.cumsum(blocks)
    for k, t in enumerate(term[firsts]):
        a, b = int(cuts[k] - blocks[k]), int(cuts[k])
        byte, top = int(ends[a - 1]) if a else 0, int(top_ends[a - 1]) if a else 0
        yield int(t), int(sizes[k]), lasts[a:b].astype("<i4").tobytes(), (ends[a:b] - byte).astype("<i4").tobytes(), tops[top : top_ends[b - 1]].tobytes(), (top_ends[a:b] - top).astype("<i4").tobytes(), data[byte : ends[b - 1]].tobytes()


class Shard:
    """Texts of one task until they are enough: their ids, numbers of terms, and postings of a vocabulary."""

    def __init__(self, number: int):
        self.number, self.ids, self.n, self.parts, self.bytes = number, [], [], [], 0

    def add(self, ids: list, data: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> None:
        first, rows = len(self.n), len(offsets) - 1
        n = np.zeros(rows, np.int64)
        for piece, cuts in slices(data, offsets):
            starts, stops, row = runs(INSIDE[piece], cuts)
            n += np.bincount(row, minlength=rows)
            hit, term = vocabulary.find(LOWER[piece], starts, stops)
            both, tf = np.unique(row[hit] * len(vocabulary.sizes) + term, return_counts=True)
            if len(both):
                self.parts.append(np.stack([both % len(vocabulary.sizes), both // len(vocabulary.sizes) + first, tf]).astype(np.int32))
        self.ids += ids
        self.n += n.tolist()
        self.bytes += len(data)

    def full(self) -> bool:
        return len(self.n) >= SHARD_ROWS or self.bytes >= SHARD_BYTES

    def rows(self, terms: list[bytes]) -> pa.RecordBatch:
        """A row a term, and one without a term: how many texts have terms, the sum of these, and the ids (data, nulls in tops) and numbers of terms (ends) of texts with postings."""
        n = np.array(self.n, np.int64)
        term, doc, tf = np.concatenate([*self.parts, np.zeros((3, 0), np.int32)], axis=1).astype(np.int64)
        null = np.array([i is None for i in self.ids], bool)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        used = np.unique(doc)
        used = used[np.lexsort((ids[used], null[used], -n[used]))]  # the longest first: a block's documents are alike, which makes its bound tight
        place = np.zeros(len(n), np.int64)
        place[used] = np.arange(len(used))
        order = np.lexsort((place[doc], term))
        term, doc, tf = term[order], place[doc[order]], tf[order]
        if len(term):  # the pieces of a long text
            head = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
            term, doc, tf = term[head], doc[head], np.add.reduceat(tf, head)
        out = [(None, int((n > 0).sum()), int(n.sum()), None, n[used].astype("<i8").tobytes(), null[used].tobytes(), None, ids[used].astype("<i8").tobytes())]
        if len(term):
            out += [(terms[t], df, 0, lasts, ends, tops, top_ends, data) for t, df, lasts, ends, tops, top_ends, data in lists_of(term, doc, tf, n[used])]
        kinds = (pa.binary(), pa.int64(), pa.int64(), *[pa.binary()] * 5)
        columns = [pa.array([self.number] * len(out), pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in INDEX.split(", ")])


def build(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """The index of docs(doc_id, text) for the given terms, written to the shared folder: a row a shard and term, texts stay in their tasks."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        vocabulary = Vocabulary(terms)
        number = TaskContext.get().partitionId() << 24
        shard = Shard(number)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in byte_blocks(batch, "text"):
                shard.add(ids[lo:hi], data, offsets, vocabulary)
                if shard.full():
                    yield shard.rows(terms)
                    number += 1
                    shard = Shard(number)
        if shard.n:
            yield shard.rows(terms)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), INDEX))


@dataclass
class Postings:
    """A term's list in one shard; maxima holds the largest part of a score in each block."""

    lasts: np.ndarray
    ends: np.ndarray
    data: np.ndarray
    count: int
    maxima: np.ndarray

    def decoded(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and counts of the blocks `which`, in order."""
        begin, end = np.where(which > 0, self.ends[which - 1], 0), self.ends[which]
        values = numbers(self.data[begin[0] : end[-1]] if which[-1] - which[0] == len(which) - 1 else np.concatenate([self.data[a:b] for a, b in zip(begin, end, strict=True)]))
        base = np.where(which > 0, self.lasts[which - 1], -1)
        short = which[-1] == len(self.lasts) - 1 and self.count % BLOCK
        whole = len(which) - bool(short)
        steps, tf = values[: 2 * BLOCK * whole].reshape(whole, 2, BLOCK).transpose(1, 0, 2)
        docs, tf = (base[:whole, None] + np.cumsum(steps, axis=1)).ravel(), tf.ravel()
        if short:
            rest = values[2 * BLOCK * whole :].reshape(2, -1)
            docs, tf = np.concatenate([docs, base[-1] + np.cumsum(rest[0])]), np.concatenate([tf, rest[1]])
        return docs, tf


class Searcher:
    """The lists of a shard and what scores depend on: the collection's number of documents and of terms. rank tells the order of ids."""

    def __init__(self, n: np.ndarray, rank: np.ndarray, documents: int, total: int):
        self.documents, self.total, self.norm, self.rank, self.lists = documents, total, 20 * self.length(n, documents, total), rank, {}
        self.blocks_read = self.blocks_there = 0

    @staticmethod
    def length(n: np.ndarray, documents: int, total: int) -> np.ndarray:
        return 50 + (50 * n * documents) // max(total, 1)

    def add(self, term: bytes, lasts: bytes, ends: bytes, tops: bytes, top_ends: bytes, data: bytes, count: int) -> None:
        at = lambda b: np.frombuffer(b, "<i4").astype(np.int64)
        tf, n = at(tops).reshape(-1, 2).T
        parts = (10**9 * tf) // (1000 * tf + 20 * self.length(n, self.documents, self.total))
        maxima = np.maximum.reduceat(parts, np.append(0, at(top_ends)[:-1]))
        self.lists[term] = Postings(at(lasts), at(ends), np.frombuffer(data, np.uint8), count, maxima)

    def top(self, weights: list[tuple[bytes, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best documents for terms with weights, best first, the smaller rank first in a tie.

        Lists stand by ascending bound. Those whose bounds sum up to less than the kth score so far are non-essential:
        a document that only they have can't get in, while one that equals the kth score may have the smaller id. A window of documents adds up its essential lists; every
        candidate's bound then takes the block maxima of the others, and only blocks that a candidate still needs are
        read, the list of the highest bound first.
        """
        lists = sorted(((w * int(p.maxima.max()), w, p) for t, w in weights if w > 0 and (p := self.lists.get(t))), key=lambda x: x[0])
        bound = np.cumsum([x[0] for x in lists])
        docs, scores, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self.blocks_there += sum(len(p.lasts) for _, _, p in lists)
        lo, width = 0, WINDOWS[0]
        while lo < len(self.norm):
            hi = min(lo + width, len(self.norm))
            split = int(np.searchsorted(bound, least, side="right"))
            if split == len(lists):
                break
            spans = [(int(np.searchsorted(p.lasts, lo)), int(np.searchsorted(p.lasts, hi - 1)) + 1) for _, _, p in lists]
            spans = [(a, min(b, len(p.lasts))) for (a, b), (_, _, p) in zip(spans, lists, strict=True)]
            if sum(w * int(p.maxima[a:b].max()) for (a, b), (_, w, p) in zip(spans, lists, strict=True) if a < b) > least:
                sums = np.zeros(hi - lo, np.int64)
                for (a, b), (_, w, p) in zip(spans[split:], lists[split:], strict=True):
                    if a < b:
                        found, tf = p.decoded(np.arange(a, b))
                        self.blocks_read += b - a
                        some = slice(*np.searchsorted(found, [lo, hi]))
                        found, tf = found[some], tf[some]
                        sums[found - lo] += w * ((10**9 * tf) // (1000 * tf + self.norm[found]))
                found, score = self.refined(np.flatnonzero(sums) + lo, sums, lo, lists[:split], least)
                if len(found):
                    docs, scores = np.concatenate([docs, found]), np.concatenate([scores, score])
                    best = np.lexsort((self.rank[docs], -scores))[:k]
                    docs, scores = docs[best], scores[best]
                    least = int(scores[-1]) - 1 if len(scores) == k else 0
            lo, width = hi, WINDOWS[1]
        return docs, scores

    def refined(self, found: np.ndarray, sums: np.ndarray, lo: int, others: list, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates whose whole score is above `least`, with it."""
        score = sums[found - lo]
        upper, block = [], []
        for _, w, p in others:
            at = np.searchsorted(p.lasts, found)
            upper.append(np.where(at < len(p.lasts), w * p.maxima[np.minimum(at, len(p.lasts) - 1)], 0))
            block.append(at)
        if others:
            upper, block = np.array(upper), np.array(block)
            score = score + upper.sum(axis=0)
        keep = score > least
        found, score = found[keep], score[keep]
        for k in reversed(range(len(others))):
            upper, block = upper[:, keep], block[:, keep]
            _, w, p = others[k]
            need = np.unique(block[k])
            need = need[need < len(p.lasts)]
            real = np.zeros(len(found), np.int64)
            if len(need):
                docs, tf = p.decoded(need)
                self.blocks_read += len(need)
                at = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                hit = docs[at] == found
                tf = tf[at[hit]]
                real[hit] = w * ((10**9 * tf) // (1000 * tf + self.norm[found[hit]]))
            score = score + real - upper[k]
            keep = score > least
            found, score = found[keep], score[keep]
        return found, score


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best rows of docs(doc_id, text) for every item of queries(item_id, text), scores above 0 only.

    A text's terms are terms_of() it. With N texts that have terms, L terms in all, n of a text and df texts with a
    term: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 50 + 50nN div L, and an item's score is the sum of w * (10**9 tf
    div (1000 tf + 20m)) over its terms. Equal scores go by ascending doc_id, null last; rows that repeat a
    doc_id are ranked each. Null and empty texts have no terms and aren't found. Rows of one item_id, null too, are one
    item with the terms of all. Long texts are read in pieces. No documents or no queries: no rows.

    Items go in batches of about `most` item-term pairs, so what a task is sent is bounded (an item alone may be longer); every
    batch reads the documents once. A task makes shards of its texts and needs no shuffle of them; searching takes a
    task's shards one at a time, and a shard sends its k best of an item.
    """
    spark = docs.sparkSession
    asked = queries.select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    kind = asked.schema["item_id"].dataType
    number = max(1, -(-asked.count() // most))
    out = []
    for batch in range(number):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(number)) == batch).collect()
        terms = sorted({r.term.encode() for r in rows})
        index = build(docs, terms)
        figures = {None if r.term is None else bytes(r.term): (r.df, r.total) for r in index.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).collect()}
        documents, total = figures.pop(None, (0, 0))
        weight = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for t, (df, _) in figures.items()}
        items: dict = {}
        for r in rows:
            if r.term.encode() in weight:
                items.setdefault(r.item_id, []).append((r.term.encode(), weight[r.term.encode()]))
        out.append(index.groupBy("shard").applyInArrow(searching(items, documents, total, k, to_arrow_type(kind)), f"item_id {kind.simpleString()}, doc_id long, score long"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def searching(items: dict, documents: int, total: int, k: int, kind: pa.DataType):
    """The search of one shard's rows for all items."""

    def run(shard: pa.Table) -> pa.Table:
        head = shard.filter(pa.compute.is_null(shard["term"])).to_pylist()[0]
        ids, null = np.frombuffer(head["data"], "<i8"), np.frombuffer(head["tops"], bool)
        rank = np.argsort(np.lexsort((ids, null)))
        searcher = Searcher(np.frombuffer(head["ends"], "<i8"), rank, documents, total)
        for row in shard.filter(pa.compute.is_valid(shard["term"])).to_batches(max_chunksize=1024):
            for r in row.to_pylist():
                searcher.add(r["term"], r["lasts"], r["ends"], r["tops"], r["top_ends"], r["data"], r["df"])
        found = [(item, *searcher.top(weights, k)) for item, weights in items.items()]
        names = pa.array([item for item, docs, _ in found for _ in docs], kind)
        docs = np.concatenate([d for _, d, _ in found] + [np.zeros(0, np.int64)])
        score = np.concatenate([s for _, _, s in found] + [np.zeros(0, np.int64)])
        return pa.table([names, pa.array(ids[docs], mask=null[docs]), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


RANKED_SQL = rf"""
WITH a AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS t FROM documents),
     d AS (SELECT r, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM a WHERE len(t) > 0),
     c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
     q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) AS term FROM benchmark),
     u AS (SELECT r, doc_id, n, unnest(t) AS term FROM d),
     p AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term),
     f AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM p GROUP BY term),
     w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM f, c),
     s AS (SELECT item_id, r, doc_id, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY item_id, r, doc_id),
     k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
