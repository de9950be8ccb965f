"""Removal of repeated 50-byte passages by suffix arrays.

Windows of 50 bytes that are equal have the same smallest 24-byte gram, so a text falls into tiles: runs of windows
with one smallest gram, the tile's anchor. The texts become a bucketed table of blocks beside their tiles. One pass over it
finds the anchors that several documents have, a second the distinct tiles of those, told apart by 128 bits; a third
sends each distinct tile once to a suffix array of its anchor's tiles (suffix_groups), where equal windows are
neighbours and their bytes are compared. A last pass cuts the bytes.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import BASE, LONG_ROWS, MIX, bounded_batches, byte_blocks, runs, span_hashes, work_folder, written
from .suffix_groups import lay_out, suffix_arrays

WINDOW, GRAM = 50, 24
#: Bytes of a block of texts, windows of a tile at most (a mask is one long), tiles of one suffix array, table buckets at least.
BLOCK, TILE, PART, TABLE = 2 << 20, 32, 128, 48
NONE = (1 << 63) - 1  # stands for a null doc_id: larger than all


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of the n bytes from each place, by doubling."""
    with np.errstate(over="ignore"):
        now, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(BASE)
        out, have = None, 0
        while True:
            if n & width:
                if out is None:
                    out, have = now, width
                else:
                    size = len(now) - have
                    out = out[:size] * base + now[have:]
                    have += width
            if have == n:
                return out
            now = now[: len(now) - width] * base + now[width:]
            width, base = 2 * width, base * base


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(MIX)
        return h ^ (h >> np.uint64(29))


def tiles(data: np.ndarray, offsets: np.ndarray, page: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Of each tile, in order: its number of windows, and the place of its anchor after its first window's start (both uint8).

    A page of windows is looked at at a time. A tile ends at a row's or a page's end, or after TILE windows.
    """
    found = [(np.zeros(0, np.uint8), np.zeros(0, np.uint8))]
    for lo in range(0, max(0, len(data) - WINDOW + 1), page):
        part = data[lo : lo + page + WINDOW - 1]
        n = len(part) - WINDOW + 1
        gram, width, most = mixed(gram_hashes(part, GRAM)), 1, WINDOW - GRAM + 1
        low = gram
        while 2 * width <= most:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        if width < most:
            low = np.minimum(low[: width - most], low[most - width :])
        inside = np.zeros(n, bool)
        border = np.zeros(n, bool)
        ends = offsets - lo
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - WINDOW + 1 > 0 and a < n and b - a >= WINDOW:
                inside[max(a, 0) : b - WINDOW + 1] = True
                border[max(a, 0)] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | (low[1:] != low[:-1]) | border[1:]
        start = np.flatnonzero(begin)
        seen = np.concatenate([[0], np.cumsum(inside)])
        count = seen[np.r_[start[1:], n]] - seen[start]
        pieces = (count + TILE - 1) // TILE
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(start, pieces) + nth * TILE
        count = np.minimum(np.repeat(count, pieces) - nth * TILE, TILE)
        lead = np.concatenate([np.argmin(gram[at[:, None] + np.arange(most)], axis=1) for at in np.array_split(start, len(start) // 16384 + 1)])
        found.append((count.astype(np.uint8), lead.astype(np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def bucketed(anchors: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the anchors by hash bucket, those of one bucket as they come; the buckets that occur; the bounds of each in that order."""
    bucket = (anchors % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(order))


def in_buckets(replies: list, column: str, kind) -> np.ndarray:
    """The values of all replies to a block, in the order that `bucketed` gives its anchors."""
    return np.frombuffer(b"".join(r[column] for r in sorted(replies, key=lambda r: r["bucket"])), kind)


class Block:
    """A block of texts and, as far as the replies are there, what is known of its tiles."""

    COLUMNS = ("ids", "none", "ends", "data", "counts", "leads")

    def __init__(self, row: dict):
        kinds = (np.int64, bool, np.int64, np.uint8, np.uint8, np.uint8)
        self.ids, self.none, self.offsets, self.data, count, lead = (np.frombuffer(row[c], k) for c, k in zip(self.COLUMNS, kinds, strict=True))
        windows = np.maximum(np.diff(self.offsets) - WINDOW + 1, 0)
        upto = np.concatenate([[0], np.cumsum(windows)])
        self.count = count.astype(np.int64)
        nth = np.cumsum(self.count) - self.count
        self.row = np.searchsorted(upto, nth, side="right") - 1
        self.start = self.offsets[self.row] + nth - upto[self.row]
        at, h = self.start + lead, np.zeros(len(lead), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(GRAM):
                h = h * np.uint64(BASE) + self.data[at + j] + np.uint64(1)
        self.anchor = mixed(h)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors, those of two or more documents here, the place of each tile's anchor among them."""
        distinct, at = np.unique(self.anchor, return_inverse=True)
        ids = self.ids[self.row]
        least, most = np.full(len(distinct), NONE), np.full(len(distinct), -NONE)
        np.minimum.at(least, at, ids)
        np.maximum.at(most, at, ids)
        return distinct, least < most, at

    def share(self, replies: list) -> None:
        """Keeps the tiles whose anchor several documents have. Sorts: by anchor, 128-bit mark, document."""
        distinct, _, at = self.anchors()
        shared = np.zeros(len(distinct), bool)
        shared[bucketed(distinct, self.buckets(replies))[0]] = in_buckets(replies, "codes", bool)
        keep = np.flatnonzero(shared[at])
        stops = self.start[keep] + self.count[keep] + WINDOW - 1
        mark = np.stack([span_hashes(self.data, self.start[keep], stops, base=base) for base in (BASE, MIX)], axis=1)
        sort = np.lexsort((self.ids[self.row[keep]], mark[:, 1], mark[:, 0], self.anchor[keep]))
        keep, self.mark = keep[sort], mark[sort]
        self.start, self.count, self.row, self.anchor = (x[keep] for x in (self.start, self.count, self.row, self.anchor))
        new = np.ones(len(keep), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.mark[1:] != self.mark[:-1]).any(axis=1)
        self.first, self.tile = np.flatnonzero(new), np.cumsum(new) - 1

    def names(self, buckets: int) -> np.ndarray:
        """Names of the distinct shared tiles for other blocks: the hash bucket, and the place among this block's tiles of it."""
        order, found, ends = bucketed(self.anchor[self.first], buckets)
        names, n = np.empty(len(order), np.int64), np.diff(ends)
        names[order] = np.repeat(found << 32, n) | np.arange(len(order)) - np.repeat(ends[:-1], n)
        return names

    def answered(self, replies: list) -> tuple[np.ndarray, np.ndarray]:
        """Per distinct shared tile: whether its suffix array needs its text from here, and the smallest document that has it."""
        send, least = np.zeros(len(self.first), bool), np.zeros(len(self.first), np.int64)
        order = bucketed(self.anchor[self.first], self.buckets(replies))[0]
        send[order], least[order] = in_buckets(replies, "codes", bool), in_buckets(replies, "least", np.int64)
        return send, least

    @staticmethod
    def buckets(replies: list) -> int:
        return replies[0]["buckets"] if replies else 1


def blocks_of(docs: DataFrame) -> DataFrame:
    """The texts as a table of blocks (block and Block.COLUMNS), bucketed by block, so that later joins leave it in place.

    With fewer buckets than shuffle partitions Spark would rather shuffle both sides of those joins, texts included.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(TABLE, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def cut(batches):
        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, bytes]] = []

        def flush():
            nonlocal n, held
            ids, none, lengths = (np.concatenate([h[k] for h in held]) for k in range(3))
            data, ends = b"".join(h[3] for h in held), np.concatenate([[0], np.cumsum(lengths)])
            counts, leads = tiles(np.frombuffer(data, np.uint8), ends)
            out = pa.RecordBatch.from_arrays([pa.array([part << 32 | n]), *(pa.array([x], pa.binary()) for x in (packed(ids), packed(none), packed(ends), data, packed(counts), packed(leads)))], ["block", *Block.COLUMNS])
            n, held = n + 1, []
            return out

        size = 0
        for batch in batches:
            ids, none = batch.column(0).fill_null(NONE).to_numpy(zero_copy_only=False), np.asarray(batch.column(0).is_null())
            for lo, hi, data, offsets in byte_blocks(batch, "b", BLOCK):
                if held and size + len(data) > BLOCK:
                    yield flush()
                    size = 0
                held.append((ids[lo:hi], none[lo:hi], np.diff(offsets), data.tobytes()))
                size += len(data)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b"))
    table = f"text_blocks_{uuid.uuid4().hex}"
    cuts = rows.mapInArrow(cut, "block long, " + ", ".join(f"{c} binary" for c in Block.COLUMNS))
    cuts.write.options(**LONG_ROWS).option("path", work_folder(spark)).option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(table)
    found = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the name alone: found knows its files and buckets, which stay in the work folder
    return found


def by_block(replies: DataFrame, name: str) -> DataFrame:
    """One row a block: the replies of all hash buckets, a few kilobytes."""
    rest = [c for c in replies.columns if c != "block"]
    return replies.groupBy("block").agg(F.collect_list(F.struct(*rest)).alias(name))


def beside(blocks: DataFrame, *replies: DataFrame) -> DataFrame:
    for r in replies:
        blocks = blocks.join(r.hint("shuffle_hash"), "block", "left")
    return blocks


def rows_of(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def shared_anchors(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, buckets, codes): of each block's distinct anchors of a bucket, ascending, whether another document has it.

    A block sends a row for each bucket that it has an anchor of, so there are never more rows than distinct anchors in blocks.
    """

    def send(batches):
        for r in rows_of(batches):
            distinct, several, _ = Block(r).anchors()
            order, found, ends = bucketed(distinct, buckets)
            parts = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"block": np.full(len(found), r["block"]), "bucket": found, "h": pa.array([packed(distinct[p]) for p in parts], pa.binary()), "s": pa.array([packed(several[p]) for p in parts], pa.binary())})

    def reply(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["h"].map(len).to_numpy() // 8
        h, s = np.frombuffer(b"".join(rows["h"]), np.uint64), np.frombuffer(b"".join(rows["s"]), bool)
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = times > 1
        shared[at[s]] = True
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "buckets": buckets, "codes": [packed(shared[at[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]})

    sent = blocks.mapInArrow(send, "block long, bucket long, h binary, s binary")
    return sent.groupBy("bucket").applyInPandas(reply, "block long, bucket long, buckets long, codes binary")


def distinct_tiles(known: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, buckets, codes, least, ties): of each block's distinct shared tiles, whether it sends the text, and the smallest document.

    A tile's text is needed if its anchor has several distinct tiles; the block with the tile's smallest document sends it.
    Several blocks have that document if its doc_id is null or repeated: ties lists, for those that don't send, the tile's
    place here, the block that sends it, and its place there.
    """

    def send(batches):
        for r in rows_of(batches):
            b = Block(r)
            b.share(r["shared"] or [])
            order, found, ends = bucketed(b.anchor[b.first], buckets)
            parts = [b.first[order[x:y]] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            columns = {"h": [packed(b.anchor[p]) for p in parts], "m": [packed(b.mark[p]) for p in parts], "i": [packed(b.ids[b.row[p]]) for p in parts]}
            yield pa.RecordBatch.from_pydict({"block": np.full(len(found), r["block"]), "bucket": found} | {c: pa.array(x, pa.binary()) for c, x in columns.items()})

    def reply(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        sizes = rows["h"].map(len).to_numpy() // 8
        h, m, i = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("h", np.uint64), ("m", np.uint64), ("i", np.int64)))
        m = m.reshape(-1, 2)
        order = np.lexsort((i, m[:, 1], m[:, 0], h))
        anchor = np.ones(len(h), bool)
        anchor[1:] = h[order][1:] != h[order][:-1]
        tile = anchor.copy()
        tile[1:] |= (m[order][1:] != m[order][:-1]).any(axis=1)
        group, which = np.cumsum(anchor) - 1, np.cumsum(tile) - 1
        least, send = np.empty(len(h), np.int64), np.empty(len(h), bool)
        least[order] = i[order][tile][which] if len(h) else i
        needed = np.bincount(group, weights=tile)[group] > 1 if len(h) else tile
        send[order] = tile & needed
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        parts = list(zip(cuts[:-1], cuts[1:], strict=True))
        tied = np.flatnonzero(needed & ~tile & (i[order] == least[order]))
        here, there = order[tied], order[tile][which[tied]]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ties = np.stack([here - cuts[owner[here]], rows["block"].to_numpy(np.int64)[owner[there]], there - cuts[owner[there]]], axis=1)
        ties = ties[np.argsort(owner[here], kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner[here], minlength=len(sizes)))])
        return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "buckets": buckets, "codes": [packed(send[a:b]) for a, b in parts], "least": [packed(least[a:b]) for a, b in parts], "ties": [packed(ties[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    sent = known.mapInArrow(send, "block long, bucket long, h binary, m binary, i binary")
    return sent.groupBy("bucket").applyInPandas(reply, "block long, bucket long, buckets long, codes binary, least binary, ties binary")


def tied_tiles(found: DataFrame) -> DataFrame:
    """(from_block, from_tile, to_block, to_tile): which tile's mask holds for which tile of another block. Empty if doc_ids are unique."""

    def unpacked(batches):
        for r in rows_of(batches):
            t, bucket = np.frombuffer(r["ties"], np.int64).reshape(-1, 3), r["bucket"] << 32
            yield pa.RecordBatch.from_pydict({"from_block": t[:, 1], "from_tile": bucket | t[:, 2], "to_block": np.full(len(t), r["block"]), "to_tile": bucket | t[:, 0]})

    replies = found.select("block", F.explode("tiles").alias("r")).select("block", F.col("r.bucket").alias("bucket"), F.col("r.ties").alias("ties"))
    return replies.where("length(ties) > 0").mapInArrow(unpacked, "from_block long, from_tile long, to_block long, to_tile long")


def text_of_tiles(known: DataFrame) -> DataFrame:
    """(h, doc, block, tile, text) of the tiles that suffix arrays need."""

    def send(batches):
        for r in rows_of(batches):
            b = Block(r)
            b.share(r["shared"] or [])
            need, least = b.answered(r["tiles"] or [])
            k = np.flatnonzero(need)
            at, text = b.first[k], r["data"]
            texts = [text[s : s + n + WINDOW - 1] for s, n in zip(b.start[at].tolist(), b.count[at].tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"h": b.anchor[at].view(np.int64), "doc": least[k], "block": np.full(len(k), r["block"]), "tile": b.names(b.buckets(r["tiles"] or []))[k], "text": pa.array(texts, pa.binary())})

    return known.mapInArrow(send, "h long, doc long, block long, tile long, text binary")


def repeated_windows(texts: DataFrame) -> DataFrame:
    """(block, tile, mask): the windows of sent tiles that a smaller document has too, bit by bit.

    An anchor's tiles stand in suffix arrays of at most 2 * PART tiles each. Windows that are equal are neighbours there,
    and all but those of the smallest document are repeats. Rows are dealt by ranges of anchor and tile, so an anchor that
    very many tiles have is spread over tasks. If an anchor has several arrays, or may have others in the neighbouring
    range, each array sends what is left, a row for each window and tile of its smallest document there, to a second
    comparison, across arrays.
    """
    dealt = texts.withColumn("salt", F.xxhash64("doc", "block", "tile")).repartitionByRange("h", "salt").sortWithinPartitions("h")

    def arrays(h, part, several, doc, block, tile, flat, offsets):
        new = np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]
        owner = np.cumsum(new) - 1
        lengths = np.diff(offsets)
        start, first, last, separator = lay_out(lengths, owner)
        keys = separator
        inside = separator < 0
        keys[inside] = flat.astype(np.int64) + (1 << 40)
        order = suffix_arrays(keys, first, last)
        piece = np.full(len(keys), -1)
        windows = lengths - WINDOW + 1
        at = np.repeat(start - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        piece[at] = np.repeat(np.arange(len(lengths)), windows)
        small = np.append(np.where(inside, keys & 0xFF, 0), np.zeros(WINDOW, np.int64)).astype(np.uint8)
        s = order[piece[order] >= 0]
        p = piece[s]
        differs = np.r_[True, owner[p][1:] != owner[p][:-1]]
        for j in (*range(0, WINDOW - 8, 8), WINDOW - 8):  # neighbours, eight bytes at a time
            eight = np.ndarray(len(keys), np.uint64, small, j, (1,))[s]
            differs[1:] |= eight[1:] != eight[:-1]
        group = np.cumsum(differs) - 1
        least = np.minimum.reduceat(doc[p], np.flatnonzero(differs))
        bit = np.uint64(1) << (s - start[p]).astype(np.uint64)
        masks = np.zeros(len(lengths), np.uint64)
        again = doc[p] > least[group]
        np.bitwise_or.at(masks, p[again], bit[again])
        k = np.flatnonzero(masks)
        yield pa.RecordBatch.from_pydict({"block": block[k], "tile": tile[k], "mask": masks[k].view(np.int64), "h": pa.nulls(len(k), pa.int64()), "w": pa.nulls(len(k), pa.binary()), "doc": doc[k]})
        lone = np.flatnonzero(~again & several[p])
        if len(lone):
            # groups are in order already; a tile that holds a window more than once sends it once, with all its bits
            lone = lone[np.lexsort((p[lone], group[lone]))]
            begin = np.flatnonzero(np.r_[True, (group[lone][1:] != group[lone][:-1]) | (p[lone][1:] != p[lone][:-1])])
            bits, lone = np.bitwise_or.reduceat(bit[lone], begin), lone[begin]
            yield pa.RecordBatch.from_pydict({"block": block[p[lone]], "tile": tile[p[lone]], "mask": bits.view(np.int64), "h": h[p[lone]], "w": pa.array([window.tobytes() for window in small[s[lone][:, None] + np.arange(WINDOW)]], pa.binary()), "doc": doc[p[lone]]})

    def compare(batches):
        held, size, cut = [], 0, None  # cut: the anchor whose tiles may stand in other arrays, too
        for batch in batches:
            if cut is None and batch.num_rows:
                cut = batch.column(0)[0].as_py()
            held.append(batch)
            size += batch.nbytes
            if size > 4 << 20:
                table = pa.Table.from_batches(held).combine_chunks()
                h = table["h"].to_numpy()
                change = np.flatnonzero(h[1:] != h[:-1])
                end = int(change[-1]) + 1 if len(change) else len(h)
                yield from run(table.slice(0, end), (cut,) if len(change) else (cut, int(h[-1])))
                held, cut = table.slice(end).combine_chunks().to_batches(), cut if len(change) else int(h[-1])
                size = sum(b.nbytes for b in held)
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            if len(table):
                yield from run(table, (cut, table["h"][len(table) - 1].as_py()))

    def run(table, open_ones):
        h, doc, block, tile = (table[c].to_numpy() for c in ("h", "doc", "block", "tile"))
        sizes = np.array([len(t) for t in table["text"].to_pylist()], np.int64)
        flat = np.frombuffer(b"".join(table["text"].to_pylist()), np.uint8)
        begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        all_of = np.diff(np.r_[begin, len(h)])
        nth = np.arange(len(h)) - np.repeat(begin, all_of)
        part = np.where(np.repeat(all_of > 2 * PART, all_of), nth // PART, 0)
        several = np.repeat(all_of > 2 * PART, all_of) | np.isin(h, open_ones)
        owner = np.cumsum(np.r_[True, (h[1:] != h[:-1]) | (part[1:] != part[:-1])]) - 1
        each = np.bincount(owner)[owner]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        # collections of about one size go in step
        for lo, hi in ((1, 3), (4, 12), (13, 48), (49, 1 << 60)):
            k = np.flatnonzero((each >= lo) & (each <= hi))
            if len(k):
                chars = np.repeat(offsets[k] - (np.cumsum(sizes[k]) - sizes[k]), sizes[k]) + np.arange(sizes[k].sum())
                yield from arrays(h[k], part[k], several[k], doc[k], block[k], tile[k], flat[chars], np.concatenate([[0], np.cumsum(sizes[k])]))

    found = written(dealt.select("h", "doc", "block", "tile", "text").mapInArrow(compare, "block long, tile long, mask long, h long, w binary, doc long"))
    across = found.where("h is not null").groupBy("h", "w").agg(F.min("doc").alias("least"))
    late = found.where("h is not null").join(across, ["h", "w"]).where("doc > least").select("block", "tile", "mask")
    return found.where("h is null").select("block", "tile", "mask").unionAll(late).groupBy("block", "tile").agg(F.bit_or("mask").alias("mask"))


def cut_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, binary, on request) of every row of docs(doc_id, text).

    A byte goes if a 50-byte string of its document that covers it also starts in a document with a smaller doc_id;
    nothing matches across documents, and what goes is judged on the input. Null text counts as empty; texts below 50
    bytes stay whole. Rows with equal doc_id don't cut each other; a null doc_id counts as the largest, 2 ** 63 - 1. An empty
    table gives no rows; other columns are not read.
    """
    blocks = blocks_of(docs)
    buckets = max(64, blocks.count() // 8)
    shared = written(by_block(shared_anchors(blocks, buckets), "shared"))
    found = written(by_block(distinct_tiles(beside(blocks, shared), buckets), "tiles"))
    texts = written(text_of_tiles(beside(blocks, shared, found)))
    repeats = written(repeated_windows(texts))
    ties = tied_tiles(found).hint("merge")
    tied = ties.join(repeats, (F.col("from_block") == F.col("block")) & (F.col("from_tile") == F.col("tile"))).select(F.col("to_block").alias("block"), F.col("to_tile").alias("tile"), "mask")
    masks = by_block(repeats.unionAll(tied), "masks")

    def cut(batches):
        for r in rows_of(batches):
            b = Block(r)
            b.share(r["shared"] or [])
            _, least = b.answered(r["tiles"] or [])
            mask = np.zeros(len(b.first), np.uint64)
            if r["masks"]:
                names = b.names(b.buckets(r["tiles"] or []))
                order = np.argsort(names)
                at = order[np.searchsorted(names[order], [m["tile"] for m in r["masks"]])]
                mask[at] = np.array([m["mask"] for m in r["masks"]], np.int64).view(np.uint64)
            late = b.ids[b.row] > least[b.tile]
            bits = np.where(late, np.uint64(0xFFFFFFFFFFFFFFFF), mask[b.tile])
            nth = np.arange(int(b.count.sum())) - np.repeat(np.cumsum(b.count) - b.count, b.count)
            hit = (np.repeat(bits, b.count) >> nth.astype(np.uint64)) & np.uint64(1) == 1
            flags = np.zeros(len(b.data) + 1, np.int32)
            flags[(np.repeat(b.start, b.count) + nth)[hit] + 1] = 1
            upto = np.cumsum(flags)
            gone = upto[1:] > upto[np.maximum(np.arange(len(b.data)) - WINDOW + 1, 0)]
            _, _, owner = runs(gone, b.offsets)
            rows = len(b.ids)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[b.offsets])
            spans = np.bincount(owner, minlength=rows)
            text, ends = b.data[~gone].tobytes(), b.offsets - np.concatenate([[0], np.cumsum(gone)])[b.offsets]
            kept = [text[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            ids = pa.array(b.ids, mask=b.none)
            columns = [ids, pa.array(np.diff(b.offsets)), pa.array(removed), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_text else []), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return beside(blocks, shared, found, masks).select(*Block.COLUMNS, "shared", "tiles", "masks").mapInArrow(cut, schema)
