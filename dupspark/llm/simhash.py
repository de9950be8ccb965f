"""SimHash near-dedup: bit-sliced comparison of fingerprints inside blocks that any close pair must share."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, byte_blocks, components, local_forest, released, runs, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Five parts of the 64 bits: a pair that differs in at most 3 bits agrees on at least two whole parts.
PARTS, AGREE = 5, 2
#: Fingerprints of one block that meet in one task; larger blocks are cut into cells that hold two pieces of half this size.
CELL = 2048
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = SHINGLE) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased text with single spaces, start and stop of every shingle in it, and the row of each shingle."""
    space = _SPACE[data]
    starts, stops, rows = runs(~space, offsets)
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    text = np.where(space, np.uint8(32), _FOLD[data])[keep].tobytes()
    place = np.concatenate([[0], np.cumsum(keep)])
    starts, stops = place[starts], place[stops]
    n = np.bincount(rows, minlength=len(offsets) - 1)
    lead = np.cumsum(n) - n
    many = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), many)
    first = lead[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    last = np.minimum(first + words - 1, (lead + n)[row] - 1)
    return text, starts[first], stops[last], row


def row_fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint64 of each row: a bit is set if over half of the row's shingle hashes have it. A row without words has 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    text, starts, stops, row = shingles(data, offsets)
    if not len(row):
        return out
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(row))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    total = np.diff(np.r_[first, len(row)])
    ones = np.zeros((len(first), 64), np.int64)
    step = 1 << 16  # shingles unpacked at a time
    for at in range(0, len(h), step):
        part = np.unpackbits(h[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(part))
        ones[lo:hi] += np.add.reduceat(part, np.maximum(first[lo:hi] - at, 0), axis=0, dtype=np.int64)
    bits = (2 * ones > total[:, None]).astype(np.uint8)
    out[row[first]] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, *also: str) -> DataFrame:
    """(doc_id, fp bigint) of every row, and the bigint columns also; null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def compute(batches):
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(batch, "b", 1 << 19):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(row_fingerprints(data, offsets).view(np.int64)), *[batch.column(c).slice(lo, hi - lo) for c in also]], ["doc_id", "fp", *also])

    schema = ", ".join(f"{c} long" for c in ("doc_id", "fp", *also))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("b"), *also).mapInArrow(released(compute), schema)


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS):
    """Yields (i, j) index arrays of the pairs within a group (ascending numbers) that differ in at most radius bits.

    64 fingerprints of a group stand side by side in one word a bit plane. Carry-save counters of a few bits add one
    plane after another for all lanes at once; every eight planes the words whose lanes all exceed the radius go.
    """
    begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[begin, len(group)])
    per = (size + 63) // 64
    word0 = np.cumsum(per) - per
    which = np.searchsorted(begin, np.arange(len(fps)), side="right") - 1
    nth = np.arange(len(fps)) - begin[which]
    word, lane = word0[which] + nth // 64, nth % 64
    lanes = np.zeros((int(per.sum()), 64), np.uint64)
    lanes[word, lane] = fps
    owner = np.full(lanes.shape, -1)
    owner[word, lane] = np.arange(len(fps))
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 64, 8), axis=2, bitorder="little")
    planes = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    valid = np.packbits(owner >= 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
    del bits, lanes
    full, width = np.uint64(0xFFFFFFFFFFFFFFFF), max(1, radius.bit_length())
    step = 1 << 16
    many = per[which]
    ends = np.cumsum(many)
    at = 0
    while at < len(fps):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        q = np.repeat(np.arange(at, to), many[at:to])
        w = word0[which[q]] + np.arange(len(q)) - np.repeat(np.cumsum(many[at:to]) - many[at:to], many[at:to])
        counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
        over = ~valid[w]
        for b in range(64):
            carry = planes[b, w] ^ (np.uint64(0) - ((fps[q] >> np.uint64(b)) & np.uint64(1)))
            for c in counters:
                up = c & carry
                c ^= carry
                carry = up
            over |= carry
            if b % 8 == 7:
                alive = over != full
                if not alive.all():
                    q, w, over, counters = q[alive], w[alive], over[alive], [c[alive] for c in counters]
        # the lanes whose exact count, where none overflowed, is at most the radius
        above, same = np.zeros(len(q), np.uint64), np.full(len(q), full)
        for k in reversed(range(width)):
            if radius >> k & 1:
                same &= counters[k]
            else:
                above |= same & counters[k]
                same &= ~counters[k]
        near = ~(over | above)
        hit = near != 0
        q, w, near = q[hit], w[hit], near[hit]
        row, bit = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = q[row], owner[w[row], bit]
        yield i[i < j], j[i < j]
        at = to


def links(unique: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) with the same components as all close pairs: a star forest a cell."""
    sizes = [64 // PARTS + (k < 64 % PARTS) for k in range(PARTS)]
    cut = [sum(sizes[:k]) for k in range(PARTS)]
    keys = []
    for n, chosen in enumerate(combinations(range(PARTS), AGREE)):
        value = F.lit(n).cast("long")
        for k in chosen:
            value = F.shiftleft(value, sizes[k]).bitwiseOR(F.shiftrightunsigned("fp", cut[k]).bitwiseAND(F.lit((1 << sizes[k]) - 1)))
        keys.append(value)
    rows = written(unique.select("fp").repartition(F.col("fp"))).select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CELL)).select("key", F.ceil(F.col("n") * 2 / CELL).cast("int").alias("pieces"))
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    cells = rows.join(hot, "key", "left").withColumn("piece", piece)
    others = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda t: F.least(t, F.col("piece")) * F.col("pieces") + F.greatest(t, F.col("piece")))
    cells = cells.select("key", "fp", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(-1))).otherwise(others)).alias("cell"))

    def compare(batches):
        held: list[np.ndarray] = []

        def forest(key, cell, fp):
            new = np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]
            group = np.cumsum(new) - 1
            paired = np.bincount(group)[group] > 1
            group, fp = group[paired], fp[paired]
            found = [np.stack(local_forest(i, j)) for i, j in close_pairs(fp.view(np.uint64), group) if len(i)] if len(fp) else []
            if found:
                i, j = local_forest(*np.concatenate(found, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(fp[i]), pa.array(fp[j])], ["a", "b"])

        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]))
            if len(change):
                last = change[-1] + 1
                yield from forest(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held and len(held[0]):
            yield from forest(*held)

    sorted_cells = cells.select("key", "cell", "fp").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return sorted_cells.mapInArrow(released(compare), "a long, b long")


def near_classes(prints: DataFrame) -> DataFrame:
    """(fp, class, component_id, group_size) of every fingerprint of prints(doc_id, fp): its group, the group's smallest doc_id and rows."""
    unique = prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    found = components(links(unique))
    classes = unique.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    ids = classes.groupBy("class").agg(F.min("least").alias("component_id"), F.sum("rows").alias("group_size"))
    return written(classes.select("fp", "class").join(ids, "class").select("fp", "class", "component_id", "group_size"))


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, group_size for every row of docs(doc_id, text).

    Fingerprints link at RADIUS or fewer differing bits, without exception; component_id is the smallest doc_id that
    chains of links reach. Null and empty texts have fingerprint zero, linked like any other; a text of one or two words
    is one shingle. Null doc_id is passed over by the minimum. Repeated rows come back as often; an empty table is empty.
    """
    prints = written(fingerprints(docs))
    named = near_classes(prints)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_size")


def keep_one_of_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, that with the smallest doc_id; all columns stay. Rows with null doc_id are left alone.

    Rows that repeat a doc_id are rows of their own groups; of those that tie, the smallest fingerprint and then the first row stays.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names, strict=True))
    rows = written(docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(f"`{c}`").alias(n) for c, n in at.items()]))
    known = F.col(at["doc_id"]).isNotNull()
    prints = written(fingerprints(rows.where(known).select("_row", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")), "_row"))
    named = near_classes(prints)
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "_row")).alias("least"))
    kept = written(least.join(named, "fp").groupBy("class").agg(F.min("least").alias("least")).select(F.col("least._row").alias("_row")))
    out = rows.where(known).join(kept, "_row", "left_semi").unionByName(rows.where(~known))
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])
