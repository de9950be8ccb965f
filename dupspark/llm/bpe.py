"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of the distinct words; decoding joins binary pieces.

Words are folded once where they are frequent and once a block where they are rare. A first pass counts in how many
blocks each distinct word stands; the MOST words that most blocks have are folded and broadcast, so that later blocks
need not fold them again. The second pass cuts each block into words, folds those that are neither tokens nor broadcast,
and puts the ids in the words' places. Both go through the same fold, whatever the corpus holds: MOST bounds what the
driver and a task keep, and a lost task is run again by itself.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded_batches, byte_blocks, byte_column, plain_names, released, span_hashes, trimmed, written

#: Bytes of a block of texts and of a page of one text, which is cut where a token ends anyway. A fold costs the square of a
#: word's length: words of more than LONG bytes are merged by merged(), which takes n log n steps and gives the same ids.
BLOCK, PAGE, LONG = 1 << 20, 1 << 18, 255
#: Bytes of a row group of blocks, all of which a reader may hold.
GROUP = 8 << 20
#: Words that are broadcast at most, some 30 bytes each.
MOST = 3 << 18
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file's tokens: base64 of the bytes and the rank, a line each."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def char_classes() -> np.ndarray:
    """Class of every code point as the splitting pattern sees it."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    # fixed values: Unicode's White_Space
    out[[*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def repaired(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with every byte sequence that is no UTF-8 replaced by U+FFFD, as Python's decoder does; mostly the rows themselves."""
    text = data.tobytes()
    starts = offsets[:-1][np.diff(offsets) > 0]
    try:
        text.decode("utf-8")
        if not len(starts) or ((data[starts] & 0xC0) != 0x80).all():
            return data, offsets
    except UnicodeDecodeError:
        pass
    rows = [text[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])


def pages(data: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Borders of stretches of some `most` bytes. Each starts where a row does, or at ASCII white space right after another ASCII
    character: the pattern lets no match cross that place, and what is left of it doesn't bear on what is right of it."""
    lo = 0
    while lo < len(data):
        hi = lo + most
        while hi < len(data):
            part = data[hi - 1 : hi + most]
            blank = (part == 32) | ((part >= 9) & (part <= 13))
            good = np.flatnonzero(blank[1:] & ~blank[:-1] & (part[:-1] > 32) & (part[:-1] < 127))
            row = offsets[np.searchsorted(offsets, hi)]
            best = min(hi + int(good[0]) if len(good) else len(data), int(row))
            if best < hi + most:
                hi = best
                break
            hi += most
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


def split_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and stops of the matches of 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in UTF-8 rows."""
    found = []
    for lo, hi in pages(data, offsets, PAGE):
        rows = offsets[np.searchsorted(offsets, lo) : np.searchsorted(offsets, hi, side="right")] - lo
        starts, stops = page_words(data[lo:hi], rows, classes)
        found.append((starts + lo, stops + lo))
    if not found:
        empty = np.zeros(0, np.int64)
        return empty, empty
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def page_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The matches in one page; offsets are the rows' borders in it.

    A match is a run of one class; of a run of white space before something else the last character stands alone, or,
    if it is a blank, before what follows. A lone apostrophe that no blank precedes takes a contraction's letters.
    """
    lead = (data & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(chars)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty
    kind = classes[chars]
    row_start = np.zeros(n + 1, bool)
    row_start[np.searchsorted(place, offsets)] = True
    row_start[n] = True
    begin = np.ones(n + 1, bool)
    begin[1:n] = (kind[1:] != kind[:-1]) | row_start[1:n]
    token = begin.copy()
    starts = np.flatnonzero(begin)  # of runs; the last is n
    first, end = starts[:-1], starts[1:]
    gap = (kind[first] == SPACE) & ~row_start[end]
    token[end[gap] - 1] = True
    token[end[gap & (chars[end - 1] == 32)]] = False
    # contractions: a run that is one apostrophe, at a token's start, before letters of the same row
    mark = (kind[first] == OTHER) & (end - first == 1) & (chars[first] == 39) & token[first] & ~row_start[end]
    mark[:-1] &= kind[first[1:]] == LETTER
    mark[-1] = False
    at, stop = end[mark], end[np.flatnonzero(mark) + 1]
    one = np.isin(chars[at], [ord(c) for c in "stmd"])
    second = np.where(at + 1 < stop, chars[np.minimum(at + 1, n - 1)], 0)
    two = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (chars[at] == ord(a)) & (second == ord(b))
    token[at[one | two]] = False
    token[at[one] + 1] = True
    token[at[two] + 2] = True
    token[n] = True
    cuts = np.append(place, len(data))[np.flatnonzero(token)]
    return cuts[:-1], cuts[1:]


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: neighbours whose joint bytes have the lowest rank merge first, from the left; n log n by a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    gone = [False] * n
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or stop[j] != end:
            continue
        gone[j], stop[i], after[i] = True, end, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(word[i : stop[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, stop[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : stop[i]]])
        i = after[i]
    return out


@dataclass
class RankMap:
    """Pairs of ids whose joint bytes are a token, as literal arrays: the row of each left id is laid over one array of cells, displaced so that
    no two rows take one cell. Pair (a, b) has the cell shift[a] + b; it is a pair if owner is a there, and then joint is its id.

    pairs holds the joint id of each two bytes, -1 for none.
    """

    byte_ids: list[int]
    pairs: np.ndarray
    shift: np.ndarray
    owner: np.ndarray
    joint: np.ndarray

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> RankMap:
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, c in ranks.items():
            for k in range(1, len(token)):
                if token[:k] in ranks and token[k:] in ranks:
                    rows.setdefault(ranks[token[:k]], []).append((ranks[token[k:]], c))
        size = max(ranks.values()) + 1
        cells = 4 * size + 4 * sum(map(len, rows.values())) + (1 << 16)
        shift, owner, joint, used = np.zeros(size, np.int64), np.full(cells, -1, np.int64), np.zeros(cells, np.int64), np.zeros(cells, bool)
        low, look = 0, 1 << 14
        for a, row in sorted(rows.items(), key=lambda r: (-len(r[1]), r[0])):
            right, made = np.array(row).T
            low += int(np.argmin(used[low:]))  # all cells before it are taken
            at = low - int(right.min())
            while (taken := np.logical_or.reduce([used[at + r : at + r + look] for r in right.tolist()])).all():
                at += look
            at += int(np.argmin(taken))
            shift[a] = at
            owner[right + at], joint[right + at], used[right + at] = a, made, True
        two = np.array([ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)])
        last = int(np.flatnonzero(used).max(initial=0)) + 1
        return cls([ranks[bytes([b])] for b in range(256)], two, shift, owner[:last], joint[:last])

    def fold(self, words: str) -> Column:
        """Ids of each word of an array<binary> column: one merge a step, of the leftmost pair of lowest rank, until no pair has a rank.

        A part of a word is one whole number: the rank of the pair that it begins, the place of its first byte, its id and 1.
        The least number is then the leftmost pair of lowest rank, and a merge replaces the part before it and the two
        of the pair in one array. A part of id 0 stands at both ends, so that these need no case of their own. A node inside a
        fold is interpreted, so the nodes of a step are what it costs. Values are bound by a reduce over one element, which hands
        them on as they are; a transform would copy them. Of 50,000 ids, a word may have 2**29 bytes.
        """
        bits = len(self.shift).bit_length()
        none, top = 1 << bits, 61 - bits  # the rank of no pair, and the bits below a rank
        low, least = (1 << bits) - 1, none << top
        # a cell holds its owner and the joint id; that and the left id, shifted likewise, differ by the joint id if the left id is the owner
        cells = np.concatenate([[0], np.where(self.owner < 0, 0, self.owner + 1 << bits | self.joint + 1)])
        shift = np.concatenate([[len(cells)], self.shift])
        two = np.full((256, 257), none)
        two[:, :256] = np.where(self.pairs < 0, none, self.pairs + 1).reshape(256, 256)
        first = two << top | np.array(self.byte_ids)[:, None] + 1
        bound = lambda value, zero, names, body: f"reduce(array({value}), {zero}, ({names}) -> {body})"
        literal = lambda values: f"cast(split('{','.join(map(str, values.ravel().tolist()))}', ',') as array<bigint>)"
        rank = lambda x, y: f"shiftleft(least(get(cells, cast(get(shift, cast({x} as int)) + {y} as int)) ^ shiftleft({x}, {bits}), {none}L), {top})"
        raw = "transform(split(decode(w, 'ISO-8859-1'), ''), c -> ascii(c))"  # the bytes as numbers
        parts = f"transform(raw, (a, i) -> get(first, a * 257 + coalesce(get(raw, i + 1), 256)) + shiftleft(cast(i as bigint), {bits}))"
        start = bound(raw, f"array({least}L)", "z, raw", f"concat(z, {parts}, z)")
        joint, before, after = f"shiftright(v, {top})", "get(s, p - 2)", f"(get(s, p + 1) & {low}L)"
        left = f"{before} & {(1 << top) - 1}L | {rank(f'({before} & {low}L)', joint)}"
        made = f"v & {(1 << top) - 1 - low}L | {joint} | {rank(joint, after)}"
        merge = bound("cast(array_position(s, v) as int)", "s", "s, p", f"concat(slice(s, 1, p - 2), array({left}, {made}), slice(s, p + 2, {1 << 30}))")
        step = bound("array_min(s)", "s", "s, v", f"case when v >= {least}L then s else {merge} end")
        ids = f"transform(slice(s, 2, size(s) - 2), e -> cast((e & {low}L) - 1 as int))"
        out = f"transform({words}, w -> reduce(sequence(1, octet_length(w)), {start}, (s, i) -> {step}, s -> {ids}))"
        for name, values in (("first", first), ("shift", shift), ("cells", cells)):
            out = bound(literal(values), "cast(null as array<array<int>>)", f"z, {name}", out)
        return F.expr(out)


_LAST: list = []


def fold_of_ranks(ranks: dict[bytes, int]) -> tuple[Column, tuple]:
    """The fold over a column _words and the arguments of the tokens' pool, those of the last ranks if these are equal: a session builds the map once."""
    if not _LAST or _LAST[0] != ranks:
        _LAST[:] = [dict(ranks), RankMap.of(ranks), token_pool(ranks)]
    return _LAST[1].fold("_words"), _LAST[2]


def numbered(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one occurrence of each distinct word, each word's number among the distinct ones, and their hashes. Bytes decide, a hash only sorts."""
    hashes = span_hashes(data, starts, stops)
    _, sample, at = np.unique(hashes, return_index=True, return_inverse=True)
    size, other = stops - starts, starts[sample][at]
    same = bool((size == size[sample][at]).all())
    for lo in range(0, len(starts) if same else 0, 1 << 14):
        part = slice(lo, lo + (1 << 14))
        n = size[part]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = same and bool((data[np.repeat(starts[part], n) + step] == data[np.repeat(other[part], n) + step]).all())
    if same:
        return sample, at, hashes[sample]
    text, seen = data.tobytes(), {}  # two words of one hash
    at = np.array([seen.setdefault(text[a:b], len(seen)) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], np.int64)
    sample = np.unique(at, return_index=True)[1]
    return sample, at, hashes[sample]


def places(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... sizes[k] of them, for every k."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Pool:
    """Words of at most LONG bytes and their ids, in the order of the words' hashes: sizes, joined words, numbers of ids, joined ids."""

    def __init__(self, sizes: np.ndarray, text: np.ndarray, counts: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.size, self.text, self.start = sizes, text, np.cumsum(sizes, dtype=np.int32) - sizes
        self.counts, self.ids = counts, ids
        ends = np.cumsum(sizes, dtype=np.int64)
        self.hashes = span_hashes(text, ends - sizes, ends)

    def find(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it isn't here. Bytes decide."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        k = np.flatnonzero((self.hashes[place] == hashes) & (self.size[place] == stops - starts))
        n = (stops - starts)[k]
        equal = self.text[places(n, self.start[place[k]].astype(np.int64))] == data[places(n, starts[k])]
        wrong = np.add.reduceat(~equal, np.cumsum(n) - n) if len(k) else n
        out = np.full(len(hashes), -1)
        out[k[wrong == 0]] = place[k[wrong == 0]]
        return out


def block_words(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, *pools: Pool) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[bytes]]:
    """Starts of a block's words, the number of each, each pool's place of each number (-1: none), and the words that no pool has, in order."""
    starts, stops = split_words(data, offsets, classes)
    sample, at, hashes = numbered(data, starts, stops)
    found = [pool.find(data, starts[sample], stops[sample], hashes) for pool in pools]
    new = sample[np.max(found, axis=0) < 0]
    text = data.tobytes()
    return starts, at, found, [text[a:b] for a, b in zip(starts[new].tolist(), stops[new].tolist(), strict=True)]


def token_pool(ranks: dict[bytes, int]) -> tuple:
    """The arguments of the tokens' pool."""
    tokens = [t for t in ranks if len(t) <= LONG]
    size = np.array([len(t) for t in tokens], np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    order = np.argsort(span_hashes(np.frombuffer(b"".join(tokens), np.uint8), ends - size, ends), kind="stable").tolist()
    return size[order], np.frombuffer(b"".join(tokens[k] for k in order), np.uint8), np.ones(len(tokens), np.uint8), np.array([ranks[tokens[k]] for k in order], np.int32)


def frequent_words(rows: DataFrame, tokens: tuple, fold: Column, most: int) -> tuple:
    """The arguments of a pool of at most `most` words in rows(_b binary) that are no tokens: those that several blocks have, of a
    count that few enough words reach. fold gives the ids of the words in a column _words.

    Executors fold, sort and pack the words; the driver only puts the packs one after another.
    """
    shared = rows.sparkSession.sparkContext.broadcast((tokens[:2], char_classes()))

    def distinct(batches):
        pool, classes = Pool(*shared.value[0]), shared.value[1]
        for batch in batches:
            for _, _, data, offsets in byte_blocks(batch, "_b", BLOCK):
                words = block_words(*repaired(data, offsets), classes, pool)[3]
                yield pa.RecordBatch.from_arrays([pa.array([w for w in words if len(w) <= LONG], pa.binary())], ["word"])

    found = written(rows.select("_b").mapInArrow(released(distinct), "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1"))
    room, least = most, None
    for r in found.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(100_000).collect():
        if r.words > room:
            break
        room, least = room - r.words, r.n
    parts = [(np.zeros(0, np.uint8),) * 3 + (np.zeros(0, np.uint16),)]
    if least is not None:

        def hashed(batches):
            for batch in batches:
                data, offsets = byte_column(batch.column(0))
                h = span_hashes(data, offsets[:-1], offsets[1:]) ^ np.uint64(1 << 63)  # Spark's order of signed numbers is that of the hashes
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h.view(np.int64))], ["word", "h"])

        def pack(batches):
            for batch in batches:
                words, ids = batch.column(0).to_pylist(), batch.column(1)
                columns = np.array([len(w) for w in words], np.uint8), np.frombuffer(b"".join(words), np.uint8), np.asarray(ids.value_lengths()).astype(np.uint8), np.asarray(ids.flatten()).astype(narrow)
                low = batch.column(2)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([low]), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], ["h", "s", "t", "c", "i"])

        narrow = np.uint16 if tokens[3].max(initial=0) < 1 << 16 else np.int32
        chosen = found.where(F.col("n") >= least).select("word").mapInArrow(released(hashed), "word binary, h long")
        chosen = written(chosen.repartitionByRange("h").sortWithinPartitions("h"))
        folded = chosen.select("word", F.array("word").alias("_words"), "h").select("word", F.get(fold, 0).alias("ids"), "h")
        packs = written(folded.mapInArrow(released(pack), "h long, s binary, t binary, c binary, i binary"))
        for r in packs.orderBy("h").toLocalIterator():
            parts.append((*(np.frombuffer(x, np.uint8) for x in (r.s, r.t, r.c)), np.frombuffer(r.i, narrow)))
    return tuple(np.concatenate(x) for x in zip(*parts[1:] or parts, strict=True))


def coded(docs: DataFrame, ranks: dict[bytes, int], text: str, keep: list[str], columns: list[T.StructField], finish: Callable) -> DataFrame:
    """The columns to keep of docs (with names other than _b, _w, _words, _long, _ids) beside what finish makes of the ids.

    finish(ids, first, tokens by id) gives the arrays of `columns` for rows whose ids stand in ids[first[k]:first[k + 1]].
    Words are cut in one job and put in their places in another, a block a row between them, so that a task needs one
    Python worker at a time.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    short = "spark.sql.maxPlanStringLength"  # the driver keeps every plan's description, and these hold the literal map
    spark.conf.set(short, str(min(int(str(spark.conf.get(short)).rstrip("bB")), 1 << 16)))
    fold, tokens = fold_of_ranks(ranks)
    words = frequent_words(docs.select(F.col(text).cast("binary").alias("_b")), tokens, fold, MOST)
    known, answers = (spark.sparkContext.broadcast(x) for x in ((words[:2], tokens[:2], char_classes()), (ranks, words[2:], tokens[3])))
    del words
    trimmed(spark)

    def cut(batches):
        pools, classes = [Pool(*x) for x in known.value[:2]], known.value[2]
        for batch in batches:
            for lo, hi, data, offsets in byte_blocks(batch, "_b", BLOCK):
                data, offsets = repaired(data, offsets)
                starts, at, (place, token), words = block_words(data, offsets, classes, *pools)
                short = np.array([len(w) <= LONG for w in words], bool)
                # a number tells where the ids are: a pool's place, or the place in the block's short or long words
                code = np.where(token < 0, place << 2, token << 2 | 3)
                code[(place < 0) & (token < 0)] = np.where(short, (np.cumsum(short) - 1) << 2 | 1, (np.cumsum(~short) - 1) << 2 | 2)
                numbers = code.astype(np.int32)[at].tobytes()
                ends = np.searchsorted(starts, offsets) * 4
                own = [numbers[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = [own, [w for w in words if len(w) <= LONG], [w for w in words if len(w) > LONG]]
                kept = [pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column(k).slice(lo, hi - lo)) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x], pa.list_(pa.binary())) for x in lists)], [*keep, "_w", "_words", "_long"])

    def placed(batches):
        ranks, (counts, ids), alone = answers.value
        found = [(np.cumsum(counts, dtype=np.int32) - counts, counts, ids), None, None, (np.arange(len(alone)), np.ones(len(alone), np.uint8), alone)]
        tokens = [b""] * (max(ranks.values(), default=0) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        for batch in batches:
            for row in range(batch.num_rows):
                kept, numbers, long, folded = [batch.column(k)[row].values for k in range(len(keep))], *(batch.column(len(keep) + k)[row].values for k in range(3))
                own = [merged(w, ranks) for w in long.to_pylist()]
                count = np.asarray(folded.value_lengths()).astype(np.int64), np.array([len(x) for x in own], np.int64)
                flat = np.asarray(folded.flatten()).astype(np.int32), np.array([i for x in own for i in x], np.int32)
                found[1:3] = [(np.cumsum(n) - n, n, x) for n, x in zip(count, flat, strict=True)]
                data, offsets = byte_column(numbers)
                code = data.view(np.int32)
                kinds = [np.flatnonzero(code & 3 == k) for k in range(len(found))]
                many = np.zeros(len(code), np.int64)
                for mine, (_, count, _) in zip(kinds, found, strict=True):
                    many[mine] = count[code[mine] >> 2]
                total = np.concatenate([[0], np.cumsum(many)])
                out = np.empty(total[-1], np.int32)
                for mine, (lead, _, flat) in zip(kinds, found, strict=True):
                    out[places(many[mine], total[mine])] = flat[places(many[mine], lead[code[mine] >> 2].astype(np.int64))]
                made = finish(out, total[offsets // 4], tokens)
                yield pa.RecordBatch.from_arrays([*kept, *made], [*keep, *(c.name for c in columns)])

    kept = docs.select(*keep).schema.fields
    words = T.ArrayType(T.BinaryType())
    inner = T.StructType([*(T.StructField(f.name, T.ArrayType(f.dataType)) for f in kept), *(T.StructField(n, words) for n in ("_w", "_words", "_long"))])
    pieces = written(docs.select(*keep, F.col(text).cast("binary").alias("_b")).mapInArrow(released(cut), inner), group=GROUP)
    return pieces.select(*keep, "_w", "_long", fold.alias("_ids")).mapInArrow(released(placed), T.StructType([*kept, *columns]))


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", out: str = "ids") -> DataFrame:
    """docs beside an array<int> column of ids; null text counts as empty, bytes that are no UTF-8 as U+FFFD. A column of that name is replaced."""

    def lists(ids, first, tokens):
        return [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))]

    rows, at = plain_names(docs)
    got = coded(rows, ranks, at[text], list(at.values()), [T.StructField("_ids", T.ArrayType(T.IntegerType()))], lists)
    return got.select(*[F.col(n).alias(c) for c, n in at.items() if c != out], F.col("_ids").alias(out))


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "bytes") -> DataFrame:
    """rows beside the binary pieces of their ids, concatenated; null ids give null, an unknown id is an error. A column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast({i: t for t, i in ranks.items()})
    plain, at = plain_names(rows)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(at[ids])).to_pylist()
            pieces = [None if x is None else b"".join(map(shared.value.__getitem__, x)) for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.binary())], [*batch.schema.names, "_bytes"])

    got = plain.mapInArrow(released(run), T.StructType([*plain.schema.fields, T.StructField("_bytes", T.BinaryType())]))
    return got.select(*[F.col(n).alias(c) for c, n in at.items() if c != out], F.col("_bytes").alias(out))


def digests(docs: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs(doc_id, text): ids are encoded, then decoded again.

    Null text counts as empty: no ids, and the digests of nothing. Bytes that are no UTF-8 count as U+FFFD. Texts may be
    of any length that a row may have. Repeated rows and null ids come back as they are; an empty table is empty; other
    columns are not read.
    """

    def sums(ids, first, tokens):
        found = ([], [])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            told, whole = hashlib.sha256(), hashlib.sha256()
            for lo in range(a, b, 1 << 16):
                own = ids[lo : min(b, lo + (1 << 16))].tolist()
                told.update((b"," if lo > a else b"") + ",".join(map(str, own)).encode())
                whole.update(b"".join(map(tokens.__getitem__, own)))
            found[0].append(told.hexdigest())
            found[1].append(whole.hexdigest())
        return [pa.array(np.diff(first)), *(pa.array(x, pa.string()) for x in found)]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    columns = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return coded(rows, ranks, "text", ["doc_id"], columns, sums)
