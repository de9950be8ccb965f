"""Vector codes: Lloyd's rounds over the parts of vectors, by trees over both the parts and the entries of their codebooks."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_batches, released, written

#: Parts of a vector, entries of a codebook, rounds, factor of a component; vectors under one tree, points of a leaf; bound of a component, so that a distance is exact in a double.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK, LEAF, MOST = 8192, 16, 1 << 23


def whole(vector: Column, scale: int) -> Column:
    """The vector's components times scale, rounded down; null if it or a component is null or not finite."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vector, lambda v: F.floor(v.cast("double") * scale)))


@dataclass
class Shape:
    """The nodes of a tree that halves its points until LEAF are left, top down: points lo to hi, and the first of two children, 0 for a leaf."""

    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray

    @classmethod
    def of(cls, n: int, leaf: int) -> Shape:
        lo, hi, child, at = [0], [n], [], 0
        while at < len(lo):
            a, b = lo[at], hi[at]
            child.append(len(lo) if b - a > leaf else 0)
            if b - a > leaf:
                lo += [a, (a + b) // 2]
                hi += [(a + b) // 2, b]
            at += 1
        return cls(np.array(lo), np.array(hi), np.array(child))


def tree_order(points: np.ndarray, shape: Shape) -> np.ndarray:
    """The points in an order in which every node's are neighbours: halves of its widest component, ties by place."""
    order = np.arange(len(points))
    for lo, hi, child in zip(shape.lo, shape.hi, shape.child, strict=True):
        if child:
            own = points[order[lo:hi]]
            wide = own[:, np.argmax(np.ptp(own, axis=0))] if own.shape[1] else np.zeros(hi - lo)
            order[lo:hi] = order[lo:hi][np.argsort(wide, kind="stable")]
    return order


@dataclass
class Tree:
    """Points in tree order, and of every node the sum of its points, their center, and a radius around it that holds them all."""

    shape: Shape
    points: np.ndarray
    sums: np.ndarray
    center: np.ndarray
    radius: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray, shape: Shape) -> Tree:
        before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
        sums = before[shape.hi] - before[shape.lo]
        center = sums / np.maximum(shape.hi - shape.lo, 1)[:, None]
        radius = np.zeros(len(sums))
        depth = np.zeros(len(sums), int)
        for k in np.flatnonzero(shape.child):
            depth[shape.child[k] : shape.child[k] + 2] = depth[k] + 1
        for level in range(int(depth.max()) + 1):  # the nodes of a level hold disjoint points
            own = np.flatnonzero(depth == level)
            own = own[np.argsort(shape.lo[own])]
            size = shape.hi[own] - shape.lo[own]
            if size.sum():
                at = np.repeat(shape.lo[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
                far = np.sqrt(((points[at] - np.repeat(center[own], size, axis=0)) ** 2).sum(axis=1))
                radius[own] = np.maximum.reduceat(far, np.cumsum(size) - size)
        return cls(shape, points, sums, center, radius * (1 + 1e-9) + 1e-6)


class Codebook:
    """Entries of one part position beneath a tree of single entries, and the distances between entries."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.squares = entries, (entries * entries).sum(axis=1)
        shape = Shape.of(len(entries), 1)
        self.order = tree_order(entries, shape)
        self.tree = Tree.of(entries[self.order], shape)
        self.tree.radius[shape.child == 0] = 0
        self.center = self.tree.center
        self.entry = np.where(shape.child == 0, self.order[np.minimum(shape.lo, len(entries) - 1)], -1)
        x = entries.astype(float)
        self.between = np.sqrt(np.maximum(self.squares[:, None] + self.squares[None] - 2 * (x @ x.T), 0))


@dataclass
class Found:
    """Whole nodes with their entry, and the points of uncertain leaves with theirs; compared counts the point-entry distances taken."""

    nodes: np.ndarray
    node_entries: np.ndarray
    points: np.ndarray
    point_entries: np.ndarray
    compared: int


def nearest(tree: Tree, book: Codebook) -> Found:
    """The nearest entry of every point, ties to the lower index.

    All pairs of a tree node and its candidate entry nodes go down together. A pair is left if its smallest possible
    distance is above the largest that another of the node's pairs allows, or if the node lies wholly on one side of
    the plane between two entries. A node with one entry left is assigned as a whole; entry nodes that are wider than the
    node are opened first, then the node. Leaves with several entries left compare whole numbers.
    """
    shape, top = tree.shape, book.tree
    slack = 1e-6 * (1 + float(np.abs(tree.center).max(initial=0)) + float(np.abs(top.center).max(initial=0)))
    limit = np.full(len(shape.lo), np.inf)
    a, b = np.zeros(1, int), np.zeros(1, int)
    nodes, entries, points, chosen, compared = [], [], [], [], 0
    while len(a):
        while True:
            gap = np.sqrt(np.maximum(((tree.center[a] - top.center[b]) ** 2).sum(axis=1), 0))
            np.minimum.at(limit, a, gap + tree.radius[a] + top.radius[b] + slack)
            keep = gap - tree.radius[a] - top.radius[b] <= limit[a]
            a, b, gap = a[keep], b[keep], gap[keep]
            wide = (book.entry[b] < 0) & ((top.radius[b] > tree.radius[a] / 2) | (shape.child[a] == 0))
            if not wide.any():
                break
            a, b = np.concatenate([a[~wide], np.repeat(a[wide], 2)]), np.concatenate([b[~wide], np.repeat(top.shape.child[b[wide]], 2) + np.tile([0, 1], int(wide.sum()))])
        one = book.entry[b] >= 0
        best = np.full(len(limit), np.inf)
        np.minimum.at(best, a[one], gap[one])
        first = np.full(len(limit), -1)
        near = one & (gap == best[a])
        first[a[near]] = book.entry[b[near]]
        rival = np.flatnonzero(one & ~near & (first[a] >= 0))
        split = book.between[first[a[rival]], book.entry[b[rival]]]
        out = rival[gap[rival] ** 2 - best[a[rival]] ** 2 > 2 * (tree.radius[a[rival]] + slack) * split + slack * (1 + gap[rival])]
        keep = np.ones(len(a), bool)
        keep[out] = False
        a, b = a[keep], b[keep]
        left = np.bincount(a, minlength=len(limit))
        sure = (left[a] == 1) & (book.entry[b] >= 0)
        nodes.append(a[sure])
        entries.append(book.entry[b[sure]])
        a, b = a[~sure], b[~sure]
        leaf = shape.child[a] == 0
        order = np.lexsort((book.entry[b[leaf]], a[leaf]))
        la, lb = a[leaf][order], book.entry[b[leaf]][order]
        cuts = np.append(np.flatnonzero(np.diff(la, prepend=-1)), len(la))
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            lo, hi, some = shape.lo[la[begin]], shape.hi[la[begin]], lb[begin:end]
            # whole numbers below 2**53 in doubles, so sums and products are exact
            away = book.squares[some] - 2.0 * (tree.points[lo:hi].astype(float) @ book.entries[some].T.astype(float))
            points.append(np.arange(lo, hi))
            chosen.append(some[np.argmin(away, axis=1)])
            compared += away.size
        a, b = a[~leaf], b[~leaf]
        child = shape.child[a]
        limit[child] = limit[child + 1] = limit[a]
        a, b = np.concatenate([child, child + 1]), np.concatenate([b, b])
    none = [np.zeros(0, int)]
    return Found(np.concatenate(nodes + none), np.concatenate(entries + none), np.concatenate(points + none), np.concatenate(chosen + none), compared)


def planted(rows: DataFrame, dim: int) -> DataFrame:
    """(n, ids, labels, points, orders): rows(vec_id, label, v) in blocks of BLOCK vectors, and for each part position the order of its tree, written to the shared folder."""
    bounded_batches(rows.sparkSession)
    kinds = [to_arrow_type(rows.schema[c].dataType) for c in ("vec_id", "label")]
    width = dim // PARTS

    def block(ids, labels, v) -> pa.RecordBatch:
        points = np.concatenate(v).reshape(sum(map(len, ids)), dim)
        shape = Shape.of(len(points), LEAF)
        orders = np.concatenate([tree_order(points[:, k * width : (k + 1) * width], shape) for k in range(PARTS)])
        lists = [pa.array([pa.concat_arrays(x).to_pylist()], pa.list_(kind)) for x, kind in zip((ids, labels), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([len(points)], pa.int32()), *lists, pa.array([points.astype("<i4").tobytes()]), pa.array([orders.astype("<i4").tobytes()])], ["n", "ids", "labels", "points", "orders"])

    def run(batches):
        ids, labels, v, n = [], [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK // 4):
                part = batch.slice(lo, BLOCK // 4)
                if n + part.num_rows > BLOCK:
                    yield block(ids, labels, v)
                    ids, labels, v, n = [], [], [], 0
                flat = part.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(flat) and np.abs(flat).max() >= MOST:
                    raise ValueError(f"a component is {SCALE} times {MOST // SCALE} or more, for which distances aren't exact")
                ids.append(part.column(0))
                labels.append(part.column(1))
                v.append(flat)
                n += part.num_rows
        if n:
            yield block(ids, labels, v)

    schema = f"n int, ids array<{rows.schema['vec_id'].dataType.simpleString()}>, labels array<{rows.schema['label'].dataType.simpleString()}>, points binary, orders binary"
    return written(rows.select("vec_id", "label", "v").mapInArrow(released(run), schema))


def trees_of(n: int, points: bytes, orders: bytes, dim: int):
    """(position, order, tree) of a block."""
    points, orders, width = np.frombuffer(points, "<i4").reshape(n, dim).astype(np.int64), np.frombuffer(orders, "<i4").reshape(PARTS, n), dim // PARTS
    shape = Shape.of(n, LEAF)
    for k in range(PARTS):
        yield k, orders[k], Tree.of(points[orders[k], k * width : (k + 1) * width], shape)


def assigned(tree: Tree, found: Found) -> np.ndarray:
    """The entry of every point in tree order."""
    out = np.empty(len(tree.points), int)
    for node, entry in zip(found.nodes, found.node_entries, strict=True):
        out[tree.shape.lo[node] : tree.shape.hi[node]] = entry
    out[found.points] = found.point_entries
    return out


def summed(blocks: DataFrame, books: list[Codebook], dim: int) -> np.ndarray:
    """For each part position and entry the sum of its parts and, last, their number. Whole nodes bring the sums that they carry; a task sends one row an entry and component."""
    width = dim // PARTS

    def run(batches):
        total = np.zeros((PARTS, len(books[0].entries), width + 1), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                for k, _, tree in trees_of(r["n"], r["points"], r["orders"], dim):
                    found = nearest(tree, books[k])
                    np.add.at(total[k, :, :width], found.node_entries, tree.sums[found.nodes])
                    np.add.at(total[k, :, width], found.node_entries, (tree.shape.hi - tree.shape.lo)[found.nodes])
                    np.add.at(total[k, :, :width], found.point_entries, tree.points[found.points])
                    np.add.at(total[k, :, width], found.point_entries, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["cell", "x"])

    rows = blocks.select("n", "points", "orders").mapInArrow(run, "cell long, x long").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(PARTS * len(books[0].entries) * (width + 1), np.int64)
    for r in rows:
        out[r.cell] = r.x
    return out.reshape(PARTS, -1, width + 1)


def coded(blocks: DataFrame, books: list[Codebook], dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    width = dim // PARTS
    id_kind, label_kind = (blocks.schema[c].dataType.elementType for c in ("ids", "labels"))
    digits = np.array([f"{x:02x}" for x in range(ENTRIES)])

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                r = row.select(["n", "points", "orders"]).to_pylist()[0]
                code, error = np.zeros((PARTS, r["n"]), int), np.zeros(r["n"], np.int64)
                for k, order, tree in trees_of(r["n"], r["points"], r["orders"], dim):
                    entry = assigned(tree, nearest(tree, books[k]))
                    code[k, order] = entry
                    error[order] += ((tree.points - books[k].entries[entry]) ** 2).sum(axis=1)
                text = digits[code[0]]
                for k in range(1, PARTS):
                    text = np.char.add(text, digits[code[k]])
                yield pa.RecordBatch.from_arrays([row.column(1).flatten(), row.column(2).flatten(), pa.array(text.tolist(), pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    schema = f"vec_id {id_kind.simpleString()}, label {label_kind.simpleString()}, code string, error long"
    return blocks.select("n", "ids", "labels", "points", "orders").mapInArrow(run, schema)


def trained(blocks: DataFrame, first: np.ndarray, rounds: int = ROUNDS) -> list[Codebook]:
    """The codebooks after so many rounds from the vectors `first`. A round brings a row an entry and component to the driver, whatever the table's size."""
    dim = first.shape[1]
    books = [Codebook(first[:, k * dim // PARTS : (k + 1) * dim // PARTS]) for k in range(PARTS)]
    for _ in range(rounds):
        total = summed(blocks, books, dim)
        count = total[:, :, -1:]
        books = [Codebook(np.where(count[k] > 0, total[k, :, :-1] // np.maximum(count[k], 1), books[k].entries)) for k in range(PARTS)]
    return books


def compressed(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row of embeddings(vec_id, embedding, label) with a whole vector.

    Rows whose vector is null or holds a null or non-finite component are dropped; so are those whose vector is longer
    or shorter than the one of the smallest kept vec_id (ties: the smaller vector), whose length must be a multiple of 4. Components are
    floor(1024 x). Codebooks start as the parts of the 256 smallest vec_ids, null last, repeated ids by their vectors, or of all rows where there are
    fewer; after four rounds every part gets its nearest entry, ties to the lower index. Repeated rows count each.
    label_error sums up the errors of a label, null labels together. Empty table: no rows; empty vectors have
    code 00000000. Components of 2**23 / 1024 or more in size are refused, since distances would not be exact.
    """
    spark = embeddings.sparkSession
    rows = embeddings.select("vec_id", "label", whole(F.col("embedding"), SCALE).alias("v")).where("v is not null")
    order = [F.asc_nulls_last("vec_id"), "v"]
    smallest = rows.orderBy(*order).select("v").head()
    if smallest is None:
        return spark.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(smallest.v)
    if dim % PARTS:
        raise ValueError(f"vectors of {dim} components can't be cut into {PARTS} equal parts")
    rows = rows.where(F.size("v") == dim)
    smallest = rows.orderBy(*order).select("v").limit(ENTRIES).collect()
    first = np.array([r.v for r in smallest], np.int64).reshape(len(smallest), dim)
    blocks = planted(rows, dim)
    books = trained(blocks, first)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()
    out = written(coded(blocks, books, dim))
    labels = out.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error"))
    beside = out.join(labels, F.col("label").eqNullSafe(F.col("_l")))
    return beside.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The same rounds as SQL, one pair of tables a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
     a{r} AS (SELECT p.r, p.k, min(struct_pack(d := list_dot_product(p.p, p.p) - 2 * list_dot_product(p.p, c.p) + list_dot_product(c.p, c.p), i := c.i)) AS m FROM p JOIN c{r} c USING (k) GROUP BY p.r, p.k)""")
        if r < rounds:
            steps.append(f"""
     u{r} AS (SELECT k, i, list(x ORDER BY j) AS p FROM (SELECT k, m.i AS i, j, floor(sum(x) / count(*)) AS x FROM (SELECT k, m, unnest(p.p) AS x, unnest(range(len(p.p))) AS j FROM a{r} JOIN p USING (r, k)) GROUP BY k, m.i, j) GROUP BY k, i),
     c{r + 1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(u.p, c.p) AS p FROM c{r} c LEFT JOIN u{r} u ON c.k = u.k AND c.i = u.i)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS MATERIALIZED (SELECT r, vec_id, k, list_slice(e, k * (len(e) // {PARTS}) + 1, (k + 1) * (len(e) // {PARTS})) AS p FROM v, range({PARTS}) t(k)),
     c0 AS MATERIALIZED (SELECT k, i, p FROM (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY vec_id) - 1 AS i FROM p) WHERE i < {ENTRIES}),{','.join(steps)},
     h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY k, i, j)) AS codebooks_sha256 FROM (SELECT k, i, unnest(p) AS x, unnest(range(len(p))) AS j FROM c{rounds})),
     f AS (SELECT r, string_agg(printf('%02x', CAST(m.i AS INTEGER)), '' ORDER BY k) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (r), h
"""


CODES_SQL = _sql()
