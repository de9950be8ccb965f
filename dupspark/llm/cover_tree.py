"""Exact top-k inner products by a dual-tree search: queries and data both stand in cover trees."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Vectors of one data tree and of one query tree, points of a data leaf and of a query leaf, ratio of a child's radius bound to its parent's.
SHARD, QUERIES, LEAF, QUERY_LEAF, SHRINK = 8192, 2048, 16, 1, 0.7


@dataclass
class Node:
    """Points lo to hi of the tree's order lie within radius of the center."""

    lo: int
    hi: int
    center: np.ndarray
    radius: float
    norm: float
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> tuple[Node, np.ndarray]:
    """A cover tree of the rows of x, and the order in which every node's points are neighbours.

    A node's children are chosen farthest-first until SHRINK times its radius covers every point, so two children lie
    farther apart than that. Where this needs a child for every second point, distances are too alike to tell points
    apart, and the node stays a leaf; so does one of at most `leaf` points or without extent.
    """
    squares = (x * x).sum(axis=1)

    def away(rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(squares[rows] + squares[to] - 2 * (x[rows] @ x[to]), 0))

    order = np.arange(len(x))
    top = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
    root = Node(0, len(x), x[top], 0.0, 0.0)
    todo = [(root, top, away(order, top))]
    while todo:
        node, center, far = todo.pop()
        rows = order[node.lo : node.hi]
        node.radius, node.norm = float(far.max()) * (1 + 1e-9) + 1e-6, float(np.sqrt(squares[center]))
        if len(rows) <= leaf or node.radius < 1e-3:
            continue
        reach, owner, centers, near = SHRINK * node.radius, np.zeros(len(rows), int), [center], far.copy()
        while near.max() > reach and len(centers) <= max(leaf, len(rows) // 2):
            pick = int(np.argmax(near))
            d = away(rows, rows[pick])
            closer = d < near
            near[closer], owner[closer] = d[closer], len(centers)
            centers.append(rows[pick])
        if near.max() > reach:
            continue
        sort = np.argsort(owner, kind="stable")
        order[node.lo : node.hi] = rows[sort]
        cuts = node.lo + np.searchsorted(owner[sort], np.arange(len(centers) + 1))
        near = near[sort]
        for k, c in enumerate(centers):
            lo, hi = int(cuts[k]), int(cuts[k + 1])
            if lo < hi:
                child = Node(lo, hi, x[c], 0.0, 0.0)
                node.children.append(child)
                todo.append((child, c, near[lo - node.lo : hi - node.lo]))
        if len(node.children) == 1:  # no progress: equal points but for one center
            node.children.pop()
            todo.pop()
    return root, order


class Best:
    """The k best (score, id) of every query so far, worst last."""

    def __init__(self, queries: int, k: int):
        self.k, self.score, self.id = k, np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max)
        self.floor = np.full(queries, -np.inf)  # a kth score that is known to be reached
        self.scored = 0

    def worst(self, lo: int, hi: int) -> float:
        """The smallest kth score of queries lo to hi."""
        return float(np.maximum(self.score[lo:hi, -1], self.floor[lo:hi]).min())

    def offer(self, rows: np.ndarray, scores: np.ndarray, own: np.ndarray, ids: np.ndarray) -> None:
        """scores of the queries `rows` (with ids own) with candidates ids."""
        self.scored += scores.size
        worst, last = self.score[rows, -1:], self.id[rows, -1:]
        r, c = np.nonzero(((scores > worst) | ((scores == worst) & (ids[None] < last))) & (scores >= self.floor[rows, None]) & (ids[None] != own[:, None]))
        if not len(r):
            return
        hit, at = np.unique(r, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(hit)), self.k), at])
        score = np.concatenate([self.score[rows[hit]].ravel(), scores[r, c]])
        name = np.concatenate([self.id[rows[hit]].ravel(), ids[c]])
        sort = np.lexsort((name, -score, row))
        first = np.searchsorted(row[sort], np.arange(len(hit)))
        chosen = sort[first[:, None] + np.arange(self.k)]
        self.score[rows[hit]], self.id[rows[hit]] = score[chosen], name[chosen]


def leaves(tree: Node) -> list[Node]:
    out, todo = [], [tree]
    while todo:
        node = todo.pop()
        todo += node.children
        out += [] if node.children else [node]
    return out


def seed(best: Best, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, tree: Node) -> None:
    """Floors for all queries: the kth score that each reaches in the one leaf of over k points whose center it likes most. The leaf's points are offered later, as any others."""
    ends = [n for n in leaves(tree) if best.k < n.hi - n.lo <= 32 * LEAF]
    if not ends:
        return
    own = (q @ np.stack([n.center for n in ends]).T).argmax(axis=1)
    for k in np.unique(own):
        node, rows = ends[k], np.flatnonzero(own == k)
        part = slice(node.lo, node.hi)
        scores = np.where(x_ids[part][None] != q_ids[rows][:, None], q[rows] @ x[part].T, -np.inf)
        best.scored += scores.size
        best.floor[rows] = np.partition(scores, -best.k, axis=1)[:, -best.k]


def left_by_bounds(best: Best, q: np.ndarray, tree: Node) -> float:
    """The share of all pairs that the bounds of the data's leaves, against single queries and the floors they have, would leave."""
    ends = leaves(tree)
    reach = q @ np.stack([n.center for n in ends]).T + np.sqrt((q * q).sum(axis=1))[:, None] * np.array([n.radius for n in ends])
    return float(((reach >= best.floor[:, None]) @ np.array([n.hi - n.lo for n in ends], float)).mean()) / tree.hi


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Best:
    """The k largest inner products of each row of q with rows of x that have another id; ties go to the smaller id.

    A pair of nodes is left if center . center, with both radii added in, stays below the worst kth score of the query
    node's queries. Pairs of higher bounds come first, and every query begins with the kth score of its own leaf. Where even the
    bounds of leaves against single queries would leave over half of all pairs, as with noise in many dimensions, the roots are scored
    as they are, in blocks: going down would add work and take none away.
    """
    qt, q_order = cover_tree(q, QUERY_LEAF)
    xt, x_order = cover_tree(x)
    q, q_ids, x, x_ids = q[q_order], q_ids[q_order], x[x_order], x_ids[x_order]
    best = Best(len(q), k)
    seed(best, q, q_ids, x, x_ids, xt)
    if left_by_bounds(best, q, xt) > 0.5:
        qt, xt = replace(qt, children=[]), replace(xt, children=[])

    def bounds(a: Node, nodes: list[Node]) -> np.ndarray:
        radii, norms = np.array([n.radius for n in nodes]), np.array([n.norm for n in nodes])
        top = np.stack([n.center for n in nodes]) @ a.center + a.norm * radii + norms * a.radius + radii * a.radius
        return top + 1e-9 * np.abs(top) + 1e-6

    todo = [(qt, xt, np.inf)]
    while todo:
        a, b, bound = todo.pop()
        if bound < best.worst(a.lo, a.hi):
            continue
        if not a.children and not b.children:
            at, step = b.lo, 64  # few at first, while most of them still get in
            while at < b.hi:
                part = slice(at, min(at + step, b.hi))
                best.offer(np.arange(a.lo, a.hi), q[a.lo : a.hi] @ x[part].T, q_ids[a.lo : a.hi], x_ids[part])
                at, step = part.stop, min(2 * step, 2048)
        elif b.children and (not a.children or b.radius >= a.radius):
            found = bounds(a, b.children)
            todo += [(a, b.children[i], found[i]) for i in np.argsort(found)]
        else:
            found = bounds(b, a.children)
            todo += [(a.children[i], b, found[i]) for i in np.argsort(found)]
    back = np.argsort(q_order)
    best.score, best.id = best.score[back], best.id[back]
    return best


def whole(vector: Column) -> Column:
    """The vector's components times 256, rounded down; null if it or a component is null or not finite."""
    ok = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vector, lambda v: F.floor(v.cast("double") * 256).cast("double")))


def top_k(queries: DataFrame, data: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries(vec_id, v) against data(vec_id, v), v being array<double> of whole numbers.

    Data fall by a hash of vec_id and row number into shards of about SHARD vectors, queries into blocks of about QUERIES;
    every block meets every shard in one task, which gives its k best a query row, and a window ranks those of a query
    id. Neither equal vectors nor equal ids share a key, so a common one loads no task. Only vectors of equal length meet; rows with null id or vector take no part; a
    query's own id is no candidate of it. Every row of a repeated query id asks, and its answers are ranked
    together. Scores are exact while they stay below 2**53.
    """
    queries = queries.where("vec_id is not null and v is not null")
    data = data.where("vec_id is not null and v is not null")
    shards, blocks = max(1, -(-data.count() // SHARD)), max(1, -(-queries.count() // QUERIES))
    place = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id", F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = queries.withColumn("block", place(blocks, 1)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("dim", F.size("v"))
    right = data.withColumn("shard", place(shards, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("dim", F.size("v"))

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        ids = a["vec_id"].to_numpy(np.int64)
        found = dual_search(np.stack(a["v"].to_list()), ids, np.stack(b["v"].to_list()), b["vec_id"].to_numpy(np.int64), k)
        row, nth = np.nonzero(np.isfinite(found.score))
        return pd.DataFrame({"query_id": ids[row], "vec_id": found.id[row, nth], "score": found.score[row, nth].astype(np.int64)})

    keys = ["shard", "block", "dim"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """top_k of the rows whose vec_id is divisible by `every`, against all rows of embeddings(vec_id, embedding).

    Components are floor(256 x). Vectors that are null or hold a null or non-finite component, and rows with a null id, take no
    part; repeated rows and ids as in top_k(); an empty table gives no rows; other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("embedding")).alias("v"))
    return top_k(rows.where(F.col("vec_id") % every == 0), rows, k)


TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
