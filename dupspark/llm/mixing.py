"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import written

#: The weights of the sources in code-point order, repeating; all targets together are SHARE of all words, one at most CAP of its source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, blocks of an output shard, blocks of a hash bin of a source at most or so.
BLOCK, SHARD, BIN = 256, 4096, 1 << 16
#: Quotas stand on the driver and are sent to every task; more sources than this are refused.
SOURCES = 1 << 17
#: Subtrees of the shards, dealt to the executors.
SUBTREES = 256


def numbered(one: DataFrame) -> DataFrame:
    """one beside nth, its place by source, null last: places inside the parts of a range partitioning, and the sizes of the parts before."""
    order = F.col("source").asc_nulls_last()
    parts = written(one.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sizes = [(r.part, r.n) for r in parts.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()]
    before = F.lit(0).cast("long")
    for k, (part, n) in enumerate(sizes[1:]):
        before = F.when(F.col("part") >= part, sum(x for _, x in sizes[: k + 1])).otherwise(before)
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parts.withColumn("nth", (inside + before).cast("int")).drop("part")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, nth, source_size, target) from rows of (source, size); null is a source of its own, the last.

    What is above a cap is reshared by weight, round after round, until no target is: each round sums up the sources that
    are not full and gives them one level, target = level * weight. Full ones only become more, so the rounds end.
    """
    one = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    one = one.withColumn("w", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("nth") % len(weights))).withColumn("most", F.col("source_size") * float(cap))
    one = written(one)
    level, full = -1.0, -1
    while True:
        now = F.col("most") <= F.lit(level) * F.col("w")
        r = one.agg(F.sum("source_size").alias("all"), F.sum(F.when(now, F.col("most")).otherwise(0.0)).alias("given"), F.sum(F.when(now, 0.0).otherwise(F.col("w"))).alias("weight"), F.count_if(now).alias("full")).first()
        if r.full == full or not r["all"] or not r.weight:
            break
        level, full = max(level, (float(share) * r["all"] - r.given) / r.weight), r.full
    target = F.least(F.col("most"), F.lit(level) * F.col("w")) if level >= 0 else F.lit(0.0)
    return one.select("source", "nth", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn of good + bad. Beyond numpy's range the probabilities around the mode, as far as a double tells
    them from zero, are summed up from their ratios, and a uniform number picks one."""
    total = good + bad
    if total < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if total else 0
    low, high = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (total + 2), low), high)
    reach = int(40 * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 64
    k = np.arange(max(low, mode - reach), min(high, mode + reach), dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return max(low, mode - reach) + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def split(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source are among n blocks drawn without replacement: one source after the other, each given those before it."""
    rest = int(counts.sum())
    if rest < 1_000_000_000:
        return rng.multivariate_hypergeometric(counts, n, method="marginals")
    out = np.zeros_like(counts)
    for k, c in enumerate(counts.tolist()):
        rest -= c
        out[k] = hypergeometric(rng, c, rest, n)
        n -= int(out[k])
    return out


@dataclass
class Node:
    """Shards lo to hi with the sources that have blocks there: their numbers, how many blocks, and the first draw of each."""

    lo: int
    hi: int
    nths: np.ndarray
    counts: np.ndarray
    starts: np.ndarray

    def halves(self, shards: int, total: int, seed: int) -> tuple[Node, Node]:
        """Both children. A node's random numbers depend on seed, lo and hi alone, so every task that comes by draws the same."""
        mid = (self.lo + self.hi) // 2
        left = split(self.counts, mid * total // shards - self.lo * total // shards, np.random.default_rng([seed, self.lo, self.hi]))
        right, here, there = self.counts - left, left > 0, left < self.counts
        return Node(self.lo, mid, self.nths[here], left[here], self.starts[here]), Node(mid, self.hi, self.nths[there], right[there], (self.starts + left)[there])


def subtrees(lo: int, hi: int, most: int) -> list[tuple[int, int]]:
    """The nodes of at most `most` shards."""
    return [(lo, hi)] if hi - lo <= most else [*subtrees(lo, (lo + hi) // 2, most), *subtrees((lo + hi) // 2, hi, most)]


def shard_ranges(spark, quotas: list[tuple[int, int]], seed: int) -> DataFrame:
    """(nth, shard, start, count): which run of a source's draws goes to which shard. quotas: (nth, number of draws) of each source.

    The driver sends the quotas and names the subtrees; a task goes down to its subtree from the root and then through all of it.
    """
    if not quotas:
        return spark.range(0).selectExpr("cast(id as int) AS nth", "id AS shard", "id AS start", "id AS count")
    nths, counts = np.array([q[0] for q in quotas], np.int32), np.array([q[1] for q in quotas], np.int64)
    total = int(counts.sum())
    shards = max(1, -(-total // SHARD))

    def leaves(batches):
        for batch in batches:
            for lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node = Node(0, shards, nths, counts, np.zeros_like(counts))
                while (node.lo, node.hi) != (lo, hi):
                    node = node.halves(shards, total, seed)[hi > (node.lo + node.hi) // 2]
                todo = [node]
                while todo:
                    node = todo.pop()
                    if node.hi - node.lo > 1:
                        todo += node.halves(shards, total, seed)
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array(node.nths), pa.array(np.full(len(node.nths), node.lo)), pa.array(node.starts), pa.array(node.counts)], ["nth", "shard", "start", "count"])

    named = subtrees(0, shards, max(1, -(-shards // SUBTREES)))
    nodes = spark.createDataFrame(named, "lo long, hi long").repartition(min(len(named), 4 * spark.sparkContext.defaultParallelism))
    return nodes.mapInArrow(leaves, "nth int, shard long, start long, count long")


def mix(sizes: DataFrame, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """The mix of rows (row, doc_id, source, size, mark), and the targets of the sources.

    Returns the written shards (shard, key, row, doc_id, nth, block, turn, words), each a run of rows sorted by key, which
    is a random number: so a shard is shuffled. A source's blocks are permuted by a hash; its quota is the number of draws
    from that order, turn after turn, whose words come nearest to the target. The tree splits the quotas of all sources
    among the shards, each shard takes its runs of draws, and no two take the same. All of it depends on seed, doc_id,
    size and mark alone; rows that agree in these can't be told apart.
    """
    spark = sizes.sparkSession
    goals = written(targets(sizes))
    blocks = sizes.where("size > 0").join(goals.select("source", "nth"), sizes["source"].eqNullSafe(goals["source"])).select("row", "doc_id", "mark", "nth", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))).alias("block"))
    blocks = written(blocks.withColumn("words", F.least(F.lit(BLOCK), F.col("size") - F.col("block") * BLOCK).cast("long")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "mark", "block")).drop("size"))
    count = max(1, -(-blocks.count() // BIN))
    blocks = blocks.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.lit(count)).cast("int"))
    bins = blocks.groupBy("nth", "bin").agg(F.count("*").alias("n"), F.sum("words").alias("w"))
    upto = Window.partitionBy("nth").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("nth", "bin", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("w0"))
    inner = Window.partitionBy("nth", "bin").orderBy("h", "doc_id", "mark", "block", "row")
    ranked = blocks.withColumn("r", F.row_number().over(inner) - 1).withColumn("c", F.sum("words").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))
    ranked = ranked.join(bins, ["nth", "bin"]).withColumn("rank", F.col("n0") + F.col("r")).withColumn("past", F.col("w0") + F.col("c"))
    ranked = written(ranked.select("row", "doc_id", "nth", "block", "words", "rank", "past"))
    turns = goals.where("source_size > 0").select("nth", F.floor(F.col("target") / F.col("source_size")).alias("whole"), F.pmod(F.col("target"), F.col("source_size")).alias("rest"))
    part = F.count_if(F.col("past") + F.col("words") / 2 <= F.col("rest"))
    quotas = written(ranked.join(turns, "nth").groupBy("nth").agg(F.count("*").alias("blocks"), (F.max("whole") * F.count("*") + part).alias("quota")).where("quota > 0"))
    if quotas.count() > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    drawn = shard_ranges(spark, [(r.nth, r.quota) for r in quotas.orderBy("nth").collect()], seed)
    # Spark takes the runs and the draws in them for as few as the nodes they come from, and would broadcast all draws: the quotas alone are small
    drawn = drawn.join(F.broadcast(quotas.select("nth", "blocks")), "nth").select("shard", "nth", "blocks", F.explode(F.sequence("start", F.col("start") + F.col("count") - 1)).alias("at"))
    drawn = drawn.select("shard", "nth", F.floor(F.col("at") / F.col("blocks")).alias("turn"), F.pmod("at", "blocks").alias("rank"), F.xxhash64(F.lit(seed + 2), "nth", "at").alias("key"))
    shards = drawn.hint("merge").join(ranked, ["nth", "rank"]).select("shard", "key", "row", "doc_id", "nth", "block", "turn", "words")
    return written(shards.repartition("shard").sortWithinPartitions("shard", "key")), goals


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs(doc_id, text, source): taken sums up the words of its blocks in the shards.

    Null text has size 0; null source is a source. Rows that repeat a doc_id are taken for different documents; which of
    them is which is told by their texts, so runs agree however rows are partitioned. An empty table gives no rows, and if
    no text has a word all is 0.
    """
    sizes = written(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("mark")))
    shards, goals = mix(sizes)
    taken = shards.groupBy("row").agg(F.sum("words").alias("taken"))
    out = sizes.join(goals, sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"]).join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and turn that the shards have blocks of, a row with the text of those blocks.

    A block keeps its words and the white space before them. Columns of docs stay; n_chars, if there, is counted anew.
    A document without words (null and empty texts too) has nothing to take and goes; repeated rows are documents of their
    own; an empty table is empty.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    at = {c: n for c, n in zip(docs.columns, names, strict=True)}
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{c}`").alias(n) for c, n in at.items()]))
    sizes = written(rows.select("row", F.col(at["doc_id"]).cast("long").alias("doc_id"), F.col(at["source"]).alias("source"), size_of(F.col(at["text"])).alias("size"), F.xxhash64(at["text"]).alias("mark")))
    draws, _ = mix(sizes)
    takes = draws.groupBy("row", "turn").agg(F.sort_array(F.collect_list("block")).alias("blocks"), F.sum("words").alias("words"))
    takes = takes.join(sizes.select("row", "size"), "row")
    got = rows.join(takes, "row")
    pieces = F.regexp_extract_all(F.col(at["text"]), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # the pieces are bound once; inside the inner lambda they would be cut anew for each block
    chosen = F.transform(F.array(pieces), lambda p: F.array_join(F.flatten(F.transform("blocks", lambda b: F.slice(p, (b * BLOCK + 1).cast("int"), F.lit(BLOCK)))), ""))
    part = F.get(chosen, 0)
    text = F.when(F.col("words") == F.col("size"), F.col(at["text"])).otherwise(part)
    out = got.withColumn("_text", text)
    return out.select(*[(F.col("_text") if c == "text" else F.char_length("_text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(n)).alias(c) for c, n in at.items()])
