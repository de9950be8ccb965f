import math

import pytest
from pyspark.sql import functions as F

from dupspark.operators import exact, filters, ordered, similar

FILES = "id int, path string, size bigint, content string, prioritized boolean"


@pytest.fixture
def files(spark):
    rows = [(1, "b/x", 3, "abc", False), (2, "a/y", 3, "abc", False), (3, "p/z", 3, "abc", True), (4, "q", 3, "xyz", False), (5, "r", 0, "", False), (6, "s", 0, "", False), (7, "t", 5, "solo!", False)]
    return exact.with_hash(spark.createDataFrame(rows, FILES))


def test_sets_and_ranks(files):
    members = {(r.path): r["rank"] for r in exact.members(files).collect()}
    assert members == {"p/z": 1, "a/y": 2, "b/x": 3, "r": 1, "s": 2}
    assert sorted((r.size, r.n, r.first_path) for r in exact.groups(files).collect()) == [(0, 2, "r"), (3, 3, "p/z")]
    assert {(r.a, r.b) for r in exact.verified_pairs(files).collect()} == {(1, 2), (1, 3), (2, 3), (5, 6)}
    assert {r.id for r in exact.size_candidates(files).collect()} == {1, 2, 3, 4, 5, 6}
    assert [r.id for r in exact.singletons(files).collect()] == [7]
    assert exact.reclaimable(exact.groups(files)).first().bytes == 6


def test_verify_parts_equal_hashes(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x", False, "h"), (2, "b", 1, "y", False, "h"), (3, "c", 1, "x", False, "h")], FILES + ", h string")
    assert exact.groups(rows).first().n == 3 and exact.groups(rows, verify=True).first().n == 2


def test_order_does_not_matter(files):
    want = sorted(map(tuple, exact.members(files).select("path", "rank").collect()))
    assert all(sorted(map(tuple, exact.members(files.repartition(n, "path")).select("path", "rank").collect())) == want for n in (1, 3, 8))


def test_candidates_read_no_content(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    listed = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"), "content").where(filters.size_between(F.col("size"), 1))
    plan = exact.size_candidates(listed.drop("content"))._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "content" not in plan and "GreaterThanOrEqual(length,1)" in plan


def test_top_is_a_partial_top(files):
    found = exact.top(files.select("id", "size"), 2, "size", "id")
    assert "TakeOrderedAndProject" in found._jdf.queryExecution().executedPlan().toString()
    assert [r.id for r in found.collect()] == [7, 1]


def test_filters(spark):
    paths = ["a/b.txt", ".hid/b.txt", "a/.b", "a/bad/c.TXT", "_u"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    keep = lambda c: {r.p for r in rows.where(c).collect()}
    p = F.col("p")
    assert keep(filters.visible(p)) == {"a/b.txt", "a/bad/c.TXT", "_u"}
    assert keep(filters.not_denied(p, ("bad", "b.txt"))) == {"a/.b", "_u"}
    assert keep(filters.whitelisted(p, r"\.txt$", True)) == {"a/b.txt", ".hid/b.txt", "a/bad/c.TXT"}
    assert keep(filters.not_ignored(p, "b")) == {"_u"}
    assert keep(filters.prioritized(p, "A/B", True)) == {"a/b.txt", "a/bad/c.TXT"}


@pytest.mark.parametrize("uid, gid, mode, user, ok", [(5, 1, 0o400, 5, True), (5, 1, 0o044, 5, False), (6, 7, 0o040, 5, True), (6, 7, 0o404, 5, False), (6, 1, 0o004, 5, True), (6, 1, 0o000, 0, True)])
def test_permissions(spark, uid, gid, mode, user, ok):
    row = spark.createDataFrame([(uid, gid, mode)], "u int, g int, m int").select(filters.permitted(F.col("u"), F.col("g"), F.col("m"), user, [7]).alias("ok")).first()
    assert row.ok is ok


def test_pairs_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    vectors = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(60)]
    vectors += [(60, vectors[0][1]), (61, [2 * x for x in vectors[1][1]]), (62, [0.0] * 6), (63, [0.0] * 6), (64, None), (65, [float("nan")] * 6), (66, [1.0])]
    size = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for i, a in vectors[:64]:
        for j, b in vectors[:64]:
            if i < j and ((size(a) + size(b)) == 0 or size([x - y for x, y in zip(a, b, strict=True)]) / (size(a) + size(b)) < 0.5):
                want.add((i, j))
    rows = spark.createDataFrame(vectors, "id int, v array<double>")
    for block in (7, 1000):
        got = [(r.a, r.b) for r in similar.pairs(rows, 0.5, block=block).collect()]
        assert set(got) == want and len(got) == len(want)


def test_stars_overlap(spark):
    found = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1)], "a int, b int, distance double")
    sizes = spark.createDataFrame([(1, 10), (2, 20), (3, 20)], "id int, size int")
    assert {r.pivot: r.others for r in similar.stars(found, sizes).collect()} == {2: [1, 3]}


def test_ordered(spark):
    rows = spark.createDataFrame([(f"key{i:04d}".encode(), f"val{i:04d}") for i in range(0, 1000)], "k binary, v string").repartition(5)
    assert ordered.first(rows).first().v == "val0000" and ordered.last(rows).first().v == "val0999"
    assert ordered.get(rows, b"key0500").first().v == "val0500" and ordered.seek(rows, b"key0500a").first().v == "val0501"
    assert ordered.seek(rows, b"key0999a").first() is None and ordered.key_range(rows, b"key0990").count() == 10
    near = {bytes(r.k): r for r in ordered.neighbours(rows).collect()}
    assert near[b"key0000"].prev_key is None and bytes(near[b"key0500"].next_key) == b"key0501" and near[b"key0999"].next_key is None
    probes = spark.createDataFrame([(b"key0500a",), (b"a",), (b"z",)], "k binary")
    assert "NestedLoop" not in ordered.seek_many(rows, probes)._jdf.queryExecution().executedPlan().toString()
    assert {bytes(r.probe): r.k and bytes(r.k) for r in ordered.seek_many(rows, probes).collect()} == {b"key0500a": b"key0501", b"a": b"key0000", b"z": None}


def test_latest(spark):
    log = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 9, 1)], "k string, v int, t int")
    assert sorted((r.k, r.v) for r in ordered.latest(log, ["k"], ["t"]).collect()) == [("a", 2), ("b", 9)]


@pytest.mark.parametrize("threshold", [0.1, 0.6, 0.999, 1.0, 1.5])
def test_similarity_of_vectors_of_mixed_lengths(spark, threshold):
    """Lengths from a thousandth to a thousand, with zero vectors, ties and another dimension."""
    import numpy as np

    rnd = np.random.default_rng(1)
    base = rnd.normal(size=(12, 4))
    x = [(base[k % 12] + 0.3 * rnd.normal(size=4)) * 10 ** rnd.uniform(-3, 3) for k in range(260)]
    x += [np.zeros(4), np.zeros(4), x[0], x[0] * 1.22, x[1] * (1 + threshold) / max(1 - threshold, 1e-9), np.ones(3), np.ones(3) * 1.01, np.zeros(0), np.zeros(0)]
    want = set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if len(x[i]) == len(x[j]):
                total = np.sqrt((x[i] ** 2).sum()) + np.sqrt((x[j] ** 2).sum())
                if (np.sqrt(((x[i] - x[j]) ** 2).sum()) / total if total else 0.0) < threshold:
                    want.add((i, j))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    assert {(r.a, r.b) for r in similar.pairs(rows, threshold, block=16).collect()} == want


def test_similarity_sends_little_where_lengths_differ(spark):
    from pyspark.sql import functions as F

    rows = spark.range(4096).select("id", F.array(*[F.pow(F.lit(1.01), F.col("id") % 1024) * F.lit(1.0 + k) for k in range(3)]).alias("v"), F.lit(3).alias("dim"))
    sent = lambda df, t: similar.dealt(df, t, 64).count()
    assert sent(rows, 0.2) < 0.2 * 4096 * 64
    units = rows.select("id", F.array(*[F.lit(1.0)] * 3).alias("v"), "dim")
    assert sent(units, 0.2) == 4096 * 64  # one band: every block meets every block


def test_similarity_sends_no_more_of_a_vector_as_tables_grow(spark):
    from pyspark.sql import functions as F

    rows = lambda n: spark.range(n).select("id", F.array(F.lit(1.0), F.lit(0.0)).alias("v"), F.lit(2).alias("dim"))
    assert [similar.dealt(rows(n), 0.6).count() for n in (1000, 40_000, 160_000)] == [1000, 40_000 * 16, 160_000 * 16]


def test_sides_of_pairs_that_carry_their_sizes(spark, monkeypatch):
    """The same pairs from small tiles and batches, for ids that are text, and no shuffle after the pairs."""
    for name, value in (("TILE", (3, 5)), ("GAPS", 64), ("BATCH", 4)):
        monkeypatch.setattr(similar, name, value)
    rows = spark.range(60).selectExpr("concat('p', id) as id", "array(cast(1 + id % 4 as float), cast(id % 3 as float)) as v", "id % 5 as size")
    sizes, found = rows.select("id", "size"), similar.pairs(rows, 0.3, block=16, size="size")
    plain = similar.pairs(rows.select("id", F_double("v").alias("v")), 0.3, block=16)
    assert found.columns == ["a", "b", "distance", "sa", "sb"] and plain.columns == ["a", "b", "distance"]
    assert sorted(map(tuple, found.select("a", "b", "distance").collect())) == sorted(map(tuple, plain.collect()))
    want = sorted((r.pivot, r.others) for r in similar.stars(plain, sizes).collect())
    assert want and sorted((r.pivot, r.others) for r in similar.stars(found).collect()) == want
    assert plan_of(similar.sided(found)).count("Exchange") == plan_of(found).count("Exchange")


def F_double(name):
    from pyspark.sql import functions as F

    return F.col(name).cast("array<double>")


@pytest.fixture
def many_parts(spark):
    """Range partitions of a few rows each."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_over_the_whole_table_without_one_task(spark, many_parts):
    import random

    rnd = random.Random(3)
    keys = [rnd.randrange(60) for _ in range(90)] + [None, None, 1000]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int")
    got = ordered.neighbours(rows)
    assert "SinglePartition" not in plan_of(got)
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    want = sorted(zip([None, *order[:-1]], order, [*order[1:], None], strict=True), key=repr)
    assert sorted(((r.prev_key, r.k, r.next_key) for r in got.collect()), key=repr) == want
    assert ordered.neighbours(rows.limit(0)).collect() == []
    sizes = exact.size_changes(rows.where("k is not null").selectExpr("k as size"))
    distinct = sorted({k for k in keys if k is not None})
    assert "SinglePartition" not in plan_of(sizes) and {r.size: r.before for r in sizes.collect()} == dict(zip(distinct, [*distinct[1:], None], strict=True))


def test_seeks_over_many_parts(spark, many_parts):
    rows = spark.range(0, 1000, 50).selectExpr("cast(id as int) as k")
    probes = spark.range(0, 1100, 7).selectExpr("cast(id as int) as k").union(spark.range(0, 21, 7).selectExpr("cast(id as int)"))
    found = ordered.seek_many(rows, probes)
    assert "SinglePartition" not in plan_of(found)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((p, -(-p // 50) * 50 if p <= 950 else None) for p in range(0, 1100, 7)), key=repr)
    assert ordered.seek_many(rows.limit(0), probes.where("k = 7")).collect()[0].k is None


def test_seeks_carry_the_last_key_on(spark):
    """A frame that is open ahead costs the square of a part's rows: half a million in one part would take minutes."""
    rows = spark.range(0, 1_000_000, 2).selectExpr("id as k")
    probes = spark.range(0, 1_000_020, 1001).selectExpr("id as k")
    found = ordered.seek_many(rows, probes)
    assert "unboundedfollowing" not in plan_of(found).lower()
    assert {r.probe: r.k for r in found.collect()} == {p: p + p % 2 if p < 999_999 else None for p in range(0, 1_000_020, 1001)}
    hot = spark.createDataFrame([(5,)] * 40 + [(3,), (None,)], "k int")
    assert sorted(map(tuple, ordered.seek_many(hot, spark.createDataFrame([(3,), (4,), (5,), (5,), (None,)], "k int")).collect())) == [(3, 3), (4, 5), (5, 5)]


def test_a_hot_set_is_ranked_by_several_tasks(spark, many_parts):
    from pyspark.sql import functions as F

    from dupspark.operators import global_order

    rows = spark.range(3000).selectExpr("case when id % 3 > 0 then 7L else id % 40 end as size", "'h' as h", "concat('p', id) as path", "id % 5 = 0 as prioritized", "id")
    want = exact.members(rows).select("size", "path", "n", "rank")
    got = exact.members(rows, spread=True).select("size", "path", "n", "rank")
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    cut = global_order.parts(rows, "size", "h", F.desc("prioritized"), "path")
    assert cut.where("size = 7").select("_part").distinct().count() >= 4


@pytest.mark.parametrize("per", [1, 3, 1000])
def test_reports_in_chunks(spark, per):
    import json

    from pyspark.sql import functions as F

    from dupspark.plans import report

    rows = spark.range(40).selectExpr("id % 3 as size", "concat('h', id % 3) as h", "concat('p', lpad(id, 2, '0')) as path", "cast(null as string) as subpath", "id = 5 as prioritized", "timestamp'2024-01-01' as mtime")
    members = exact.members(rows)
    sets = report.json_sets(members).orderBy(F.desc("size_bytes"), "hash_xxh128").collect()
    assert "".join(report.json_pieces(members, per=per)) == json.dumps([r.asDict(recursive=True) for r in sets], indent=2)
    assert "".join(report.json_pieces(members.limit(0), per=per)) == "[]"
    shown = [r.shown for r in report.sets(members, ";").orderBy(F.desc("size"), "shown").collect()]
    assert "".join(report.text_lines(members, ";", per=per)) == "".join(s + "\n\n" for s in shown)
    assert max(r.n for r in report.chunks(members, F.col("path"), per).select(F.size("entries").alias("n")).collect()) <= per
