import pytest

from dupspark.operators.cache import HashCache
from dupspark.operators.kv import KeyExists, Locked, SnapshotTable


def rows(spark, *pairs):
    return spark.createDataFrame([(k.encode(), v.encode()) for k, v in pairs], "k binary, v binary")


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "kv"), "k binary, v binary", partitions=2)


def state(df):
    return {bytes(r.k).decode(): bytes(r.v).decode() for r in df.collect()}


def test_insert_read_delete(spark, table):
    assert table.live() == 0 and state(table.read()) == {}
    with table.writer() as w:
        w.insert(rows(spark, ("keyC", "3"), ("keyA", "1"), ("keyB", "2")))
    assert state(table.read()) == {"keyA": "1", "keyB": "2", "keyC": "3"} and bytes(table.get(b"keyB").first().v) == b"2"
    with table.writer() as w:
        missing = w.delete(rows(spark, ("keyB", ""), ("keyZ", "")))
        assert [bytes(r.k) for r in missing.collect()] == [b"keyZ"]
    assert state(table.read()) == {"keyA": "1", "keyC": "3"} and table.get(b"keyB").first() is None
    assert state(table.read(1)) == {"keyA": "1", "keyB": "2", "keyC": "3"}


def test_insert_refuses_a_known_key_and_upsert_replaces(spark, table):
    with table.writer() as w:
        w.insert(rows(spark, ("a", "1")))
    for bad in ((("a", "2"),), (("b", "1"), ("b", "2"))):
        with pytest.raises(KeyExists), table.writer() as w:
            w.insert(rows(spark, *bad))
    with table.writer() as w:
        w.upsert(rows(spark, ("a", "2"), ("b", "1"), ("b", "3")))
    assert state(table.read()) == {"a": "2", "b": "3"}


def test_abort_and_one_writer(spark, table):
    with pytest.raises(RuntimeError, match="stop"), table.writer() as w:
        w.insert(rows(spark, ("a", "1")))
        raise RuntimeError("stop")
    assert table.live() == 0
    with table.writer(), pytest.raises(Locked), table.writer():
        pass
    with pytest.raises(ValueError), table.writer() as w:
        w.insert(spark.createDataFrame([("x", 1)], "k string, v int"))


def test_snapshots_and_retention(spark, table):
    assert table.oldest_reader() == 0
    for n in range(1, 4):
        with table.writer() as w:
            w.upsert(rows(spark, ("a", str(n))))
        if n == 1:
            pin = table.reader()
            old = pin.__enter__()
    assert state(old) == {"a": "1"} and table.oldest_reader() == 1
    assert table.retain() == [] and state(table.read()) == {"a": "3"}
    pin.__exit__(None, None, None)
    assert table.oldest_reader() == 0 and table.retain() == [1, 2] and table.versions() == [3]


def test_many_rows_and_a_large_value(spark, table):
    with table.writer() as w:
        w.insert(spark.range(10_000).selectExpr("cast(format_string('key_%08d', id) as binary) k", "cast(format_string('data_%08d', id) as binary) v"))
    with table.writer() as w:
        w.upsert(rows(spark, ("big", "x" * 100_000)))
    assert table.read().count() == 10_001 and len(table.get(b"big").first().v) == 100_000
    assert bytes(table.get(b"key_00009999").first().v) == b"data_00009999"


def entries(spark, *names):
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "path string, i int").selectExpr("path", "timestamp_seconds(100000 + i) mtime", "timestamp_seconds(100001 + i) ctime", "cast(10000 + 1000 * i as bigint) size", "md5(path) h")


def test_cache(spark, tmp_path):
    cache = HashCache(spark, str(tmp_path / "cache"))
    with cache.opened():
        with pytest.raises(Locked), HashCache(spark, str(tmp_path / "cache")).opened():
            pass
        names = [f"/sweep/test/{c}" for c in "abcd"] + ["/sweep/ф x", ""]
        files = entries(spark, *names)
        cache.upsert(files)
        found = {r.path: r for r in cache.lookup(spark.createDataFrame([("/sweep/test/b",), ("none",)], "path string")).collect()}
        assert found["/sweep/test/b"].cached_size == 11000 and found["none"].cached_h is None
        changed = files.selectExpr("path", "mtime", "ctime", "size + cast(path like '%c' as int) as size")
        assert {r.path for r in cache.fresh(changed).where("h is null").collect()} == {"/sweep/test/c"}
        cache.mark(files.where("path like '%a'"))
        cache.mark(files.where("path like '%a' or path like '%c'"))
        cache.sweep()
        assert {r.path for r in cache.table.read().collect()} == {"/sweep/test/a", "/sweep/test/c"}
        cache.mark(files.where("path like '%a'"))
        cache.sweep()
        assert {r.path for r in cache.table.read().collect()} == {"/sweep/test/a"}
    with cache.opened():
        pass


def test_stream_of_writes(spark, tmp_path):
    from dupspark.streaming.upsert import upsert_stream

    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v int")
    spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 5, 1)], "k string, v int, t int").coalesce(1).write.parquet(str(tmp_path / "in"))
    log = spark.readStream.schema("k string, v int, t int").parquet(str(tmp_path / "in"))
    upsert_stream(log, table, ["t"], str(tmp_path / "ck")).awaitTermination(120)
    assert {r.k: r.v for r in table.read().collect()} == {"a": 2, "b": 5}


def test_null_keys_are_refused(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long")
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v long")
    for change in ("insert", "upsert"):
        with pytest.raises(ValueError, match="null"), table.writer() as batch:
            getattr(batch, change)(rows)
    with table.writer() as batch:
        batch.upsert(rows.where("k is not null"))
    with table.writer() as batch:
        assert [r.k for r in batch.delete(rows.select("k")).collect()] == [None]
    assert table.read().count() == 0


def test_locks_of_dead_or_late_owners_are_void(spark, tmp_path):
    import json
    import os
    import socket
    import subprocess
    import sys
    import time

    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long")
    gone = subprocess.Popen([sys.executable, "-c", ""])
    gone.wait()
    rows = spark.createDataFrame([("a", 1)], "k string, v long")
    hour = time.time() + 3600
    for lock, free in (({"host": socket.gethostname(), "pid": gone.pid, "until": hour}, True), ({"host": "elsewhere", "pid": 1, "until": 1}, True), ({"host": "elsewhere", "pid": 1, "until": hour}, False), ({"host": socket.gethostname(), "pid": os.getpid(), "until": hour}, False)):
        token = table.files.token("writer") + 1
        table.files.create(f"writer/{token:012d}.json", json.dumps(lock))
        if free:
            with table.writer() as batch:
                batch.upsert(rows)
            assert table.files.token("writer") == token + 1
        else:
            with pytest.raises(Locked), table.writer():
                pass
            table.files.release("writer", token)


def test_of_two_takers_of_an_ended_lease_one_publishes(spark, tmp_path):
    """The first writer sleeps through its lease; the second takes the lock and publishes; the first wakes up and can't."""
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long", lease=0.0)
    row = lambda v: spark.createDataFrame([("a", v)], "k string, v long")
    with pytest.raises(Locked), table.writer() as first:
        first.upsert(row(1))
        with table.writer() as second:
            second.upsert(row(2))
    assert {r.k: r.v for r in table.read().collect()} == {"a": 2} and table.versions() == [1]
    with table.writer() as later:  # clears what the first one wrote
        later.upsert(row(3))
    assert len(table.files.names("data")) == 2 and table.read().first().v == 3
    tokens = [table.files.claim("writer", 0.0), table.files.claim("writer", 0.0)]
    run = table.write(row(9).selectExpr("k", "v", "false as _tombstone"), tokens[0], False)
    with pytest.raises(Locked):
        table.publish(3, 2, [run], tokens[0])
    table.publish(3, 2, [run], tokens[1])
    with pytest.raises(Locked):
        table.publish(3, 2, [run], tokens[1])


def size(table):
    import os

    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(table.files.root + "/data") for f in names if f.endswith(".parquet"))


def test_a_commit_writes_what_it_changes(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v string", partitions=8)
    rows = spark.range(100_000).selectExpr("format_string('key_%08d', id) k", "sha2(cast(id as string), 256) v")
    with table.writer() as batch:
        batch.insert(rows)
    whole = size(table)
    with table.writer() as batch:  # 1 % of the keys, all over the table
        batch.upsert(rows.where("xxhash64(k) % 100 = 0").selectExpr("k", "upper(v) v"))
    with table.writer() as batch:
        batch.delete(rows.where("xxhash64(k) % 100 = 1").select("k"))
    assert size(table) - whole < 0.04 * whole
    sums = lambda: table.read().selectExpr("count(*)", "sum(cast(xxhash64(k, v) as decimal(38, 0)))").first()
    before = sums()
    assert before[0] == rows.where("xxhash64(k) % 100 <> 1").count()
    now = table.live()
    assert table.compact(whole=False) and len(table.runs(table.live())) == 2 and sums() == before
    assert table.compact() and len(table.runs(table.live())) == 1 and sums() == before and not table.compact()
    assert table.read(now).count() == before[0] and table.retain() == list(range(1, now + 2))
    assert len(table.files.names("data")) == 1 and sums() == before


def test_reads_leave_files_without_changes_as_they_are(spark, tmp_path):
    """Only the base file whose key range meets the delta is joined with it."""
    table = SnapshotTable(spark, str(tmp_path / "t"), "k long, v long", partitions=10)
    with table.writer() as batch:
        batch.insert(spark.range(10_000).selectExpr("id k", "id v"))
    with table.writer() as batch:
        batch.upsert(spark.range(5).selectExpr("id k", "-1L v"))
    with table.writer() as batch:
        batch.delete(spark.range(3, 8).selectExpr("id k"))
    base, *deltas = table.runs(3)
    from dupspark.operators.kv import touched

    assert sum(touched(base["files"], [f for d in deltas for f in d["files"]])) == 1
    plan = table.read()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "Union" in plan
    assert table.read().selectExpr("sum(v)").first()[0] == sum(range(8, 10_000)) - 3


def test_any_order_of_changes(spark, tmp_path):
    """Random batches against a dictionary, with merges of deltas and of the whole between them."""
    import random

    rnd = random.Random(5)
    table, truth = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long", partitions=3, most_deltas=3), {}
    for n in range(9):
        with table.writer() as batch:
            for _ in range(rnd.randint(1, 3)):
                some = {f"k{rnd.randrange(40):02d}": rnd.randrange(1000) for _ in range(rnd.randint(0, 8))}
                keys = spark.createDataFrame([(k,) for k in some], "k string")
                what = rnd.choice(["upsert", "upsert", "insert", "delete", "keep"] if n else ["insert"])
                if what == "insert":
                    some = {k: v for k, v in some.items() if k not in truth}
                if what in ("insert", "upsert"):
                    getattr(batch, what)(spark.createDataFrame(list(some.items()), "k string, v long"))
                    truth |= some
                elif what == "delete":
                    assert {r.k for r in batch.delete(keys).collect()} == set(some) - set(truth)
                    truth = {k: v for k, v in truth.items() if k not in some}
                else:
                    kept = [k for k in truth if rnd.random() < 0.8]
                    batch.keep(spark.createDataFrame([(k,) for k in kept], "k string"))
                    truth = {k: truth[k] for k in kept}
        assert {r.k: r.v for r in table.read().collect()} == truth
        assert len(table.runs(table.live())) <= 4
    table.compact()
    assert {r.k: r.v for r in table.read().collect()} == truth and table.read().count() == len(truth)


def rows_scanned(df):
    """Rows that the file scans of a query gave out."""
    df.collect()
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_a_missing_key_opens_no_row_group(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long", partitions=2)
    with table.writer() as batch:
        batch.insert(spark.range(0, 200_000, 2).selectExpr("format_string('key_%08d', id) k", "id v"))
    assert table.get("key_00000500").first().v == 500 and rows_scanned(table.get("key_00000500")) > 0
    assert [rows_scanned(table.get(f"key_{n:08d}")) for n in (501, 40_001, 150_001)] == [0, 0, 0]


def test_torn_manifests_and_missing_runs_are_no_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), "k string, v long")
    with table.writer() as batch:
        batch.upsert(spark.createDataFrame([("a", 1)], "k string, v long"))
    table.files.create("manifests/000000000002.json", '{"version": 2, "ru')
    table.files.create("manifests/000000000003.json", '{"version": 3, "base": 1, "runs": [{"folder": "none", "files": []}]}')
    assert table.live() == 1 and table.versions() == [1] and table.read().count() == 1
    with table.writer() as batch:
        batch.upsert(spark.createDataFrame([("b", 1)], "k string, v long"))
    assert table.versions() == [1, 4] and table.read().count() == 2
