import pytest
from pyspark.sql import functions as F

from dupspark.functions.hashing import iso_utc, xxh128
from dupspark.functions.sizes import human_size, parse_size, parsed_size
from dupspark.functions.vectors import level, normalized_distance
from dupspark.options import Options

SHOWN = {0: "0 B", 512: "512 B", 1023: "1023 B", 1024: "1.0 KiB", 1280: "1.2 KiB", 1536: "1.5 KiB", 1792: "1.8 KiB", 1 << 20: "1.0 MiB", 1 << 30: "1.0 GiB", 1 << 40: "1.0 TiB", 1 << 50: "1.0 PiB", 1 << 60: "1.0 EiB"}
SIZES = {"1024": 1024, "1K": 1024, "1k": 1024, "1M": 1 << 20, "1m": 1 << 20, "1G": 1 << 30, "1g": 1 << 30, "1T": 1 << 40, "1t": 1 << 40, "1.5K": 1536, "2.5M": 2621440, " 2 Kfoo": 2048, "1Z": -1, "abc": -1, "1.5.5K": -1, "": -1, "1B": -1}


def test_human_size(spark):
    rows = spark.createDataFrame([(k,) for k in SHOWN], "n bigint")
    assert {r.n: r.s for r in rows.select("n", human_size(F.col("n")).alias("s")).collect()} == SHOWN


def test_human_size_up_to_a_unit(spark, tmp_path):
    """The query shows TiB at most, as its SQL does, however large the keys grow."""
    import duckdb

    from dupspark.plans import registry

    spark.range(1, 60_000_001, 999_983).selectExpr("id as o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = sorted(map(tuple, registry.queries()["human_sizes"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.oracle_sql()["human_sizes"]).fetchall()) and got[-1][1] > 1 << 56
    assert spark.range(1).select(human_size(F.lit(1 << 50), "TiB"), human_size(F.lit(1 << 50))).first()[:] == ("1024.0 TiB", "1.0 PiB")


def test_parse_size(spark):
    assert {k: parse_size(k) for k in SIZES} == SIZES
    rows = spark.createDataFrame([(k,) for k in [*SIZES, None]], "t string")
    assert {r.t: r.n for r in rows.select("t", parsed_size(F.col("t")).alias("n")).collect()} == SIZES | {None: None}


def test_hash_and_time(spark):
    import xxhash

    row = spark.createDataFrame([(bytearray(b"abc"), "2024-05-06 07:08:09.987")], "b binary, t string").select(xxh128(F.col("b")).alias("h"), iso_utc(F.col("t").cast("timestamp")).alias("t")).first()
    assert row.h == xxhash.xxh3_128_hexdigest(b"abc") and len(row.h) == 32 and row.t == "2024-05-06T07:08:09Z"


def test_iso_is_utc_in_any_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.sql("select timestamp'2024-01-01 00:00:00 UTC' t").select(iso_utc(F.col("t")).alias("t")).first().t == "2024-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_distance(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([0.0], [0.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r.d for r in rows.select(normalized_distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got[0] == pytest.approx(2**0.5 / 2) and got[1:] == [0.0, None]


def test_levels_and_options():
    assert [level(k) for k in range(1, 6)] == [0.2, 0.3, 0.5, 0.6, 0.7]
    o = Options.parse(["-m", "2K", "-M", "8K", "-i", "x,y", "-p", "/a", "-T", "3", "-j", "4", "dir"])
    assert (o.min_size, o.max_size, o.deny, o.priority, o.threshold, o.threads, o.roots) == (2048, 8192, (".", "..", "x", "y"), "/a", 0.5, 4, ("dir",))
    image = Options.parse(["-w", "abc", "-I", "dir"])
    assert image.ignore_case and "png" in image.whitelist_regex
    for bad in (["-j", "foo", "d"], ["-j", "0", "d"], ["-j", "257", "d"], ["-x", "1Z", "d"], ["-m", "1Z", "d"], ["-e", "[invalid", "d"], ["-T", "99", "d"], ["-a"]):
        with pytest.raises(ValueError):
            Options.parse(bad)
