"""Ignore rules: verdicts of single paths, and what they mean for a tree."""

import pytest

from dupspark.operators.rules import Context, java_regex, parse_rule, parse_rules, survives, verdict


def verdicts(spark, contexts, *probes, strict=False):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, p, d) for i, (p, d) in enumerate(probes)], "i int, path string, is_dir boolean")
    return [r.v[0] for r in rows.select("i", verdict(F.col("path"), F.col("is_dir"), contexts, strict).alias("v")).orderBy("i").collect()]


def base(*lines, at="/test"):
    return Context(at, tuple(parse_rules(lines)))


@pytest.mark.parametrize(
    "lines, probes, said",
    [
        (["*.o"], [("file.o", False), ("file.c", False)], "IN"),
        (["build/"], [("build", True), ("build", False)], "IN"),
        (["**/*.tmp"], [("file.tmp", False), ("subdir/file.tmp", False), ("a/b/c/file.tmp", False), ("file.txt", False)], "IIIN"),
        (["*.log", "!important.log"], [("debug.log", False), ("important.log", False)], "IW"),
        (["/build"], [("build", True), ("subdir/build", True)], "IN"),
        (["# comment", "", "*.o", "build/", "*.tmp"], [("file.o", False), ("build", True), ("file.tmp", False)], "III"),
        ([".git/", ".svn/"], [(".git", True), (".svn", True), (".github", True)], "IIN"),
        (["test_*.c"], [("test_foo.c", False), ("test_bar.c", False), ("mytest.c", False)], "IIN"),
        (["*.log", "!important.log", "*.log"], [("important.log", False)], "I"),
        (["*.o\r\n", "build/\r\n"], [("file.o", False), ("build", True)], "II"),
        (["   *.o"], [("file.o", False)], "I"),
        (["file?.o"], [("file1.o", False), ("file.o", False)], "IN"),
        (["file[0-9].o"], [("file1.o", False), ("filea.o", False)], "IN"),
        (["file[!0-9].o"], [("file1.o", False), ("filea.o", False)], "NI"),
        ([r"\*.o"], [("*.o", False), ("file.o", False)], "IN"),
        (["a.b+c"], [("a.b+c", False), ("axb+c", False)], "IN"),
        (["doc/*.txt"], [("doc/a.txt", False), ("x/doc/a.txt", False), ("doc/x/a.txt", False)], "IIN"),
    ],
)
def test_one_context(spark, lines, probes, said):
    assert "".join(verdicts(spark, [base(*lines)], *[(f"/test/{p}", d) for p, d in probes])) == said


def test_child_extends_and_overrides(spark):
    parent, child = base("*.o", "*.tmp"), base("!*.tmp", "*.c", at="/test/subdir")
    probes = [("/test/subdir/file.o", False), ("/test/subdir/file.tmp", False), ("/test/subdir/file.c", False), ("/test/file.c", False), ("/testing/file.o", False)]
    assert verdicts(spark, [parent, child], *probes) == list("IWINN")
    assert verdicts(spark, [parent, child], *probes, strict=True) == list("IIINN")


def test_an_ignored_directory_takes_its_files_along(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(p,) for p in ("build/a.c", "src/build/deep/a.c", "src/a.c", "build", "a/b/keep.o")], "path string")
    contexts = [Context("", tuple(parse_rules(["build/", "*.o", "!keep.o"])))]
    assert sorted(r.path for r in rows.where(survives(F.col("path"), contexts)).collect()) == ["a/b/keep.o", "build", "src/a.c"]


def test_comments_and_bad_patterns():
    assert parse_rule("# x") is None and parse_rule("   ") is None
    with pytest.raises(ValueError):
        java_regex("[invalid")


def test_final_dollar_is_the_end(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("a\n",), ("a",)], "p string")
    assert rows.where(F.col("p").rlike(java_regex("a$"))).count() == 1
    assert java_regex(r"a\$").endswith(r"a\$")


def rule_rows(spark, contexts):
    from dupspark.operators import rule_tables

    lines = [(base, n, line) for base, own in contexts for n, line in enumerate(own)]
    return rule_tables.parsed(spark.createDataFrame(lines, "base string, ord int, line string"))


@pytest.mark.parametrize("strict", [False, True])
def test_rules_as_rows_say_the_same(spark, strict):
    import random

    from pyspark.sql import functions as F

    from dupspark.operators import rule_tables

    rnd = random.Random(4)
    names = ["a", "b", "c.o", "build", "x.tmp", "keep"]
    paths = sorted({"/".join(rnd.choice(names) for _ in range(rnd.randint(1, 5))) for _ in range(200)})
    lines = ["*.o", "build/", "!build/", "!keep", "/a", "b/*.tmp", "**/x.tmp", "!*.o", "# no", "", "keep"]
    contexts = [(base, [rnd.choice(lines) for _ in range(rnd.randint(1, 4))]) for base in ("", "a", "a/b", "b", "a/b/build", "build", "keep/a")]
    told = [Context(base, tuple(parse_rules(own))) for base, own in contexts]
    rows = spark.createDataFrame([(p, d) for p in paths for d in (True, False)] + [("a", False), ("a", False)], "path string, is_dir boolean")
    want = sorted(map(tuple, rows.select("path", "is_dir", verdict(F.col("path"), F.col("is_dir"), told, strict)).collect()))
    assert sorted(map(tuple, rule_tables.verdicts(rows, rule_rows(spark, contexts), strict).collect())) == want
    files = rows.where("not is_dir")
    kept = sorted(r.path for r in files.where(survives(F.col("path"), told, strict)).collect())
    assert sorted(r.path for r in rule_tables.surviving(files, rule_rows(spark, contexts), strict).collect()) == kept and 0 < len(kept) < len(paths)


def test_rules_as_rows_of_absolute_folders_and_nulls(spark):
    from dupspark.operators import rule_tables

    table = rule_rows(spark, [("/test/", ["*.o", "*.tmp"]), ("/test/subdir", ["!*.tmp"]), (None, [None, "*.zip"])])
    rows = spark.createDataFrame([(p, False) for p in ("/test/subdir/file.o", "/test/subdir/file.tmp", "/test/file.tmp", "/testing/file.o", "/q/a.zip", None)], "path string, is_dir boolean")
    got = {r.path: r.verdict for r in rule_tables.verdicts(rows, table).collect()}
    assert got == {"/test/subdir/file.o": "IGNORED", "/test/subdir/file.tmp": "WHITELISTED", "/test/file.tmp": "IGNORED", "/testing/file.o": "NONE", "/q/a.zip": "IGNORED", None: "NONE"}


def test_ten_thousand_rules_plan_in_a_second(spark):
    import time

    from dupspark.operators import rule_tables

    lines = spark.range(10_000).selectExpr("concat('d', id % 2000) as base", "cast(id as int) as ord", "concat('*.x', id) as line")
    rows = spark.range(5000).selectExpr("concat('d', id % 3000, '/f.x', id) as path", "false as is_dir")
    began = time.perf_counter()
    out = rule_tables.verdicts(rows, rule_tables.parsed(lines))
    out._jdf.queryExecution().executedPlan()
    assert time.perf_counter() - began < 2
    assert out.where("verdict = 'IGNORED'").count() == sum(1 for k in range(5000) if any(r % 2000 == k % 3000 for r in [k]))
