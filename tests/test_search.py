"""The whole search over real folders."""

import io
import json
import os
import tarfile

import pytest

from dupspark.options import Options
from dupspark.plans import search
from dupspark.sources import archives, files


def run(spark, *argv):
    out = io.StringIO()
    assert search.main([str(a) for a in argv], spark, out) == 0
    return out.getvalue()


def write(folder, **sizes):
    for name, content in sizes.items():
        path = folder / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else bytes(i % 256 for i in range(content)))


@pytest.fixture
def tree(tmp_path):
    write(tmp_path, f1K=b"a" * 1024, f5K=b"b" * 5120, f10K=b"c" * 10240, f5K_copy=b"b" * 5120, deep__nested=b"b" * 5120)
    (tmp_path / ".hidden").write_bytes(b"b" * 5120)
    (tmp_path / "_under").write_bytes(b"")
    (tmp_path / "empty").write_bytes(b"")
    return tmp_path


def test_sizes_recursion_hidden(spark, tree):
    text = run(spark, "-m", "2K", "-M", "8K", tree)
    assert "f5K_copy" in text and "nested" in text and "f1K" not in text and "f10K" not in text and ".hidden" not in text
    assert "nested" not in run(spark, "-R", tree) and ".hidden" in run(spark, "-a", tree)
    both = run(spark, tree)
    assert "_under" in both and "empty" in both  # empty files are copies of each other
    assert run(spark, "-d", "-m", "1K", tree).startswith("Size: 5.0 KiB\n")
    first = run(spark, "-p", tree / "f5K_c", "-m", "1K", "-s", ";", tree).split(";")[0]
    assert first.endswith("f5K_copy")


def test_notes_help_and_colour(spark, tree, capsys):
    from dupspark.plans import report

    run(spark, "-n", "-m", "1K", tree)
    assert capsys.readouterr().err.count("Dry run: would report") == 2
    assert "-p PATH" in run(spark, "-h") and run(spark, "-V").startswith("dupspark ")
    members, _ = search.duplicates(spark, Options.parse(["-m", "1K", str(tree)]))
    line = next(report.text_lines(members, show_size=True, colour=True))
    assert line.startswith("\x1b[1m\x1b[36mSize: 5.0 KiB\x1b[0m\n\x1b[34m") and line.endswith("\x1b[0m\n\n")


def test_nothing_and_missing(spark, tmp_path):
    write(tmp_path, a=b"1", b=b"22")
    assert run(spark, tmp_path) == ""
    with pytest.raises(Exception, match="No such file or directory"):
        run(spark, tmp_path / "absent")
    with pytest.raises(ValueError, match="at least one file"):
        run(spark, "-m", "1M", tmp_path)


def test_json(spark, tree):
    import xxhash

    found = json.loads(run(spark, "-J", "-m", "1K", tree))
    assert len(found) == 1 and found[0]["size_bytes"] == 5120 and found[0]["hash_xxh128"] == xxhash.xxh3_128_hexdigest(b"b" * 5120)
    assert len(found[0]["duplicates"]) == 3 and all(d["mtime_utc"].endswith("Z") and os.path.isabs(d["path"]) and d["prioritized"] is False for d in found[0]["duplicates"])


def test_regexes_and_ignore_files(spark, tmp_path):
    write(tmp_path, a__x_txt=b"same", b__y_txt=b"same", b__z_log=b"same", build__w_txt=b"same")
    (tmp_path / "b" / ".gitignore").write_text("*_log\n")
    text = run(spark, tmp_path)
    assert "x_txt" in text and "y_txt" in text and "z_log" not in text and "w_txt" not in text
    assert "y_txt" not in run(spark, "-e", "Y_T", "-c", tmp_path) and "x_txt" in run(spark, "-w", ".*_txt$", tmp_path)


def test_many_files_whatever_the_partitions(spark, tmp_path):
    for i in range(20):
        write(tmp_path, **{f"{c}{i}": 1024 + 100 * i for c in "abc"})
    want = None
    for n in ("1", "4"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        members, errors = search.duplicates(spark, Options.parse([str(tmp_path)]))
        got = sorted((r.size, r.path, r["rank"]) for r in members.collect())
        assert errors.count() == 0 and len(got) == 60 and (want is None or got == want)
        want = got
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_links_cycles_and_overlaps(spark, tmp_path):
    write(tmp_path, d__a=b"q", d__b=b"q")
    os.symlink(tmp_path / "d", tmp_path / "d" / "loop")
    os.symlink(tmp_path / "d" / "a", tmp_path / "link")
    names = lambda **o: sorted(r.relpath for r in files.scan(spark, [str(tmp_path)], **o).collect())
    assert names() == ["d/a", "d/b"] and names(follow=True) == ["d/a", "d/b", "link"]
    assert files.scan(spark, [str(tmp_path), str(tmp_path / "d")]).count() == 4
    assert search.listed(spark, Options(roots=(str(tmp_path), str(tmp_path / "d")), dedupe_paths=True)).count() == 2


def test_unreadable_is_an_error_row(spark, tmp_path):
    write(tmp_path, a=b"1", b=b"1")
    listed = files.scan(spark, [str(tmp_path)]).cache()
    listed.count()
    (tmp_path / "a").unlink()
    got = {r.relpath: (r.h, r.error) for r in files.with_file_hash(listed).collect()}
    assert got["a"][0] is None and "FileNotFound" in got["a"][1] and got["b"][1] is None
    assert files.with_content(listed).where("error is null").count() == 1


def test_archives(spark, tmp_path):
    write(tmp_path, d=b"same" * 10)
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        for name, data in (("a", b"same" * 10), ("b", b"same" * 10), ("c", b"other"), ("big", b"z" * 20_000)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (tmp_path / "bad.tar").write_bytes(b"no archive")
    text = run(spark, "-t", tmp_path)
    assert "x.tar.gz:a" in text and "x.tar.gz:b" in text and str(tmp_path / "d") in text and ":c" not in text
    packed = files.with_content(files.scan(spark, [str(tmp_path)]).where("path like '%tar%'"))
    assert archives.member(packed, "big").first().size == 20_000 and archives.member(packed, "none").first() is None
    assert archives.expand(packed).where("error is not null").count() == 1
    assert "|a" in run(spark, "-t", "-s", ":", tmp_path)


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, rgb):
        raw = b"".join(b"\0" + b"".join(bytes(rgb(x, y)) for x in range(64)) for y in range(64))
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 64, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    one = lambda x, y: (4 * x, 255 - 4 * y, 40)
    png(tmp_path / "a.png", one)
    png(tmp_path / "b.png", one)
    png(tmp_path / "c.png", lambda x, y: ((x // 8 + y // 8) % 2 * 255,) * 3)
    text = run(spark, "-I", tmp_path)
    assert "a.png" in text and "b.png" in text and "c.png" not in text


def test_ignore_files_hold_below_their_own_folder_alone(spark, tmp_path):
    write(tmp_path, A__s__x_dat=b"same", B__s__x_dat=b"same", B__s__y_dat=b"same", A__s__deep__z_dat=b"same")
    (tmp_path / "A" / "s" / ".gitignore").write_text("x_dat\n!kept/\n")
    text = run(spark, tmp_path / "A", tmp_path / "B")
    assert "B/s/x_dat" in text and "B/s/y_dat" in text and "A/s/deep/z_dat" in text and "A/s/x_dat" not in text


def test_ignored_folders_are_not_entered(tmp_path):
    write(tmp_path, node_modules__a=b"1", sub__build__b=b"1", sub__keep__c=b"1", sub__keep__build__d=b"1", top__node_modules__e=b"1")
    (tmp_path / "sub" / "keep" / ".gitignore").write_text("!build/\n")
    reader = files.FileTreeReader({"roots": json.dumps([str(tmp_path)]), "ignore": "true"})
    entered, plain = [], reader.entries
    reader.entries = lambda folder: entered.append(os.path.relpath(folder, tmp_path)) or plain(folder)
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert sorted(r[1] for r in rows if ".git" not in r[1]) == ["sub/keep/build/d", "sub/keep/c"]
    assert not {"node_modules", "sub/build", "top/node_modules"} & set(entered)


def test_unreadable_folder_is_a_row_and_no_failure(tmp_path, monkeypatch):
    write(tmp_path, good__a=b"1", bad__b=b"1")
    reader, plain = files.FileTreeReader({"roots": json.dumps([str(tmp_path)])}), os.scandir

    def scandir(folder):
        if str(folder).endswith("bad"):
            raise PermissionError(folder)
        return plain(folder)

    monkeypatch.setattr(os, "scandir", scandir)
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    assert sorted((r[1], r[9]) for r in rows) == [("bad", "unreadable"), ("good/a", "file")]


def test_json_of_archive_members_has_the_hash_that_it_names(spark, tmp_path):
    import xxhash

    write(tmp_path, d=b"same" * 10)
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        info = tarfile.TarInfo("m")
        info.size = 40
        t.addfile(info, io.BytesIO(b"same" * 10))
    found = json.loads(run(spark, "-J", "-t", tmp_path))
    assert len(found) == 1 and found[0]["hash_xxh128"] == xxhash.xxh3_128_hexdigest(b"same" * 10)
    assert sorted(d["archive_subpath"] or "" for d in found[0]["duplicates"]) == ["", "m"]


@pytest.mark.parametrize("packed", [False, True])
def test_verify_parts_contents_of_one_hash(spark, tmp_path, monkeypatch, packed):
    write(tmp_path, a=b"one", b=b"one", c=b"two", d=b"two", e=b"six")
    from pyspark.sql import functions as F

    monkeypatch.setattr(search.streams, "with_hash", lambda df, kind: df.withColumns({"h": F.lit("equal"), "error": F.lit(None).cast("string")}))
    options = ["-t", "-j", "2"] if packed else ["-j", "2"]
    plain, _ = search.duplicates(spark, Options.parse([*options, str(tmp_path)]))
    assert {r.n for r in plain.collect()} == {5}
    members, errors = search.duplicates(spark, Options.parse([*options, "--verify", str(tmp_path)]))
    got = sorted((os.path.basename(r.path), r.n, r["rank"]) for r in members.collect())
    assert got == [("a", 2, 1), ("b", 2, 2), ("c", 2, 1), ("d", 2, 2)] and errors.count() == 0


def test_members_before_a_broken_one_stay(spark):
    stream = io.BytesIO()
    with tarfile.open(fileobj=stream, mode="w") as t:
        for name in ("a", "b"):
            info = tarfile.TarInfo(name)
            info.size = 2000
            t.addfile(info, io.BytesIO(b"x" * 2000))
    short = stream.getvalue()[: 512 + 2048 + 512 + 700]
    rows = archives.expand(spark.createDataFrame([("t.tar", short)], "path string, content binary")).collect()
    assert rows[0].subpath == "a" and rows[0].size == 2000 and rows[-1].error is not None
    back = archives.expand(archives.packed(spark.createDataFrame([(1, None, "x"), (1, 2, None)], "c long, t long, x string"), "c", "t", "x"))
    assert sorted((r.path, r.subpath, r.size) for r in back.collect()) == [("1", "2", 0), ("1", "null", 1)]


@pytest.fixture
def opens(monkeypatch, tmp_path_factory):
    """Counts, over all workers, how often each file is opened for its content."""
    log = str(tmp_path_factory.mktemp("log") / "opens")

    def counted(path):
        with open(log, "a") as f:
            f.write(path + "\n")
        return open(path, "rb")

    monkeypatch.setattr(archives, "open_file", counted)

    def told():
        import collections

        if not os.path.exists(log):
            return {}
        with open(log) as f:
            found = collections.Counter(os.path.basename(x.strip()) for x in f)
        os.unlink(log)
        return dict(found)

    return told


def test_a_candidate_is_opened_once_and_a_singleton_never(spark, tmp_path, opens):
    write(tmp_path, a=b"one", sub__b=b"one", c=b"one", d=b"two", lone=b"another size")
    assert run(spark, tmp_path).split() == [str(tmp_path / n) for n in ("a", "c", "sub/b")]
    assert opens() == {"a": 1, "b": 1, "c": 1, "d": 1}
    assert run(spark, "--verify", "-J", tmp_path).count('"path"') == 3
    assert opens() == {"a": 2, "b": 2, "c": 2, "d": 1}
    write(tmp_path, **{"x.zip": zipped(("m", b"one"), ("n", b"four4"))})
    assert "x.zip:m" in run(spark, "-t", tmp_path)
    assert opens() == {"a": 1, "b": 1, "c": 1, "d": 1, "x.zip": 2}  # its directory, and the one member of a shared size


def zipped(*members):
    import zipfile

    stream = io.BytesIO()
    with zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(name, data)
    return stream.getvalue()


def test_no_content_is_shuffled_for_verification(spark, tmp_path):
    write(tmp_path, a=b"one" * 1000, b=b"one" * 1000)
    members, _ = search.duplicates(spark, Options.parse(["--verify", str(tmp_path)]))
    assert "content" not in members._jdf.queryExecution().toString() and members.count() == 2


@pytest.mark.parametrize("together, span", [(128, 1 << 30), (2, 700)])
def test_verified_sets_of_forced_collisions(spark, tmp_path, together, span):
    """Three contents, a lone one and a file that is gone share one digest; files are compared in spans and a few at a time."""
    from pyspark.sql import functions as F

    from dupspark.sources import entries

    same, late, third = b"x" * 2000, b"x" * 1999 + b"y", b"z" + b"x" * 1999
    for k in range(7):
        write(tmp_path, **{f"a{k}": same})
    write(tmp_path, b0=late, b1=late, c0=third, c1=third, d0=b"w" * 2000, other=b"x" * 2000, **{"z.zip": zipped(("m", late), ("n", same))})
    names = sorted(p.name for p in tmp_path.iterdir() if p.suffix != ".zip") + ["gone"]
    rows = [(str(tmp_path / n), None, None, 2000, "h") for n in names] + [(str(tmp_path / "z.zip"), "m", 0, 2000, "h"), (str(tmp_path / "z.zip"), "n", 1, 2000, "h"), (str(tmp_path / "a0"), None, None, 5, "lone")]
    df = spark.createDataFrame(rows, "path string, subpath string, nth int, size long, h string").withColumn("prioritized", F.lit(False))
    got = {}
    for r in entries.verified(df, together, span, 300).collect():
        got.setdefault(r.h, set()).add(os.path.basename(r.path) + (":" + r.subpath if r.subpath else ""))
    named = {h.split("/")[-1]: v for h, v in got.items()}
    assert {k: v for k, v in named.items() if len(v) > 1} == {"h": {f"a{k}" for k in range(7)} | {"other", "z.zip:n"}, "b0": {"b0", "b1", "z.zip:m"}, "c0": {"c0", "c1"}}


def test_members_of_large_archives(spark, tmp_path):
    """A zip's members are shared out, a tar's are hashed in pieces; broken, encrypted-like and unknown archives are error rows."""
    import gzip
    import hashlib

    from dupspark.sources import entries

    parts = [(f"m{k:03d}", bytes([k % 7]) * (1000 + k % 7)) for k in range(300)]
    write(tmp_path, **{"x.zip": zipped(*parts), "one.gz": gzip.compress(b"q" * 3_000_000), "bad.rar": b"Rar!", "cut.zip": zipped(*parts)[:-30]})
    with tarfile.open(tmp_path / "t.tar.gz", "w:gz") as t:
        for name, data in parts[:50]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    packed = spark.createDataFrame([(str(p),) for p in tmp_path.iterdir()], "path string")
    found = entries.members(packed).cache()
    pending = entries.spread(found.where("h is null and error is null").drop("h", "error"), 8)
    assert pending.rdd.getNumPartitions() == 8
    hashed = entries.with_hash(pending).unionByName(found.where("h is not null"))
    want = {("x.zip", n, hashlib.md5(d).hexdigest()) for n, d in parts} | {("t.tar.gz", n, hashlib.md5(d).hexdigest()) for n, d in parts[:50]} | {("one.gz", "one", hashlib.md5(b"q" * 3_000_000).hexdigest())}
    assert {(os.path.basename(r.path), r.subpath, r.h) for r in hashed.collect()} == want
    assert {os.path.basename(r.path) for r in found.where("error is not null").collect()} == {"bad.rar", "cut.zip"}
    with archives.open_file(str(tmp_path / "t.tar.gz")) as f, archives.member_stream(str(tmp_path / "t.tar.gz"), f, 7) as inside:
        assert inside.read() == parts[7][1]


def test_switches(tmp_path):
    o = Options.parse(["--dedupe-paths", "--strict-whitelist", "--strict-ignore", "--hash", "sha256", "x"])
    assert o.dedupe_paths and o.strict_whitelist and o.strict_ignore and o.hash_kind == "sha256" and not Options.parse(["x"]).strict_ignore
    with pytest.raises(ValueError):
        Options.parse(["--hash", "none", "x"])


def test_a_tree_below_one_folder_is_listed_by_many_tasks(spark, tmp_path):
    """All of it lies below one folder, one branch is deep and one folder wide; small shares make many rounds with the same rows."""
    top = tmp_path / "only" / "one"
    for k in range(12):
        write(top, **{f"d{k}__s{j}__f": 10 + j for j in range(6)})
    write(top, **{"deep__" + "__".join("abcdefghij"[: k + 1]) + "__leaf": 5 for k in range(10)}, **{f"wide__f{k:03d}": k for k in range(130)})
    (top / "d3" / ".gitignore").write_text("s1/\n!s2/\n")
    os.symlink(top, top / "deep" / "loop")
    options = {"ignore": True, "follow": True}
    want = sorted(map(tuple, files.tree(spark, [str(tmp_path)], **options).where("ftype = 'file'").select("path", "relpath", "size", "verdict").collect()))
    assert len(want) == 12 * 6 - 1 + 10 + 130 + 1 and sorted(map(tuple, files.scan(spark, [str(tmp_path)], **options).select("path", "relpath", "size", "verdict").collect())) == want
    walk = files.Walk(follow=True, ignore=True)
    found, n = files.rounds(spark, walk, [str(tmp_path)], first=10, most=20, wide=40)
    from pyspark.sql import functions as F

    assert sorted(map(tuple, found.where("ftype = 'file' and relpath not like '%.gitignore'").select("path", "relpath", "size", "verdict").collect())) == [w for w in want if "gitignore" not in w[1]]
    files_of = found.select(F.input_file_name().alias("f")).distinct().count()
    assert n >= 3 and files_of > 6


def test_filters_reach_the_lister(spark, tmp_path):
    write(tmp_path, **{f"d{k % 3}__f{k}.{'txt' if k % 2 else 'log'}": k for k in range(60)})
    rows = files.tree(spark, [str(tmp_path)])
    kept = rows.where("size >= 10 and size < 40 and ftype = 'file' and path like '%.txt'")
    assert sorted(r.size for r in kept.collect()) == [k for k in range(10, 40) if k % 2]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan and "BatchScan" in plan
    reader = files.FileTreeReader({"roots": json.dumps([str(tmp_path)])})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    left = list(reader.pushFilters([GreaterThan(("size",), 50), StringEndsWith(("relpath",), ".log"), EqualTo(("verdict",), "NONE")]))
    assert left == [EqualTo(("verdict",), "NONE")]
    assert sorted(r[3] for p in reader.partitions() for r in reader.read(p)) == [52, 54, 56, 58]
    assert sorted(r.size for r in files.scan(spark, [str(tmp_path)], sizes=(10, 12)).collect()) == [10, 11, 12]


def test_folders_that_may_not_be_entered_are_rows(spark, tmp_path):
    """Reading a folder's names needs one bit, entering it another: as owner, as member of its group, as anyone."""
    os.chmod(tmp_path, 0o755)
    for name, mode in (("read", 0o744), ("enter", 0o711), ("both", 0o755), ("group", 0o750), ("mine", 0o077)):
        write(tmp_path, **{f"{name}__f": 3, f"{name}__deep__g": 3})
        os.chmod(tmp_path / name, mode)
    os.chown(tmp_path / "group", 0, 4242)
    os.chown(tmp_path / "mine", 777, 4242)

    def seen(user, *groups):
        walk = files.Walk()
        walk.user, walk.groups = user, frozenset(groups)
        rows = files.rounds(spark, walk, [str(tmp_path)])[0].collect()
        return sorted(r.relpath for r in rows if r.ftype == "file"), sorted(r.relpath for r in rows if r.ftype == "unreadable")

    assert seen(777) == (["both/deep/g", "both/f"], ["enter", "group", "mine", "read"])
    assert seen(778, 4242) == (["both/deep/g", "both/f", "group/deep/g", "group/f", "mine/deep/g", "mine/f"], ["enter", "read"])
    assert len(seen(0)[0]) == 10
