"""Every operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import dataclasses
import gc
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupspark.llm import bpe, common, cover_tree, exact_dedup, language_id, mixing, quality, simhash, substring_dedup, token_counts, toxicity
from dupspark.llm.suffix_groups import lay_out, suffix_arrays

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def words(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def odd_texts():
    """Texts with every edge: null, empty, blank, long, non-ASCII, upper case, copies."""
    rnd = random.Random(2)
    long_one = words(rnd, 6000)
    return [None, "", "  \n\t", "A", "a", "Hello World 123", "hello world 123", "HELLO world 123 ", "Ünïcode ÉÉ été 日本語 😀", "it's we'll I'D x'sx '' 's", long_one, long_one, "ö " * 300, long_one[:3000] + " other " + long_one[3000:]]


def documents(spark, rows=None, extra=True):
    """Rows with ids out of order, one repeated row, one null id, and columns whose names clash with those that operators use."""
    if rows is None:
        rows = [((7 * i) % 100, t, "en", "s1") for i, t in enumerate(odd_texts())]
        rows += [rows[5], (None, "null id", None, None), (200, "ß", None, None)]
    df = spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], DOCS)
    return df.withColumns({"digest": F.lit("x"), "b": F.lit(1), "fp": F.lit(None), "block": F.lit(0)}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# exact dedup


def test_exact_groups(spark):
    docs = documents(spark)
    rows = [(r.doc_id, lower(r.text)) for r in docs.collect()]
    by = {}
    for i, t in rows:
        by.setdefault(t, []).append(i)
    want = []
    for t, ids in by.items():
        keep, one = max((i for i in ids if i is not None), default=None), False
        for i in ids:
            kept = i == keep and not one
            one |= kept
            want.append((i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.exact_groups(docs)
    assert collected(got, *got.columns) == sorted(want, key=repr)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and sorted(lower(r.text) for r in kept.collect()) == sorted(by)


def test_index_outlives_a_batch(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    first, second = (documents(spark, [(i, t, None, None) for i, t in rows]) for rows in ([(1, "a"), (2, "A"), (3, "b")], [(9, "B"), (10, "c"), (10, "c"), (11, "a")]))
    assert collected(exact_dedup.exact_groups(first, index), "doc_id", "group_size", "kept") == [(1, 2, False), (2, 2, True), (3, 1, True)]
    assert collected(exact_dedup.exact_groups(second, index), "doc_id", "keep_id", "group_size", "kept") == [(10, 10, 2, False), (10, 10, 2, True), (11, 2, 3, False), (9, 3, 2, False)]
    assert index.groups().count() == 3
    index.append(index.groups().selectExpr("digest", "keep_id", "keep_row", "group_size AS n").limit(0), "again")
    before = index.rows().count()
    index.append(exact_dedup.groups_of(spark.createDataFrame([(0, 77, b"x")], "row long, doc_id long, digest binary")), index.rows().first().batch)
    assert index.rows().count() == before  # a batch of that name is there


@pytest.mark.parametrize("named", [None, "nightly"])
def test_a_run_that_comes_again_gives_the_same_rows(spark, tmp_path, monkeypatch, named):
    """A job dies after the first of its batches, and in another while the second one's rows are being added; it is run again, and once more."""
    rows = [(1, "a", None, None), (2, "A", None, None), (3, "b", None, None), (4, "c", None, None), (5, "c", None, None), (None, "d", None, None), (5, "c", None, None)]
    want = collected(exact_dedup.exact_groups(documents(spark, rows)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    path = str(tmp_path / "index")
    whole, part = exact_dedup.DigestIndex.append, exact_dedup.DigestIndex.note
    calls = []

    def dies_before(self, groups, batch):
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("lost")
        whole(self, groups, batch)

    def dies_inside(self, kind, **values):
        if kind == "done":
            raise RuntimeError("lost")
        part(self, kind, **values)

    docs = documents(spark, rows)
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", dies_before)
    with pytest.raises(RuntimeError):
        exact_dedup.exact_groups(docs, exact_dedup.DigestIndex(spark, path, 4), run=named)
    monkeypatch.setattr(exact_dedup.DigestIndex, "append", whole)
    monkeypatch.setattr(exact_dedup.DigestIndex, "note", dies_inside)
    with pytest.raises(RuntimeError):
        exact_dedup.exact_groups(docs, exact_dedup.DigestIndex(spark, path, 4), run=named)
    monkeypatch.setattr(exact_dedup.DigestIndex, "note", part)
    for n in range(2):
        again = docs.repartition(3 + n)
        assert collected(exact_dedup.exact_groups(again, exact_dedup.DigestIndex(spark, path, 4), run=named), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
        kept = exact_dedup.drop_exact_copies(again, exact_dedup.DigestIndex(spark, path, 4), run=named)
        assert sorted(lower(r.text) for r in kept.collect()) == ["a", "b", "c", "d"]
    more = documents(spark, [(9, "B", None, None), (10, "e", None, None)])
    assert collected(exact_dedup.exact_groups(more, exact_dedup.DigestIndex(spark, path, 4)), "doc_id", "keep_id", "group_size", "kept") == [(10, 10, 1, True), (9, 3, 2, False)]


def test_index_outlives_the_session(tmp_path):
    """Two sessions one after the other, each in a process of its own with an in-memory catalog."""
    import os
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from pyspark.sql import SparkSession
from dupspark.llm import exact_dedup
top = sys.argv[2]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", top + "/shared").config("spark.sql.warehouse.dir", top + "/" + sys.argv[3]).getOrCreate()
index = exact_dedup.DigestIndex(spark, top + "/index", buckets=int(sys.argv[4]))
docs = spark.createDataFrame([(int(x.split(":")[0]), x.split(":")[1]) for x in sys.argv[5:]], "doc_id long, text string")
for r in exact_dedup.exact_groups(docs, index).orderBy("doc_id").collect():
    print("row", r.doc_id, r.keep_id, r.group_size, r.kept)
print("row", index.buckets, index.groups().count())
"""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

    def session(*words):
        run = subprocess.run([sys.executable, "-c", code, repo, str(tmp_path), *words], capture_output=True, text=True, timeout=300)
        assert run.returncode == 0, run.stderr[-3000:]
        return [x[4:] for x in run.stdout.splitlines() if x.startswith("row")]

    assert session("w1", "4", "1:a", "2:b", "3:c") == ["1 1 1 True", "2 2 1 True", "3 3 1 True", "4 3"]
    assert session("w2", "8", "7:A", "8:d") == ["7 1 2 False", "8 8 1 True", "4 4"]


def test_exact_dedup_is_native(spark, monkeypatch):
    plans = []
    keep = common.written
    monkeypatch.setattr(exact_dedup, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    for df in (exact_dedup.exact_groups(documents(spark)), exact_dedup.drop_exact_copies(documents(spark))):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any(re.search("Python|Pandas|Arrow", p) for p in plans)


@pytest.mark.parametrize("hot", [1, 256])
def test_large_groups_are_whole(spark, monkeypatch, hot):
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = [(k % 40, "same" if k % 3 else f"t{k}", None, None) for k in range(120)] + [(None, "same", None, None), (None, "lone", None, None)] * 2 + [((1 << 63) - 1, "top", None, None), (-(1 << 63), "top", None, None)]
    docs = documents(spark, rows)
    got = exact_dedup.exact_groups(docs, batches=3).collect()
    assert len(got) == len(rows) and {r.group_size for r in got if r.keep_id == 39 and r.doc_id is None} == {82} and sum(r.kept for r in got) == 43
    kept = exact_dedup.drop_exact_copies(docs, batches=3)
    assert kept.count() == 43 and kept.columns == docs.columns


# SimHash


def fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def chained(fps, radius=3):
    parent = list(range(len(fps)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(k) for k in range(len(fps))]


def test_near_groups(spark):
    rnd = random.Random(5)
    texts = [words(rnd, 400) for _ in range(12)]
    texts += [re.sub("beta", "other", t, count=1) for t in texts] + [t + " tail" for t in texts] + odd_texts()
    rows = [(1000 - i, t, None, None) for i, t in enumerate(texts)]
    fps = [fingerprint(t) for t in texts]
    roots = chained(fps)
    least = {r: min(i for (i, *_), q in zip(rows, roots, strict=True) if q == r) for r in roots}
    want = sorted(((i, f"{f:016x}", least[r]) for (i, *_), f, r in zip(rows, fps, roots, strict=True)), key=repr)
    assert len(set(roots)) < len(set(fps))
    docs = documents(spark, rows)
    assert collected(simhash.near_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.keep_one_of_near_copies(docs.unionByName(documents(spark, [(None, "free", None, None), rows[0]])))
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(least.values())) and kept.where("doc_id is null").count() == 1


@pytest.mark.parametrize("cell", [8, 2048])
def test_links_find_every_close_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.default_rng(1)
    fps = [0, 7, 0x8000000000000000]
    for base in rng.integers(0, 2**63, 25).tolist():
        fps += [base] + [base ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in (1, 2, 3, 4, 5, 3, 3)]
    fps += [0xFFFF ^ (1 << k) for k in range(64)]  # one large group: all within two bits
    fps = sorted(set(fps))
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = {r.node: r.component for r in common.components(simhash.links(spark.createDataFrame(signed, "fp long"))).collect()}
    roots = chained(fps)
    assert len({(found.get(s, s), r) for (s,), r in zip(signed, roots, strict=True)}) == len(set(roots)) == len({found.get(s, s) for (s,) in signed})


def test_keep_one_of_near_copies_with_repeated_ids(spark):
    rnd = random.Random(14)
    one, two, three = (words(rnd, 60) for _ in range(3))
    # id 1 has two texts of its own; one is also a near copy of the group that id 0 stands for
    rows = [(1, one, "en", "a"), (1, two, "en", "b"), (0, three, "en", "c"), (1, three, "en", "d"), (2, one, "en", "e"), (3, two, "en", "f")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_one_of_near_copies(documents(spark, order).repartition(3))
        assert collected(kept, "doc_id", "source") == [(0, "c"), (1, "a"), (1, "b")]


def test_close_pairs_of_other_radii():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    fps = np.array([b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in range(9) for _ in range(9)], np.uint64)
    for radius in (1, 2, 3, 5, 7):
        got = {(int(i), int(j)) for a, b in simhash.close_pairs(fps, np.zeros(len(fps), int), radius) for i, j in zip(a, b, strict=True)}
        assert got == {(i, j) for j in range(len(fps)) for i in range(j) if int(fps[i] ^ fps[j]).bit_count() <= radius}


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(500, 500 + k) for k in range(1, 60)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    assert got == {**{k: 0 for k in range(101)}, **{500 + k: 500 for k in range(60)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# repeated passages


def cut(rows, width=50):
    texts = {}
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - width + 1):
            w = b[k : k + width]
            first[w] = min(first.get(w, 1 << 70), 1 << 64 if i is None else i)
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if first[b[k : k + width]] < (1 << 64 if i is None else i):
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        texts[n] = (i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return sorted(texts.values(), key=repr)


@pytest.mark.parametrize("part", [2, 64])
def test_cut_repeats(spark, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART", part)
    monkeypatch.setattr(substring_dedup, "BLOCK", 4000)
    rnd = random.Random(9)
    passage, other = words(rnd, 12), words(rnd, 30)
    rows = [((17 * k) % 61, words(rnd, rnd.randint(1, 8)) + rnd.choice([passage, other, ""]) + str(rnd.random()) + rnd.choice([passage[:49], passage[3:], ""])) for k in range(60)]
    rows += [(100 + k, "ab" * k) for k in (24, 25, 26, 200)] + [(k, t) for k, t in enumerate(odd_texts(), 300)] + [(None, passage), (None, "only here " * 9), (5, passage + other), (5, passage)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    got = substring_dedup.cut_repeats(docs)
    assert collected(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows)
    assert substring_dedup.cut_repeats(empty(spark)).count() == 0
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("text_blocks")]  # and the rows are still there
    assert got.count() == docs.count() and "Bucketed: true" in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("part", [4, 128])
def test_cut_repeats_of_windows_that_a_document_repeats(spark, monkeypatch, part):
    monkeypatch.setattr(substring_dedup, "PART", part)
    rnd = random.Random(11)
    passage = words(rnd, 14)
    # over 2 * PART contexts of one anchor; the passage stands in two tiles of a document, the dashes repeat inside one
    rows = [(k, f"{rnd.random()} {passage} {rnd.random()} {passage} {rnd.random()}{'-' * 70}{rnd.random()}") for k in range(300)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).repartition(3)
    assert collected(substring_dedup.cut_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows)


def test_cut_repeats_of_null_and_repeated_ids_in_other_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 400)
    rnd = random.Random(12)
    passage, other = words(rnd, 14), words(rnd, 14)
    # rows of one id share whole tiles; a smaller document has their windows inside other tiles
    rows = [(3, f"{rnd.random()} {passage} {rnd.random()} {other} {rnd.random()}")]
    rows += [(None, f"{rnd.random()} left {passage} right {rnd.random()}") for _ in range(12)]
    rows += [(50, f"{rnd.random()} before {other} after {rnd.random()}") for _ in range(12)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows]).repartition(5)
    assert collected(substring_dedup.cut_repeats(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == cut(rows)


def test_suffix_arrays():
    rnd = random.Random(1)
    groups = [[bytes(rnd.choice(b"aab" if rnd.random() < 0.8 else b"abcd") for _ in range(rnd.randint(0, 14))) for _ in range(rnd.randint(1, 5))] for _ in range(400)]
    pieces = [p for g in groups for p in g]
    _, first, last, keys = lay_out(np.array([len(p) for p in pieces]), np.repeat(np.arange(len(groups)), [len(g) for g in groups]))
    keys[keys < 0] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1000
    order = suffix_arrays(keys, first, last)
    for a, b in zip(first, last, strict=True):
        k = keys[a : b + 1].tolist()
        assert (order[a : b + 1] - a).tolist() == sorted(range(len(k)), key=lambda i: k[i:])


# BPE and token counts


def tokenizer():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def token_digests(rows):
    coder = tokenizer()
    out = []
    for i, t in rows:
        ids = coder.encode_ordinary(t or "")
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most, block, page", [(0, 4 << 20, 1 << 20), (3, 300, 40), (1 << 19, 2000, 1 << 20)])
def test_bpe(spark, most, block, page, monkeypatch):
    for name, value in (("MOST", most), ("BLOCK", block), ("PAGE", page), ("LONG", 100)):
        monkeypatch.setattr(bpe, name, value)
    docs = documents(spark, [*[(i, t, None, None) for i, t in enumerate(odd_texts())], (90, "x" * 5000 + " " + "ab1" * 400, None, None), (91, "don't STOP thinatan\r\n\r\n  zukeitpf 　x", None, None)] * 2)
    docs = docs.withColumns({"_b": F.lit("own"), "_w": F.lit(1), "ids": F.lit("old"), "bytes": F.lit("old")})
    assert collected(bpe.digests(docs, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == token_digests([(r.doc_id, r.text) for r in docs.collect()])
    coder = tokenizer()
    back = bpe.decode(bpe.encode(docs, RANKS), RANKS)
    assert sorted(back.columns) == sorted(docs.columns)
    assert all(bytes(r.bytes) == (r.text or "").encode() and r.ids == coder.encode_ordinary(r.text or "") and (r._b, r._w) == ("own", 1) for r in back.collect())
    assert bpe.digests(empty(spark), RANKS).count() == 0 and bpe.encode(empty(spark), RANKS).count() == 0


def test_a_fold_copies_nothing_and_equals_the_heap(spark):
    """A transform over one element copies what it binds, and hex digits cost as much as a merge."""
    fold = bpe.RankMap.of(RANKS).fold("_words")
    assert not any(f"{f}(" in str(fold)[: 1 << 24] for f in ("element_at", "hex", "instr"))
    words = [bytes([b]) for b in range(256)] + [bytes(range(k, 256, 7)) for k in range(7)] + ["ééé öäü 日本語".encode(), b"a" * 255, b" unbelievably", b"\r\n\r\n  "]
    rows = spark.createDataFrame([(words[k::3],) for k in range(3)] + [([],), (None,)], "_words array<binary>")
    got = rows.select("_words", fold.alias("ids")).collect()
    assert sum(len(r.ids or []) for r in got) == len(words) and got[-1].ids is None
    assert all(r.ids == [bpe.merged(bytes(w), RANKS) for w in r._words] for r in got[:-1])


def test_a_fold_holds_a_word_in_one_array_and_takes_the_leftmost_of_equal_ranks(spark):
    """A merge cuts and joins one array; ranks that no training would give, ties and splits of one token by the dozen, merge as the heap does."""
    assert str(bpe.RankMap.of(RANKS).fold("_words")).count("slice(") == 3
    rnd = random.Random(5)
    for letters in ("a", "ab", "abc"):
        longer = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 5))).encode() for _ in range(40)})
        tokens = [bytes([b]) for b in range(256)] + rnd.sample(longer, len(longer))
        ranks = dict(zip(tokens, rnd.sample(range(900), len(tokens)), strict=True))
        words = [w for n in range(1, 40) for _ in range(6) if (w := "".join(rnd.choice(letters) for _ in range(n)).encode()) not in ranks]
        got = spark.createDataFrame([(words,)], "_words array<binary>").select(bpe.RankMap.of(ranks).fold("_words").alias("ids")).first().ids
        assert got == [bpe.merged(w, ranks) for w in words]


def test_bpe_of_very_long_texts_and_bytes_that_are_no_text(spark):
    rnd = random.Random(8)
    one = " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 5))) for _ in range(2_500_000))
    assert len(one.encode()) > 10 << 20
    rows = [(1, one), (2, "z" * 300_000), (3, "é" * 200_000 + " " * 200_000)]
    assert collected(bpe.digests(documents(spark, [(i, t, None, None) for i, t in rows]), RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == token_digests(rows)
    raw = [(1, b"ok \xff\xfe bad"), (2, b"cut \xc3"), (3, b"\xa9 begins"), (4, "fine é".encode())]
    odd = spark.createDataFrame(raw, "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    want = token_digests([(i, b.decode("utf-8", "replace")) for i, b in raw])
    assert collected(bpe.digests(odd, RANKS), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_a_driver_whose_heap_is_over_half_collects_when_it_writes(spark, monkeypatch):
    class Heap:
        def __init__(self, now):
            self.totalMemory, self.maxMemory = lambda: now, lambda: 750

    freed = []
    monkeypatch.setattr(common, "trimmed", freed.append)
    for now, times in ((375, 0), (376, 1), (750, 2)):
        monkeypatch.setattr(common, "driver_heap", lambda _, now=now: Heap(now))
        assert common.written(spark.range(3)).count() == 3 and freed == [spark] * times


def test_a_driver_that_collects_gives_its_memory_back(spark):
    heap, ratios = common.driver_heap(spark), lambda: [common.asked(spark, "HotSpotDiagnostic", "getVMOption", f).get("value") for f in common.FREE]
    before, held = ratios(), spark._jvm.java.util.ArrayList()
    for _ in range(200):
        held.add(spark._jvm.java.nio.ByteBuffer.allocate(1 << 18))
    spark._jvm.System.gc()
    taken = heap.totalMemory()
    held.retainAll(spark._jvm.java.util.ArrayList())
    gc.collect()
    common.trimmed(spark)
    assert heap.freeMemory() < 0.4 * heap.totalMemory() < 0.4 * taken and ratios() == before
    assert "Trim" in common.native_trimmed(spark) and common.asked(spark, "DiagnosticCommand", "noSuchOperation") is None


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(bpe, "span_hashes", lambda data, starts, stops: np.zeros(len(starts), np.uint64))
    text = b"one two six one two ab"
    starts, stops = np.array([0, 4, 8, 12, 16, 20]), np.array([3, 7, 11, 15, 19, 22])
    sample, at, _ = bpe.numbered(np.frombuffer(text, np.uint8), starts, stops)
    assert [text[starts[sample][k] : stops[sample][k]] for k in at] == [text[a:b] for a, b in zip(starts, stops, strict=True)] and len(sample) == 4


def test_rank_map_holds_every_pair():
    table, seen = bpe.RankMap.of(RANKS), 0
    for token, joint in list(RANKS.items())[::7]:
        for k in range(1, len(token)):
            if token[:k] in RANKS and token[k:] in RANKS:
                a, b = RANKS[token[:k]], RANKS[token[k:]]
                assert table.owner[table.shift[a] + b] == a and table.joint[table.shift[a] + b] == joint
                seen += 1
    assert seen > 1000


def test_split_and_merge_without_spark():
    import regex

    rnd = random.Random(3)
    texts = ["".join(rnd.choice("''''sstremvld  \n\t aéZ9½!?.日😀 ") for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    data = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join(data), np.uint8)
    starts, stops = bpe.split_words(buffer, np.concatenate([[0], np.cumsum([len(d) for d in data])]), bpe.char_classes())
    found = [m for t in texts for m in regex.findall(public_tokenizers.PATTERN, t)]
    assert [buffer[a:b].tobytes() for a, b in zip(starts, stops, strict=True)] == [m.encode() for m in found]
    coder = tokenizer()
    for m in found[:2000]:
        assert bpe.merged(m.encode(), RANKS) == coder.encode_ordinary(m)


@pytest.mark.parametrize("block", [6, 64, 1 << 20])
def test_token_counts(spark, tmp_path, block):
    rnd = np.random.default_rng(3)
    want = []
    for f in range(3):
        ids = rnd.integers(0, 4, 200 * f).astype("<u2")
        (tmp_path / f"f{f}.bin").write_bytes(ids.tobytes())
        ends = [*np.flatnonzero(ids == 3).tolist()]
        starts = [0, *(e + 1 for e in ends)]
        ends += [len(ids)] if starts[-1] < len(ids) else []
        want += [(f"f{f}.bin", n, s, e - s) for n, (s, e) in enumerate(zip(starts, ends, strict=False))]
    got = token_counts.token_counts(spark, str(tmp_path), 3, 2, block)
    assert collected(got, "file", "nth", "first", "n_tokens") == sorted(want, key=repr)


@pytest.mark.parametrize("separator, width", [(5, 2), (65536, 2), (50256, 1)])
def test_separators_that_cannot_be_told_are_refused(spark, tmp_path, separator, width):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with pytest.raises(ValueError, match="separator"):
        token_counts.write_tokens(documents(spark), str(tmp_path), path, public_tokenizers.PATTERN, separator, width)


def test_token_files_of_an_earlier_attempt_are_replaced(spark, tmp_path):
    path, docs = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), documents(spark).coalesce(1)
    first = [token_counts.write_tokens(docs, str(tmp_path), path, public_tokenizers.PATTERN, 50256).count() for _ in range(2)]
    assert first == [docs.count()] * 2 and [p.name for p in tmp_path.iterdir()] == ["part-000000.bin"]


def test_document_token_counts(spark):
    coder, path = tokenizer(), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark).repartition(3)
    got = token_counts.document_token_counts(docs, path, public_tokenizers.PATTERN)
    assert collected(got, "doc_id", "n_tokens") == sorted(((r.doc_id, len(coder.encode_ordinary(r.text or ""))) for r in docs.collect()), key=repr)
    assert token_counts.document_token_counts(empty(spark), path, public_tokenizers.PATTERN).count() == 0


# mixing


def fill(sizes):
    """Targets by resharing, round after round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, capped = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes.values()), set()
    while True:
        left, w = total - sum(2 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        goal = {s: 2 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        more = {s for s in names if s not in capped and goal[s] >= 2 * sizes[s]}
        if not more:
            return goal
        capped |= more
        if len(capped) == len(names):
            return {s: 2 * sizes[s] for s in names}


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "SHARD", 32)
    monkeypatch.setattr(mixing, "BIN", 20)
    rnd = random.Random(6)
    rows = [(k, words(rnd, rnd.randint(0, 120)), None, rnd.choice(["hot"] * 6 + ["b", "a", "Z", None])) for k in range(150)] + [(150, None, None, "none"), (300, "again twice", None, "a"), (300, "again twice", None, "a"), *[(300, words(rnd, 20 * k), None, "hot") for k in range(9)]]
    docs = documents(spark, rows)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    goal = fill(sizes)
    got = mixing.mixed(docs).collect()
    assert collected(mixing.mixed(docs.repartition(5).sortWithinPartitions("doc_id")), "doc_id", "size", "taken") == sorted(((r.doc_id, r.size, r.taken) for r in got), key=repr)
    taken, by_size = {}, {n: s for s, n in sizes.items()}
    assert len(by_size) == len(sizes)
    for r in got:
        s = by_size[r.source_size]
        assert r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 16 for s in goal)
    assert mixing.mixed(empty(spark)).count() == 0 and [r.taken for r in mixing.mixed(documents(spark, [(1, " ", None, None)])).collect()] == [0]
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in texts.collect()) == sum(taken.values())


@pytest.mark.parametrize("subtrees", [1, 4, 256])
def test_splitting_tree_is_a_partition(spark, monkeypatch, subtrees):
    monkeypatch.setattr(mixing, "SHARD", 192)
    monkeypatch.setattr(mixing, "SUBTREES", subtrees)
    counts = {0: 1000, 1: 10, 3: 333, 9: 1}
    rows = sorted(map(tuple, mixing.shard_ranges(spark, list(counts.items()), 3).select("nth", "shard", "start", "count").collect()))
    assert all(r[3] > 0 for r in rows) and {r[1] for r in rows} == set(range(7))
    for nth, n in counts.items():  # the shards' runs of a source follow one another and leave nothing out
        own = [r for r in rows if r[0] == nth]
        assert [r[2] for r in own] == np.cumsum([0, *(r[3] for r in own)])[:-1].tolist() and sum(r[3] for r in own) == n
    assert {sum(r[3] for r in rows if r[1] == k) for k in range(7)} == {192}
    assert rows == sorted(map(tuple, mixing.shard_ranges(spark, list(counts.items()), 3).select("nth", "shard", "start", "count").collect()))


def test_many_sources_are_split_by_the_executors(spark):
    quotas = [(k, 1 + k % 3) for k in range(mixing.SOURCES)]
    found = mixing.shard_ranges(spark, quotas, 3).groupBy("shard").agg(F.sum("count").alias("n")).collect()
    assert sum(r.n for r in found) == sum(n for _, n in quotas) and max(r.n for r in found) - min(r.n for r in found) <= 1


def test_draws_follow_the_law():
    rng = np.random.default_rng(1)
    big = np.array([mixing.hypergeometric(rng, 3_000_000_000, 1_000_000_000, 1_000_000) for _ in range(400)])
    assert abs(big.mean() - 750_000) < 5 * 433 / 20 and 0.85 < big.std() / 433 < 1.15
    few = np.array([mixing.hypergeometric(rng, 2_000_000_000, 2, 3_000_000_000 // 2) for _ in range(300)])
    assert set(few.tolist()) <= {1_499_999_998, 1_499_999_999, 1_500_000_000} and 0.5 < (1_500_000_000 - few).mean() / 1.5 < 1.5
    assert mixing.hypergeometric(rng, 0, 2_000_000_000, 5) == 0


def test_shards_are_shuffled_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 4)
    monkeypatch.setattr(mixing, "SHARD", 50)
    sizes = spark.createDataFrame([(i, i, "ab"[i % 2], 8, i) for i in range(300)], "row long, doc_id long, source string, size long, mark long")
    shards, _ = mixing.mix(sizes)
    rows = shards.collect()
    count = {k: sum(r.shard == k for r in rows) for k in {r.shard for r in rows}}
    assert len(rows) == len({(r.row, r.block, r.turn) for r in rows}) == 900 and sorted(count) == list(range(18)) and set(count.values()) == {50}
    for k in count:
        keys = [(r.key, r.nth) for r in rows if r.shard == k]
        assert keys == sorted(keys) and {n for _, n in keys} == {0, 1} and [n for _, n in keys] != sorted(n for _, n in keys)


@pytest.mark.parametrize("sources", [2, 700])
def test_draws_are_never_broadcast(spark, monkeypatch, sources):
    """Neither the draws, which Spark takes for few, nor the runs that they come from, where there are more sources than nodes."""
    plans, keep = [], mixing.written

    def written(df):
        if "turn" in df.columns:
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return keep(df)

    monkeypatch.setattr(mixing, "written", written)
    monkeypatch.setattr(mixing, "SHARD", 50)
    sizes = spark.createDataFrame([(i, i, f"s{i % sources}", 8, i) for i in range(1400)], "row long, doc_id long, source string, size long, mark long")
    shards, _ = mixing.mix(sizes)
    (plan,) = plans
    assert abs(shards.count() - 2100) <= sources and "isFinalPlan=true" in plan
    assert "SortMergeJoin" in plan and plan.count(" BroadcastHashJoin") == 1 and "BuildRight" in plan and "BuildLeft" not in plan


# top-k


def brute(rows, k=5, every=50):
    clean = [(i, [np.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in sorted(clean, key=lambda r: (r[0], r[1])):
        if q % every or q in {o[0] for o in out}:
            continue
        scored = sorted((-int(np.dot(a, b)), i) for i, b in clean if i != q and len(b) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, queries", [(8192, 2048), (40, 3)])
def test_top_k(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(cover_tree, "SHARD", shard)
    monkeypatch.setattr(cover_tree, "QUERIES", queries)
    rng = np.random.default_rng(8)
    hubs = rng.normal(0, 1, (5, 8))
    rows = [(i, (hubs[i % 5] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist()) for i in range(401)]
    rows += [(i, rows[50][1]) for i in range(401, 500)] + [(500, None), (501, [None] * 8), (550, [float("nan")] * 8), (600, [1.0, 2.0]), (None, rows[0][1]), (650, [0.0] * 8), (7, rows[3][1])]
    got = cover_tree.neighbours(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int"))
    assert collected(got, "query_id", "rank", "vec_id", "score") == brute(rows)
    assert cover_tree.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_top_k_of_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "SHARD", 64)
    monkeypatch.setattr(cover_tree, "QUERIES", 16)
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in [*range(120), *[50] * 60, 100, 100, 7]] + [(100, [2.0] * 8)] * 2
    whole = [(i, np.floor(np.array(v, np.float32).astype(np.float64) * 256)) for i, v in rows]
    want = []
    for q in (0, 50, 100):
        pairs = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(pairs[:5])]
    got = cover_tree.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    assert collected(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)


def test_clustered_vectors_are_hardly_scored():
    """Queries of one cluster meet little beside it; repeated vectors, ties and a query's own id among them."""
    rng = np.random.default_rng(0)
    centers = rng.normal(size=(60, 64))
    x = centers[rng.integers(60, size=4000)] + 0.1 * rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    x[100:140] = x[3]
    ids = rng.permutation(4000)
    found = cover_tree.dual_search(x[:200], ids[:200], x, ids, 5)
    scores = x[:200] @ x.T
    for i in range(200):
        want = sorted((-s, j) for s, j in zip(scores[i], ids, strict=True) if j != ids[i])[:5]
        assert [(-s, j) for s, j in zip(found.score[i], found.id[i], strict=True)] == want
    assert found.scored < 0.05 * 200 * 4000


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(0, 1, (3000, 3)) * np.array([100, 10, 1])
    root, order = cover_tree.cover_tree(x)
    assert sorted(order.tolist()) == list(range(3000)) and root.children
    todo = [root]
    while todo:
        node = todo.pop()
        assert np.sqrt(((x[order[node.lo : node.hi]] - node.center) ** 2).sum(axis=1)).max() <= node.radius
        assert not node.children or [(c.lo, c.hi) for c in sorted(node.children, key=lambda c: c.lo)][0][0] == node.lo
        todo += node.children


# classifiers


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


SYLLABLES = {"en": "th er on an re he in ed".split(), "fr": "é eau ou ç ai è".split(), "de": "sch ung ü ei ß ich".split()}


def prose(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 4))) for _ in range(n))


def test_language(spark):
    rnd = random.Random(4)
    rows = [(i, prose(rnd, lang, rnd.randint(3, 200)), lang, None) for i in range(240) for lang in [rnd.choice(list(SYLLABLES))]]
    odd = [(900, None, "en", None), (901, "12 34 !", "en", None), (902, "", "fr", None), (None, rows[0][1], None, None)]
    got = {r.doc_id: r for r in language_id.language_of(documents(spark, rows + odd)).collect()}
    held = [i for i, *_ in rows if fold(i, 4) == 2]
    assert len(held) > 30 and all(got[i].held_out == (fold(i, 4) == 2) for i, *_ in rows)
    assert sum(got[i].lang_pred == lang for i, _, lang, _ in rows if i in held) >= 0.95 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902)) and got[None].held_out is None
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.keep_known_language(documents(spark, rows + odd))
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in rows} | {None} and "digest" in kept.columns
    assert language_id.language_of(empty(spark)).count() == 0


@pytest.fixture(scope="module")
def marked():
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(700):
        lang = rnd.choice(list(SYLLABLES))
        text, bad, toxic = prose(rnd, lang, rnd.randint(5, 150)), rnd.random() < 0.3, rnd.random() < 0.3
        if bad:
            text = text.replace(" ", " $$% ") if rnd.random() < 0.5 else " ".join([rnd.choice(text.split())] * 40)
        if toxic:
            w = text.split()
            for _ in range(2 + len(w) // 20):
                w.insert(rnd.randrange(len(w)), rnd.choice(["idiotix", "moronax", "Scumble"]) + rnd.choice(["", "th", "er", ","]))
            text = " ".join(w)
        rows.append((i, text, lang, None))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(900, None, None, None), (901, "", None, None), (None, "x", None, None), rows[0]]
    return rows + odd, labels + [(5, None, None), (None, 1, 1), (99999, 1, 1)]


def accuracy(got, truth, held):
    return np.mean([got[i].predicted == truth[i] for i in held])


def test_quality(spark, marked):
    rows, labels = marked
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = quality.quality_of(documents(spark, rows), marks)
    assert frame.count() == len(rows)
    got, truth = {r.doc_id: r for r in frame.collect()}, {i: q for i, q, _ in labels if q is not None}
    held = [i for i in truth if i is not None and i < 700 and fold(i, 5) == 0]
    assert len(held) > 100 and accuracy(got, truth, held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and got[900].score == got[901].score
    assert quality.quality_of(empty(spark), marks).count() == 0
    assert quality.quality_of(documents(spark), marks.limit(0)).count() == documents(spark).count()


def test_toxicity(spark, marked):
    rows, labels = marked
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, truth = {r.doc_id: r for r in toxicity.toxicity_of(documents(spark, rows), marks).collect()}, {i: t for i, _, t in labels if t is not None}
    held = [i for i in truth if i is not None and i < 700 and fold(i, 5) == 0]
    assert accuracy(got, truth, held) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values()) and got[900].score == got[901].score < 0.5
    assert toxicity.toxicity_of(documents(spark), marks.limit(0)).count() == documents(spark).count()
    assert toxicity.toxicity_of(empty(spark), marks).count() == 0


def test_network_gradient():
    """The hand-written backward pass against finite differences."""
    rng = np.random.default_rng(3)
    p = {"word": np.zeros((1, toxicity.WORD)), "char": np.zeros((1, toxicity.CHAR)), "a": rng.normal(0, 0.5, (2 * toxicity.STATE, toxicity.ATT)), "v": rng.normal(0, 0.5, toxicity.ATT), "o": rng.normal(0, 0.5, 2 * toxicity.STATE), "b": np.zeros(1)}
    for d in "fb":
        p |= {"w" + d: rng.normal(0, 0.5, (toxicity.INPUT, 3 * toxicity.STATE)), "u" + d: rng.normal(0, 0.5, (toxicity.STATE, 3 * toxicity.STATE)), "b" + d: rng.normal(0, 0.5, 3 * toxicity.STATE)}
    net = toxicity.Network(p)
    x = np.concatenate([rng.normal(0, 1, (9, toxicity.INPUT)), np.zeros((1, toxicity.INPUT))])
    slots = rng.integers(0, 9, (toxicity.LENGTH, 3))
    slots[15:, 1] = 9
    weight = np.array([1.0, -2.0, 0.5])
    _, cache = net.forward(x, slots)
    grads, d_x = net.backward(x, slots, cache, weight)
    loss = lambda: float((net.forward(x, slots)[0] * weight).sum())
    for name, at in (("a", (3, 2)), ("v", (1,)), ("o", (5,)), ("wf", (2, 9)), ("ub", (4, 20)), ("uf", (1, 3)), ("bb", (7,))):
        base, p[name][at] = p[name][at], p[name][at] + 1e-2
        up = loss()
        p[name][at] = base - 1e-2
        down = loss()
        p[name][at] = base
        assert (up - down) / 2e-2 == pytest.approx(grads[name][at], rel=0.05, abs=2e-3), name
    base, x[4, 3] = x[4, 3], x[4, 3] + 1e-2
    up = loss()
    x[4, 3] = base - 1e-2
    assert (up - loss()) / 2e-2 == pytest.approx(d_x[4, 3], rel=0.05, abs=2e-3)


def test_language_training_goes_down_the_gradient():
    """The first step of training against finite differences of the loss: with one step of Adam the sign of each change is minus that of its derivative."""
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(list(letters), 60).astype(np.uint8)) for letters in (b"abcdef", b"uvwxyz") for _ in range(8)]
    labels = ["a"] * 8 + ["b"] * 8
    before, after = language_id.train(texts, labels, rounds=0), language_id.train(texts, labels, rounds=1)
    cells, first = language_id.padded_windows(np.frombuffer(b"".join(texts), np.uint8), np.arange(0, 60 * 17, 60))

    def loss(net):
        got = net.log_probabilities(cells)[first[:-1]].astype(np.float64)
        return -float(got[np.arange(16), [net.labels.index(x) for x in labels]].mean())

    assert loss(after) < loss(before)
    agree = checked = 0
    for name, at in [("weights", (k, c)) for k in range(0, 24, 3) for c in range(2)] + [("offset", (0,)), ("bias", (1, 2))]:
        now = getattr(before, name)
        up, down = now.copy(), now.copy()
        up[at], down[at] = now[at] + 1e-2, now[at] - 1e-2
        slope = (loss(dataclasses.replace(before, **{name: up})) - loss(dataclasses.replace(before, **{name: down}))) / 2e-2
        if abs(slope) > 1e-2:
            checked += 1
            agree += np.sign(getattr(after, name)[at] - now[at]) == -np.sign(slope)
    assert checked >= 6 and agree >= 0.8 * checked


def test_quality_step_is_the_gradient():
    """One text, one step: vectors, weights and bias move against the derivative of its loss."""
    text, rate = b"good words here", 1e-3
    before, after = quality.train([text, b"x"], [1, 0], epochs=0), None
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    buckets, counts = np.unique(np.concatenate([b[b >= 0] for _, b in quality.features(data, offsets)]), return_counts=True)
    share = counts / counts.sum()

    def loss(vectors, out, bias):
        z = share @ vectors @ out + bias
        return float(np.log(np.exp(z - z[1]).sum()))

    assert float(before.scores(data, offsets)[0]) == pytest.approx(np.exp(-loss(before.vectors[buckets], before.out, before.bias)), abs=1e-6)
    after = quality.SubwordNet(before.vectors.copy(), before.out.copy(), before.bias.copy())
    quality.step(after, buckets, counts, 1, rate)
    old = before.vectors[buckets], before.out, before.bias
    new = after.vectors[buckets], after.out, after.bias
    for k, (scale, places) in enumerate(((rate, [(0, 0), (3, 5)]), (0.01 * rate, [(0, 0), (4, 1)]), (0.002 * rate, [(0,), (1,)]))):
        for at in places:
            shifted = [[x.copy() for x in old] for _ in range(2)]
            shifted[0][k][at] += 1e-4
            shifted[1][k][at] -= 1e-4
            slope = (loss(*shifted[0]) - loss(*shifted[1])) / 2e-4
            assert (new[k][at] - old[k][at]) / scale == pytest.approx(-slope, rel=1e-2, abs=1e-6), (k, at)


def test_language_net_against_plain_convolution():
    """Every filter slid over every window, byte by byte, with the largest sum kept."""
    rng = np.random.default_rng(5)
    n = len(language_id.WIDTHS) * language_id.FILTERS
    taps = [rng.normal(0, 1, (w, 256, language_id.FILTERS)).astype(np.float32) for w in language_id.WIDTHS]
    net = language_id.ByteNet(["a", "b", "c"], taps, rng.normal(0, 1, (len(taps), language_id.FILTERS)), rng.normal(0, 1, (n, 3)), rng.normal(0, 1, 3))
    texts = [b"", b"x", bytes(rng.integers(0, 256, 127, np.uint8)), bytes(rng.integers(0, 256, 128, np.uint8)), bytes(rng.integers(0, 256, 700, np.uint8))]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cells, first = language_id.padded_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    got = net.log_probabilities(cells)
    flat = [*cells.tolist(), *[0] * language_id.REACH]
    for w in range(len(cells) // language_id.WINDOW):
        hidden = []
        for k, table in enumerate(taps):
            for f in range(language_id.FILTERS):
                places = range(w * language_id.WINDOW, (w + 1) * language_id.WINDOW)
                best = max(sum(float(table[j][flat[i + j]][f]) for j in range(len(table))) for i in places)
                hidden.append(max(0.0, best + net.bias[k][f]))
        z = np.array(hidden) @ net.weights + net.offset
        assert got[w] == pytest.approx(z - np.log(np.exp(z).sum()), abs=1e-3)
    for k, t in enumerate(texts):  # a text's bytes, whole, from its own window on
        assert cells[first[k] * language_id.WINDOW :][: len(t)].tobytes() == t and (first[k + 1] - first[k]) * language_id.WINDOW >= len(t) + language_id.REACH


def test_quality_scores_against_plain_mean():
    """Each text alone: the mean of its features' vectors, then softmax, in plain Python."""
    rng = np.random.default_rng(6)
    net = quality.SubwordNet(rng.normal(0, 1, (quality.BUCKETS, quality.SIZE)), rng.normal(0, 1, (quality.SIZE, 2)), rng.normal(0, 1, 2))
    texts = [(t or "").encode() for t in odd_texts()] + [b"a b", b"ab", b"  ab cd ab  ", b"abc", b"abcd"]

    def word(b, base=common.BASE):
        h = sum((c + 1) * pow(base, k, 1 << 64) for k, c in enumerate(b)) % (1 << 64)
        h = (h ^ h >> 29) * common.MIX % (1 << 64)
        return h ^ h >> 32

    def score(b):
        hashes = [word(w) for w in re.findall(rb"[^\x20\x09-\x0D]+", b)]
        found = [h >> 47 for h in hashes]
        found += [0 if g == h else ((g * common.MIX + h) * common.BASE % (1 << 64)) >> 47 for g, h in zip(hashes, hashes[1:], strict=False)]
        for n in quality.GRAMS:
            found += [(int.from_bytes(b[i : i + n], "little") * (2654435761 + 2 * n) % (1 << 32)) >> 15 for i in range(len(b) - n + 1)]
        z = (np.mean([net.vectors[f] for f in found], axis=0) if found else np.zeros(quality.SIZE)) @ net.out + net.bias
        return float(1 / (1 + np.exp(z[0] - z[1])))

    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    assert net.scores(np.frombuffer(b"".join(texts), np.uint8), offsets) == pytest.approx([score(t) for t in texts], abs=1e-9)


def test_toxicity_scores_against_plain_network():
    """Every window of every text, word by word, through both directions and the attention, in plain Python loops."""
    rng = np.random.default_rng(8)
    state, step = toxicity.STATE, toxicity.STRIDE
    f = lambda *shape: rng.normal(0, 0.6, shape).astype(np.float32)
    p = {"word": f(1 << toxicity.BITS, toxicity.WORD), "char": f(1 << toxicity.BITS, toxicity.CHAR), "a": f(2 * state, toxicity.ATT), "v": f(toxicity.ATT), "o": f(2 * state), "b": f(1)}
    for d in "fb":
        p |= {"w" + d: f(toxicity.INPUT, 3 * state), "u" + d: f(state, 3 * state), "b" + d: f(3 * state)}
    net, rnd = toxicity.Network(p), random.Random(8)
    texts = ["", "12 !", "One", words(rnd, 23), words(rnd, 24), words(rnd, 25), words(rnd, 36), words(rnd, 37), words(rnd, 400) + " Été", "x" * 90]
    squash = lambda x: 1 / (1 + np.exp(-x))

    def vector(w):
        data = np.frombuffer(w, np.uint8)
        h = common.span_hashes(data, np.array([0]), np.array([len(w)]))[0]
        marked = b"<" + w
        found = [marked[i : i + 4].ljust(4, b"\0") for i in range(max(1, len(w) - 2))]
        char = sum(p["char"][(int.from_bytes(g, "little") * 2654435761 % (1 << 32)) >> (32 - toxicity.BITS)] for g in found) / np.sqrt(len(found))
        return np.concatenate([p["word"][int(h) >> (64 - toxicity.BITS)], char])

    def states(xs, d):
        h, out = np.zeros(state), []
        for x in xs:
            g = x @ p["w" + d] + p["b" + d]
            zr = squash(g[: 2 * state] + h @ p["u" + d][:, : 2 * state])
            c = np.tanh(g[2 * state :] + (zr[state:] * h) @ p["u" + d][:, 2 * state :])
            h = h + zr[:state] * (c - h)
            out.append(h)
        return out

    def score(text):
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        xs, best = [vector(w) for w in re.findall(rb"[a-z\x80-\xff]+", low)], -np.inf
        begins = [0] + [k for k in range(step, len(xs), step) if k + toxicity.LENGTH - step < len(xs)]
        for k in begins:
            part = xs[k : k + toxicity.LENGTH]
            h = [np.concatenate(x) for x in zip(states(part, "f"), states(part[::-1], "b")[::-1], strict=True)]
            s = np.array([np.tanh(x @ p["a"]) @ p["v"] for x in h])
            w = np.exp(s - s.max()) / np.exp(s - s.max()).sum() if h else s
            best = max(best, float(sum((a * x for a, x in zip(w, h, strict=True)), np.zeros(2 * state)) @ p["o"] + p["b"][0]))
        return squash(best)

    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    assert net.scores(np.frombuffer(b"".join(data), np.uint8), offsets) == pytest.approx([score(t) for t in texts], abs=1e-4)


def test_training_takes_whole_texts(spark):
    """The sample bounds rows and bytes, and cuts no text: what doesn't fit is passed over."""
    rows = [(i, "word " * (20000 if i % 7 == 0 else 10) + str(i), None, None) for i in range(60)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    whole, known = {t.encode() for _, t, *_ in rows}, [i for i in range(60) if fold(i, 5) != 0]
    texts, labels = quality.labelled(documents(spark, [*rows, rows[1]]), marks, "quality", 100)
    assert len(texts) == len(labels) == len(known) and set(texts) <= whole and max(map(len, texts)) > 100000
    few, _ = quality.labelled(documents(spark, rows), marks, "quality", 100, most_bytes=150000)
    assert set(few) <= whole and sum(map(len, few)) <= 150000 and len(few) > sum(i % 7 != 0 for i in known)
    assert len(quality.labelled(documents(spark, rows), marks, "quality", 5)[0]) == 10
    assert quality.labelled(documents(spark, rows), marks, "quality", 5, most_bytes=3) == ([], [])


# the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rnd = random.Random(21)
    rows = [(i, prose(rnd, lang, 300), lang, rnd.choice("ab")) for i in range(60) for lang in [rnd.choice(list(SYLLABLES))]]
    rows += [(100 + i, rows[i][1].upper() if rows[i][2] == "en" else rows[i][1], rows[i][2], "a") for i in range(10)] + [(200, "1234", "en", "a"), (201, None, None, None)]
    docs = documents(spark, rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    states = [docs]
    for _, stage in corpus_pipeline.STAGES:
        states.append(common.written(stage(spark, states[-1], str(tmp_path))))
    assert all(s.columns == docs.columns for s in states[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in states]
    assert ids[1] == ids[0] - {200, 201} and ids[2] == ids[1] - set(range(10))
    fps = {r.doc_id: fingerprint(r.text) for r in states[2].collect()}
    order = sorted(fps)
    roots = chained([fps[i] for i in order])
    assert ids[3] == {min(i for i, q in zip(order, roots, strict=True) if q == r) for r in roots}
    sizes = {}
    for r in states[3].collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = {}
    for r in states[4].collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert all(abs(taken[s] - t) <= mixing.BLOCK for s, t in fill(sizes).items())
    coder = tokenizer()
    assert collected(states[5], "doc_id", "n_tokens") == sorted(((r.doc_id, len(coder.encode_ordinary(r.text))) for r in states[4].collect()), key=repr)
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == states[5].columns
