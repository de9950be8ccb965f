"""Vector codes, ranked search and web archives against brute force, and their edge cases."""

from __future__ import annotations

import base64
import collections
import gzip
import hashlib
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dupspark.llm import lexical, vector_codes, web_archive

# vector codes


def lloyd(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, codebooks) of rows (vec_id, label, vector) by plain loops over all entries."""
    kept = [(i, label, [math.floor(1024 * x) for x in v]) for i, label, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = np.array([v for _, _, v in kept], np.int64)
    w = x.shape[1] // parts
    books = [x[:entries, k * w : (k + 1) * w].copy() for k in range(parts)]

    def nearest(k):
        return ((x[:, None, k * w : (k + 1) * w] - books[k][None]) ** 2).sum(axis=2)

    for _ in range(rounds):
        for k in range(parts):
            own = nearest(k).argmin(axis=1)
            for e in range(len(books[k])):
                if (own == e).any():
                    part = x[own == e, k * w : (k + 1) * w]
                    books[k][e] = [int(s) // len(part) for s in part.sum(axis=0)]
    codes, error = [""] * len(x), np.zeros(len(x), np.int64)
    for k in range(parts):
        away = nearest(k)
        codes = [c + f"{e:02x}" for c, e in zip(codes, away.argmin(axis=1), strict=True)]
        error += away.min(axis=1)
    labels = collections.Counter()
    for (_, label, _), e in zip(kept, error.tolist(), strict=True):
        labels[label] += e
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((i, c, e, labels[label], digest) for (i, label, _), c, e in zip(kept, codes, error.tolist(), strict=True)), key=repr)


def vectors(n, seed, dim=8, clusters=12, spread=0.02):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(clusters, dim))
    x = centers[rnd.integers(clusters, size=n)] + spread * rnd.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32).tolist()


SCHEMA = "vec_id long, label int, embedding array<float>, n int, points string"


@pytest.mark.parametrize("n", [1, 40, 900])
def test_codes_equal_plain_rounds(spark, monkeypatch, n):
    monkeypatch.setattr(vector_codes, "BLOCK", 256)
    rnd = random.Random(n)
    rows = [(rnd.randrange(10**6), rnd.choice([1, 2, None]), v) for v in vectors(n, n)]
    rows += rows[:3]  # repeated rows
    if n > 1:
        rows += [(None, 1, rows[0][2]), (5, None, None), (6, 1, [None] * 8), (7, 1, [float("nan")] * 8), (8, 2, [float("inf")] * 8), (-4, 2, rows[2][2])]
    df = spark.createDataFrame([(i, label, v, 0, "x") for i, label, v in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in vector_codes.compressed(df).collect()), key=repr)
    assert got == lloyd(rows)


def test_codes_of_other_lengths_empty_vectors_and_tables(spark):
    make = lambda rows: spark.createDataFrame([(i, 1, v, 0, "x") for i, v in rows], SCHEMA)
    assert vector_codes.compressed(make([])).collect() == []
    assert vector_codes.compressed(make([(1, None)])).collect() == []
    assert [(r.vec_id, r.code, r.error) for r in vector_codes.compressed(make([(1, []), (2, []), (3, [0.5] * 8)])).orderBy("vec_id").collect()] == [(1, "00000000", 0), (2, "00000000", 0)]
    with pytest.raises(ValueError):
        vector_codes.compressed(make([(1, [0.1] * 6)]))


def test_nearest_in_both_trees_is_exact_and_prunes_clusters():
    rnd = np.random.default_rng(3)
    centers = rnd.integers(-1000, 1000, size=(40, 16))
    points = centers[rnd.integers(40, size=5000)] + rnd.integers(-20, 20, size=(5000, 16))
    book = vector_codes.Codebook(np.concatenate([points[:200], points[:56]]))  # repeated entries: the lower index wins
    shape = vector_codes.Shape.of(len(points), vector_codes.LEAF)
    order = vector_codes.tree_order(points, shape)
    tree = vector_codes.Tree.of(points[order], shape)
    found = vector_codes.nearest(tree, book)
    own = ((tree.points[:, None] - book.entries[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (vector_codes.assigned(tree, found) == own).all()
    assert found.compared < 0.1 * len(points) * 256


def test_whole_nodes_use_cached_sums():
    rnd = np.random.default_rng(4)
    points = np.concatenate([rnd.integers(-5, 5, size=(400, 4)) + 1000 * k for k in range(4)])
    shape = vector_codes.Shape.of(len(points), vector_codes.LEAF)
    tree = vector_codes.Tree.of(points[vector_codes.tree_order(points, shape)], shape)
    found = vector_codes.nearest(tree, vector_codes.Codebook(np.array([[1000 * k] * 4 for k in range(4)])))
    assert found.compared == 0 and sorted(found.node_entries) == [0, 1, 2, 3]
    assert (tree.sums[found.nodes[np.argsort(found.node_entries)]] == points.reshape(4, 400, 4).sum(axis=1)).all()


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def own_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items, k=50):
    counts = [(i, collections.Counter(own_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = collections.Counter(t for _, c, _ in counts for t in c)
    merged = collections.defaultdict(set)
    for item, text in items:
        merged[item] |= set(own_terms(text))
    out = []
    for item, terms in merged.items():
        scores = []
        for i, c, n in counts:
            m = 50 + (50 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def texts(n, seed, vocabulary=300):
    rnd = random.Random(seed)
    words = [f"w{int(rnd.paretovariate(0.6)) % vocabulary}" for _ in range(4000)] + ["Ünï", "日本", "ÉÉ", "x1", "X1"]
    return [rnd.choice([" ", "-", "\n"]).join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 30, 200]))) for _ in range(n)]


@pytest.mark.parametrize("most", [1 << 18, 60])
def test_search_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "SHARD_ROWS", 300)
    monkeypatch.setattr(lexical, "WINDOWS", (16, 64))
    rnd = random.Random(7)
    some = texts(900, 1)
    docs = [(rnd.randrange(5000), t) for t in some] + [(9000 + k, some[3]) for k in range(120)] + [(None, some[3]), (None, None), (1, None), (2, ""), (3, "..."), (77, some[3]), (77, some[3])]
    items = [(k, t) for k, t in enumerate(texts(25, 2)) if t] + [(500, some[3]), (501, None), (502, ""), (503, "nowhere"), (None, some[5]), (500, some[8])]
    frame = spark.createDataFrame([(i, t, "term") for i, t in docs], "doc_id long, text string, term string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.ranked(frame, asked, most=most).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    assert got == ranked(docs, items)


def test_search_without_documents_or_items(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).collect() == [] == lexical.ranked(docs, items.limit(0)).collect()


def test_search_reads_a_long_text_in_pieces(monkeypatch):
    data = np.frombuffer(b"ab cd " * 5000 + b"x" * 9000 + b" ab", np.uint8)
    pieces = list(lexical.slices(data, np.array([0, len(data)]), 1000))
    assert len(pieces) > 10 and b"".join(p.tobytes() for p, _ in pieces) == data.tobytes()
    assert own_terms(" ".join(p.tobytes().decode() for p, _ in pieces)) == own_terms(data.tobytes().decode())


def test_varints():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40, 5])
    data, ends = lexical.varints(x)
    assert (lexical.numbers(data) == x).all() and ends[-1] == len(data)


def test_search_leaves_most_blocks_unread():
    """A few documents hold the rare term; the common ones' lists are opened for those alone."""
    docs = [(k, "common often " * (1 + k % 3) + ("rare" if k % 400 == 0 else "")) for k in range(40_000)]
    words = [b"common", b"often", b"rare"]
    vocabulary, shard = lexical.Vocabulary(words), lexical.Shard(0)
    data = [t.encode() for _, t in docs]
    shard.add([i for i, _ in docs], np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), vocabulary)
    rows = shard.rows(words).to_pylist()
    searcher = lexical.Searcher(np.frombuffer(rows[0]["ends"], "<i8"), np.arange(len(docs)), rows[0]["df"], rows[0]["total"])
    for r in rows[1:]:
        searcher.add(r["term"], r["lasts"], r["ends"], r["tops"], r["top_ends"], r["data"], r["df"])
    searcher.top([(b"common", 10), (b"often", 10), (b"rare", 4000)], 50)
    assert searcher.blocks_read < 0.5 * searcher.blocks_there


# web archives


def archive_rows(spark, pages, **more):
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in pages], "page_id long, url string, html string, digest string, path int").repartition(3)
    return sorted((tuple(r) for r in web_archive.archived(df, **more).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def archive_truth(pages, least=0):
    def payload(h):
        return (h or "").encode()

    keep = {}
    for i, _, h in pages:
        old = keep.setdefault(payload(h), i)
        if i is not None and (old is None or i > old):
            keep[payload(h)] = i
    out, done = [], set()
    for i, _, h in pages:
        p = payload(h)
        first = keep[p] == i and p not in done
        done |= {p} if first else set()
        stays = first or len(p) < least
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if stays else "revisit", None if stays else keep[p]))
    return sorted(out, key=repr)


PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, None), (3, "http://b/ü", ""), (4, "http://c/\n", "<p>é</p>"), (9, "u", "A\r\n\r\nB\r\n\r\n"), (5, "u", "WARC/1.1\r\n\r\nhttp://x 0 1 2 3\n"), (None, "n", "<p>é</p>"), (6, "u", "x" * 300_000), (7, "u", "<p>é</p>"), (7, "u", "<p>é</p>"), (None, "u", "only null"), (8, "", "x" * 300_000)]


@pytest.mark.parametrize("least", [0, 9])
def test_archives_give_back_every_page(spark, least):
    assert archive_rows(spark, PAGES, least=least) == archive_truth(PAGES, least)


def test_archives_of_many_copies_and_small_files(spark, monkeypatch):
    monkeypatch.setattr(web_archive, "FILE_RECORDS", 40)
    pages = [(k, f"http://s/{k}", "hot" if k % 3 else f"page {k}") for k in range(1500)]
    assert archive_rows(spark, pages) == archive_truth(pages)


def test_archives_of_an_empty_table(spark):
    assert archive_rows(spark, []) == []


def arc_stream(version, records, name="old.arc"):
    date = "20010203040506"
    return io.BufferedReader(io.BytesIO(web_archive.arc_head(name, version, date) + b"".join(web_archive.arc_record(version, name, 0, *r) for r in records)))


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [("http://a/", "20010203040506", b"HTTP/1.0 200 OK\n\nbody\n\nhttp://b/ 1 2 3 4\n"), ("dns:a", "200102", b"20010203 a 1.2.3.4\n"), ("http://old blank/", "x", b"")]
    found = list(web_archive.arc_records(arc_stream(version, records)))
    assert [(a.nth, a.fields["url"], a.content) for a in found] == [(k, u, c) for k, (u, _, c) in enumerate(records)]
    assert [a.date for a in found] == ["2001-02-03T04:05:06Z", "2001-02-01T00:00:00Z", "1970-01-01T00:00:00Z"]
    assert (found[0].fields.get("status"), found[0].fields["mime"]) == (("200", "text/html") if version == 2 else (None, "text/html"))
    header, block = next(web_archive.warc_records(io.BufferedReader(io.BytesIO(web_archive.converted(found[0], None)))))
    assert (header["warc-type"], header["warc-date"], block) == ("response", found[0].date, records[0][2])
    assert header["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"body\n\nhttp://b/ 1 2 3 4\n").digest()).decode()
    assert next(web_archive.warc_records(io.BufferedReader(io.BytesIO(web_archive.converted(found[1], None)))))[0]["warc-type"] == "resource"


def test_arc_that_breaks_off_or_is_none(spark, tmp_path):
    whole = web_archive.arc_head("a.arc", 1, "20010203040506") + b"".join(web_archive.arc_record(1, "a.arc", 0, f"http://{k}/", "20010203040506", web_archive.http_response(k, b"abc")) for k in range(3))
    for name, data in (("cut.arc", whole[:-40]), ("none.arc", b"hello\n"), ("new.arc", whole.replace(b"1 0 dupspark", b"9 0 dupspark")), ("good.arc.gz", gzip.compress(whole))):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("cut.arc", "none.arc", "new.arc", "good.arc.gz")], "path string")
    scanned = web_archive.scan_arcs(files)
    assert {r.path.rsplit("/", 1)[-1]: (r.good, r.bad) for r in scanned.groupBy("path").agg(F.count("record_id").alias("good"), F.count("error").alias("bad")).collect()} == {"cut.arc": (2, 1), "none.arc": (0, 1), "new.arc": (0, 1), "good.arc.gz": (3, 0)}
    records = web_archive.read_warcs(web_archive.convert(scanned, str(tmp_path / "warc"))).where("error is null")
    assert sorted((r.record_type, r.page_id) for r in records.collect()) == [("response", 2), ("revisit", 0), ("revisit", 0), ("revisit", 1), ("revisit", 1)]


def test_warc_whose_payload_changed(spark, tmp_path):
    arc = next(web_archive.arc_records(arc_stream(1, [("http://a/", "20010203040506", web_archive.http_response(1, b"good"))])))
    record = web_archive.converted(arc, None)
    (tmp_path / "a.warc").write_bytes(record.replace(b"good", b"evil"))
    (tmp_path / "b.warc").write_bytes(record[:-10])
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.warc", "b.warc")], "path string")
    assert sorted(bool(r.error) for r in web_archive.read_warcs(files).collect()) == [True, True]
