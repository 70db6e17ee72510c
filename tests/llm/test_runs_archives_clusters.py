"""Periodic runs, archives and clusters against brute force on small tables with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from apexline.llm import centroids, periodic, warc
from apexline.llm import words as W

DOCS = "doc_id long, text string, lang string"


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def _odd_text(r):
    out = []
    for _ in range(r.randrange(1, 6)):
        root = [r.choice("abc") for _ in range(r.randrange(1, 9))]
        root = root * r.randrange(1, 4) + ["z"] * r.randrange(2)
        out += [(root * 40)[: r.randrange(80)], [r.choice("ab") for _ in range(r.randrange(40))], ["x"] * r.randrange(60)][r.randrange(3)]
    return out


def test_tree_finds_the_runs_of_every_period():
    r = random.Random(3)
    for _ in range(200):
        texts = [_odd_text(r) for _ in range(4)]
        least, times = r.choice([(24, 3), (4, 2), (6, 3), (1, 2), (10, 4)])
        data = [" ".join(t).encode() for t in texts]
        found = periodic.runs_of(W.find(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])), least, times)
        for i, t in enumerate(texts):
            lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.get(i, []))
            # An id whose crc32 isn't divisible by 10, so that the text is as it is.
            want = periodic.brute_force([(1, " ".join(t))], least, times)[0]
            assert zlib.crc32(b"1") % 10 and want[1] == len(found.get(i, [])) and want[6] == hashlib.sha256(lines.encode()).hexdigest()
            assert not t or periodic.exact_runs(t, least, times) == found.get(i, [])


def test_equal_hashes_of_other_words_are_found_out(monkeypatch):
    real = W.Words.hashes
    monkeypatch.setattr(W.Words, "hashes", lambda w: real(w) % np.uint64(3))
    t = " ".join(_odd_text(random.Random(8)) + [f"w{i % 5}" for i in range(40)])
    found = periodic.runs_of(W.find(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])), 24, 3)
    assert found.get(0, []) == periodic.exact_runs(t.split(), 24, 3) != []


def test_periodic(spark):
    r = random.Random(5)
    rows = [(i, " ".join(_odd_text(r))) for i in range(120)]
    rows += [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(r.randrange(300)))) for i in range(120, 200)]  # one in ten is looped
    rows += [(300, None), (301, ""), (302, " \t\n "), (303, "one"), (None, "a " * 30), (None, None), (304, "é\x0bü\x0c" * 20), (304, "é\x0bü\x0c" * 20), (305, "x" * 100_000), (306, "a b c " * 2000)]
    looped = [i for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 == 0]
    assert len(looped) > 10
    rows += [(j, t) for j, t in zip([j for j in range(1000, 2000) if zlib.crc32(str(j).encode()) % 10 == 0], (None, "", " ", "one", "two words"), strict=False)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], DOCS)
    assert got(periodic.report(docs)) == sorted(periodic.brute_force(rows), key=str)
    assert periodic.report(docs.where("false")).count() == 0
    found, name = periodic.collapse_runs(docs.withColumns({"runs": F.lit(1), "result": F.lit(2)}), least=6)
    assert set(found.columns) == {"doc_id", "lang", "runs", "result", name} and found.where("doc_id = 306").select(f"{name}.collapsed").first()[0] == "a b c"
    with pytest.raises(ValueError):
        periodic.collapse_runs(docs, times=1)


def test_looped_texts(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(i % 70))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d, old, new in docs.select("doc_id", "text", periodic.looped(F.col("doc_id"), F.col("text"))).collect():
        w, h = old.split(), zlib.crc32(str(d).encode())
        if h % 10 or not w:
            assert new == old
        else:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            assert new.split() == [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


PAGES = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>" if i % 3 else f"<b>{i}\r\n\r\nWARC/1.1</b>") for i in range(60)] + [
    (100, None, None), (101, "http://x/a b\r\nWARC-Type: x", ""), (102, "http://ü/ä?q=1%20#f", "x" * 300_000), (None, "http://n", ""), (None, "http://n", "only here"), (None, None, "only here"), (103, "http://y", "x" * 300_000),
    (2**62, "http://z", "é" * 1000), (-5, "http://z", "é" * 1000),
]


@pytest.mark.parametrize("min_bytes", [0, 10])
def test_warc(spark, min_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    want = warc.brute_force([(i, h) for i, _, h in PAGES], min_bytes)
    # With keys that are all null nobody is referred to.
    assert got(warc.report(pages, min_bytes)) == sorted(want, key=str)
    assert warc.report(pages.where("false")).count() == 0


def test_warc_archives(spark, tmp_path):
    """Archives are plain gzip members; some records are read by a part of the index; a changed archive is found out."""
    import gzip
    import os

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"print": F.lit(1), "salt": F.lit(2), "key": F.lit(3)})
    index = warc.write(pages, str(tmp_path / "a"), date="2024-01-01T00:00:00Z")
    assert index.count() == len(PAGES)
    rows = {(r.key, r.url, r.payload) for r in warc.read(index.where("key in ('4', '60', '102', '103', '9')"), str(tmp_path / "a")).collect()}
    assert rows == {("4", "http://x/4", None), ("102", "http://%C3%BC/%C3%A4?q=1%20#f", None), ("103", "http://y", "x" * 300_000), ("9", "http://x/9", PAGES[9][2])}
    first = next((tmp_path / "a").iterdir())
    text = gzip.decompress(first.read_bytes()).decode()
    assert text.startswith("WARC/1.1\r\nWARC-Type: warcinfo") and "\nWARC-Type: x" not in text
    row = index.where("key = '9'").first()
    good = gzip.decompress((tmp_path / "a" / row.archive).read_bytes()[row.offset : row.offset + row.length])
    assert warc.parse(good)["key"] == "9" and row.url == "http://x/9"
    with pytest.raises(ValueError):
        warc.parse(good[:-5] + b"?\r\n\r\n")
    with pytest.raises(ValueError):
        warc.parse(good[:-1])
    assert not [f for f in os.listdir(tmp_path / "a") if not f.endswith(".warc.gz")]


def test_ranges_are_joined_over_small_gaps_only():
    assert warc.ranges([(100, 10), (0, 10), (15, 5), (500, 1)], gap=5) == [(0, 20, [(0, 10), (15, 5)]), (100, 110, [(100, 10)]), (500, 501, [(500, 1)])]
    assert warc.ranges([]) == []


@pytest.mark.parametrize("block", [4096, 16])
def test_centroids(spark, monkeypatch, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    r = np.random.default_rng(4)
    rows = [(i, (r.normal(size=64) + 2 * (i % 5)).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(8, rows[8][1])] * 3  # ties and repeated rows
    rows += [(400, None), (401, [1.0] * 63 + [None]), (402, [1.0] * 63 + [float("nan")]), (403, [1.0] * 63), (404, []), (None, [0.5] * 64), (None, [0.25] * 64), (405, [float("inf")] * 64)]
    kind = "vec_id long, embedding array<double>, cluster int, v int"
    v = spark.createDataFrame([(*x, 1, 2) for x in rows], kind)
    assert got(centroids.report(v)) == sorted(centroids.brute_force(rows), key=str)
    assert centroids.report(v.where("false")).count() == 0
    few = [(i, x) for i, x in rows if i is not None and i < 5]
    assert got(centroids.report(v.where("vec_id < 5"))) == sorted(centroids.brute_force(few), key=str)


def test_centroids_beyond_64_bits(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=64) * 10.0 ** (i % 12)).tolist()) for i in range(60)] + [(100, [1e300] * 64), (101, [-1e300] * 32 + [1.0] * 32)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(centroids.report(v)) == sorted(centroids.brute_force(rows), key=str)


def test_centroids_compare_what_moved_only(monkeypatch):
    """Vectors whose owner stayed are compared with moved centroids only, and come out as in a full comparison."""
    r = np.random.default_rng(6)
    v, before = r.integers(-2000, 2000, (500, 64)), r.integers(-2000, 2000, (8, 64)).astype(object)
    owner, far = centroids.reassign(v, False, None, None, before, np.ones(8, bool))
    after, moved = before.copy(), np.zeros(8, bool)
    after[[2, 5]] += r.integers(-300, 300, (2, 64))
    moved[[2, 5]] = True
    seen, real = [], centroids.distances
    monkeypatch.setattr(centroids, "distances", lambda a, c, w: seen.append((len(a), len(c))) or real(a, c, w))
    new, near = centroids.reassign(v, False, owner, far, after, moved)
    lost = int(np.isin(owner, [2, 5]).sum())
    assert seen == [(lost, 8), (500 - lost, 2)]
    whole = real(v, after, False)
    assert (new == whole.argmin(axis=1)).all() and (near == whole.min(axis=1)).all()
    total = {c: v[new == c].sum(axis=0) - v[owner == c].sum(axis=0) for c in range(8)}
    for t in centroids.transfers(v, False, owner, new):
        assert [(h << 32) + low for h, low in zip(t["high"], t["low"], strict=True)] == total.pop(t["c"]).tolist()
    assert all((x == 0).all() for x in total.values())
