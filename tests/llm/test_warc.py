"""Archives against brute force: round trip, revisits, damaged files, and the merged order of their captures."""

import base64
import glob
import gzip
import hashlib
import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmem.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, best int, position binary"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def table(spark, rows):
    return spark.createDataFrame([(i, u, t, "d", 1, b"p") for i, u, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    hot = [(100 + i, f"http://host.example/{i % 3}", "<p>the same</p>") for i in range(80)]
    odd = [
        (1, None, "a"), (2, "http://a.example/x", None), (3, "http://a.example/x y\r\nFake: 1", ""), (4, "https://www.A.example:443/q?b=1#f", "é" * 40),
        (5, "http://b.example:8080/", "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "http://n.example/", "no id"), (None, "http://n.example/", "no id"),
        (6, "http://twice.example/", "repeated row"), (6, "http://twice.example/", "repeated row"), (6, "http://twice.example/", "repeated row"),
        (7, "not a url", "long " * 60000), (8, "http://[broken/", "x"), (9, "http://A.example/x", "a"),
    ]
    return odd + hot


def wanted(rows, least=0):
    groups = {}
    for i, u, t in rows:
        groups.setdefault(t or "", []).append((i, u))
    out = []
    for text, own in groups.items():
        size, digest = len(text.encode()), sha(text)
        own.sort(key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
        if size < least:
            out += [(i, size, digest, "response", None) for i, _ in own]
        else:
            out += [(i, size, digest, "revisit", own[-1][0]) for i, _ in own[:-1]] + [(own[-1][0], size, digest, "response", None)]
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_archives_give_back_every_page(spark, rows, tmp_path, least):
    path = str(tmp_path / "w")
    warc.write_archives(table(spark, rows).repartition(4), path, least=least, archive_bytes=20000)
    found = warc.capture_histories(warc.capture_runs(spark, path), ranges=5).collect()
    number = lambda x: None if x is None else int(x)
    got = [(number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in found]
    assert sorted(got, key=str) == wanted(rows, least)
    assert [r.position for r in found] == list(range(1, len(rows) + 1))
    keys = [(r.url_key, r.captured, r.record_id) for r in found]
    assert keys == sorted(keys) and len({r.part for r in found}) > 1
    assert len(glob.glob(f"{path}/part-*")) > 4
    for r in found:  # the index leads to the record
        data = gzip.open(r.file.removeprefix("file:")).read()
        assert data[r.offset:r.offset + r.length].startswith(b"WARC/1.1\r\n") and r.record_id.encode() in data[r.offset:r.offset + r.length]
    payloads = warc.read_payloads(spark, path).where("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in payloads} == {t or "" for _, _, t in rows}
    responses = {r.record_id for r in payloads}
    assert len(responses) == len(payloads)


def test_url_keys_sort_by_host():
    keys = {
        "http://www.Example.com:80/a?b#c": "com,example)/a?b", "https://x.example.com:8443": "com,example,x:8443)/", None: "", "": "",
        "plain": "plain", "http://[bad": "http://[bad", "http://example.com:port/": "http://example.com:port/",
    }
    assert {u: warc.url_key(u) for u in keys} == keys


def test_digests_equal_hashlib(spark):
    texts = ["", "a", "é€", "x" * 1000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(warc.base32_sha1(F.col("t")).alias("d"))
    assert [r.d for r in df.collect()] == [sha(t) for t in texts]


def test_damaged_archives_are_told(spark, rows, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(table(spark, [(1, "http://a.example/", "payload " * 50)]), path)
    (file,) = [f for f in glob.glob(f"{path}/part-*") if gzip.open(f).read(1)]
    whole = gzip.open(file).read()
    for broken in (whole[:-100], whole.replace(b"payload payload", b"payload pAyload", 1), whole[3:]):
        with pytest.raises(ValueError):
            list(warc.records(broken, "x"))
    assert len(list(warc.records(whole, "x"))) == 1 and list(warc.records(b"", "x")) == []


def test_loser_tree_merges_like_a_heap():
    rng = np.random.default_rng(0)
    for k in (1, 2, 3, 7, 64):
        runs = [sorted((0, int(x)) for x in rng.integers(0, 50, rng.integers(0, 40))) for _ in range(k)]
        tree, places, got = warc.LoserTree([r[0] if r else warc.LoserTree.LAST for r in runs]), [0] * k, []
        while tree.keys[tree.winner] != tree.LAST:
            w = tree.winner
            got.append(tree.keys[w])
            places[w] += 1
            tree.replace(runs[w][places[w]] if places[w] < len(runs[w]) else tree.LAST)
        assert got == list(heapq.merge(*runs))


def test_blocks_are_taken_in_as_they_overlap():
    rng = np.random.default_rng(1)
    blocks = sorted((sorted((0, int(x)) for x in rng.integers(a, a + 30, 9)) for a in rng.integers(0, 2000, 300)), key=lambda b: b[0])
    got = [b[place] for b, place in warc.merged_blocks((b, b) for b in blocks)]
    assert got == sorted(k for b in blocks for k in b)
    assert list(warc.merged_blocks([])) == []


def test_one_url_with_most_captures_is_cut(spark):
    many = [("u", f"2024-{i % 12 + 1:02d}", f"r{i:06d}") for i in range(3000)] + [("v", "2024", f"s{i}") for i in range(50)]
    fields = [None] * 9
    runs = []
    for run in range(6):
        own = sorted(many[run::6])
        runs += [(f"f{run}", b, [(*k, *fields) for k in own[a:a + 100]]) for b, a in enumerate(range(0, len(own), 100))]
    kind = "run string, block int, captures array<struct<" + ",".join(f.replace(" ", ":") for f in warc.CAPTURE.split(", ")) + ">>"
    got = warc.capture_histories(spark.createDataFrame(runs, kind), ranges=4).collect()
    assert [(r.url_key, r.captured, r.record_id) for r in got] == sorted(many)
    assert max(np.bincount([r.part for r in got])) < 1500 and [r.position for r in got] == list(range(1, len(many) + 1))


def test_no_pages(spark, tmp_path):
    warc.write_archives(table(spark, []), str(tmp_path / "w"))
    assert warc.capture_histories(warc.capture_runs(spark, str(tmp_path / "w"))).count() == 0
