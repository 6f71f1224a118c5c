"""Importance resampling against brute force and DuckDB, and CRC-32 against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sparkmem.llm import importance

SCHEMA = "doc_id long, text string, weight string, rank binary, _whole int, score double"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{'river Stone école 東京 window'.split()[rng.integers(5)]}{rng.integers(30)}" for _ in range(n))


def table(spark, texts):
    rows = [(i, t, "w", b"r", 1, 0.5) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def words(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features(text, longest):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, longest, buckets=10000, percent=10):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(of(f) for _, x in rows for f in features(x, longest)) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in docs:
        own = features(text, longest)
        weight = sum(math.floor(1000 * math.log((t[of(f)] + 1) * (all_s + buckets) / ((s[of(f)] + 1) * (all_t + buckets)))) for f in own)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fits = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    return out, fits[:percent * len(fits) // 100]


@pytest.fixture(scope="module")
def texts():
    plain = [(i, prose(i, 5 + 7 * (i % 9))) for i in range(60)]
    odd = [(60, None), (61, ""), (62, "..."), (63, "x" * 70000 + " y " + "é" * 3000), (64, prose(64, 9000)), (None, prose(65, 40)), (5, prose(5, 40))]
    return plain + odd


@pytest.mark.parametrize("longest", [1, 3])
def test_weights_and_ranks_equal_brute_force(spark, texts, longest):
    target = [(i, prose(100 + i, 30)) for i in range(8)] + [(9, None)]
    want, drawn = brute(texts, target, longest)
    got = importance.importance_resampled(table(spark, texts).repartition(5), table(spark, target), longest).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter(map(tuple, want))
    ranked = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranked == [(k + 1, r[0], r[3]) for k, r in enumerate(drawn)] and len(drawn) >= 3
    assert {type(r.text) for r in got} == {str, type(None)} and {r._whole for r in got} == {1}


def test_ties_go_to_the_smaller_id_and_repeats_are_drawn_once_each(spark):
    docs = [(7, prose(1, 25))] * 30 + [(3, None)]
    got = importance.importance_resampled(table(spark, docs), table(spark, []), percent=50).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 16)) and len(got) == 31


def test_empty_tables(spark, texts):
    none = table(spark, [])
    assert importance.importance_resampled(none, none).count() == 0
    want, drawn = brute(texts[:20], [], 1)
    got = importance.importance_resampled(table(spark, texts[:20]), none, keep=["doc_id"])
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {r.doc_id: r.weight for r in got.collect()} == {r[0]: r[2] for r in want}


def test_crc_of_spans_of_all_lengths():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 300000).astype(np.uint8)
    lengths = np.concatenate([np.arange(300), rng.choice([4095, 4096, 4097, 4160, 9000, 262143, 262144, 262145], 30), [0, 300000]])
    starts = (rng.random(len(lengths)) * (len(data) - lengths + 1)).astype(np.int64)
    got = importance.crc32_spans(data, starts, starts + lengths)
    assert got.tolist() == [zlib.crc32(data[a:a + n].tobytes()) for a, n in zip(starts, lengths)]
    assert importance.crc32_spans(data[:0], starts[:0], starts[:0]).tolist() == []


def test_query_equals_its_sql_on_odd_texts(spark, texts, tmp_path):
    docs = [(i, t) for i, t in texts if i is not None][:-1]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(200, 50)), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = importance.op12_importance_resampling(spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({importance.OP12_SQL})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and len(want) == len(docs)
