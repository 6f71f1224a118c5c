"""Sharding by histogram sort: exact byte counts below candidate boundaries, then one exchange."""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole

_FIRST_BITS, _BITS = 16, 8
_SIGN = -(1 << 63)


def splitters(keyed: DataFrame, parts: int, tolerance: float) -> tuple[list[int], list[int]]:
    """Boundaries that cut ``keyed`` (``_key`` long, ``_bytes`` long) into parts of equal bytes.

    Each round counts, for every candidate boundary, the exact bytes and rows below it: the
    key range still in question around a splitter is divided into equal ranges and one
    aggregation sums them over all partitions. A splitter is final when the bytes below a
    candidate are within ``tolerance`` (a share of all bytes) of its target, or when no key
    lies between the candidates on both sides of it. At most parts × 256 counts (65,536 in
    the first round) reach the driver, whatever the input.

    Returns the boundaries (rows with a key at or over a boundary lie above it) and the
    number of rows below each.
    """
    ordered = F.col("_key").bitwiseXOR(F.lit(_SIGN))
    bits = _FIRST_BITS
    # Ranges in question: key prefix -> bytes and rows below it, and the targets inside it.
    questions: dict[int, tuple[int, int, list[int]]] = {}
    found: dict[int, tuple[int, int]] = {}
    total = None
    while total is None or questions:
        cell = F.shiftrightunsigned(ordered, 64 - bits)
        asked = keyed
        if total is not None:
            asked = keyed.where(F.shiftrightunsigned(ordered, 64 - before).isin(list(questions)))
        counted = asked.groupBy(cell.alias("cell")).agg(F.sum("_bytes").alias("b"), F.count("*").alias("n")).collect()
        cells = sorted((r.cell if r.cell >= 0 else r.cell + (1 << 64), r.b, r.n) for r in counted)
        if total is None:
            total = sum(b for _, b, _ in cells)
            slack = total * tolerance
            targets = [total * i // parts for i in range(1, parts)]
            questions = {0: (0, 0, targets)} if cells else {}
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for c, b, n in cells:
            groups.setdefault(0 if bits == _FIRST_BITS else c >> _BITS, []).append((c, b, n))
        nxt: dict[int, tuple[int, int, list[int]]] = {}
        for prefix, (below, rows, wanted) in questions.items():
            inside = groups[prefix]
            ends = [below, *accumulate((b for _, b, _ in inside), initial=below)][1:]
            tops = [rows, *accumulate((n for _, _, n in inside), initial=rows)][1:]
            for target in wanted:
                at = min(max(bisect_right(ends, target) - 1, 0), len(inside) - 1)
                low, high = ends[at], ends[at + 1]
                c = inside[at][0]
                edge = (c, low, tops[at]) if target - low <= high - target else (c + 1, high, tops[at + 1])
                if abs(edge[1] - target) <= slack or bits == 64:
                    found[target] = (edge[0] << (64 - bits), edge[2])
                else:
                    nxt.setdefault(c, (low, tops[at], []))[2].append(target)
        questions, before, bits = nxt, bits, min(64, bits + _BITS)
    chosen = [found[t] for t in targets] if found else []
    return [k for k, _ in chosen], [n for _, n in chosen]


def histogram_shards(
    df: DataFrame, key: Column, size: Column, tie: list[str], shards: int = 40, blocks: int = 16,
    tolerance: float = 0.00005,
) -> DataFrame:
    """Give every row a ``shard`` (int) and a gapless ``slot`` (long) so that shards hold near equal bytes.

    Rows are ordered by ``key`` (a long; NULL sorts as 0), shards are ranges of it whose bytes differ
    from the mean by about ``tolerance`` of all bytes, or by one key where a key is heavier. A shard is
    cut into ``blocks`` smaller ranges in the same search, so no task sorts a whole shard, and slots
    follow from exact counts below each block. ``size`` NULL counts as 0 bytes. Equal rows are
    interchangeable; an empty table gives an empty table; columns named shard or slot are replaced.
    """
    keyed = df.select(F.coalesce(key.cast("long"), F.lit(0)).alias("_key"), F.coalesce(size.cast("long"), F.lit(0)).alias("_bytes"))
    edges, below = splitters(keyed, shards * blocks, tolerance)
    # Where each of 256 equal key ranges begins among the edges, and the edges inside it.
    table = []
    for r in range(256):
        inside = [e + _SIGN for e in edges if e >> 56 == r]
        table.append({"base": sum(e >> 56 < r for e in edges), "edges": inside})
    starts = [0, *below]
    first = [starts[b] - starts[b - b % blocks] if edges else 0 for b in range(shards * blocks)]
    spot = F.element_at(
        F.from_json(F.lit(json.dumps(table)), "array<struct<base:int,edges:array<bigint>>>"),
        (F.shiftrightunsigned(F.col("_shard_key").bitwiseXOR(F.lit(_SIGN)), 56) + 1).cast("int"),
    )
    block = spot["base"] + F.size(F.filter(spot["edges"], lambda e: e <= F.col("_shard_key")))
    offset = F.element_at(F.from_json(F.lit(json.dumps(first)), "array<bigint>"), F.col("_shard_block") + 1)
    inside = Window.partitionBy("_shard_block").orderBy("_shard_key", *tie)
    return (
        df.withColumn("_shard_key", F.coalesce(key.cast("long"), F.lit(0)))
        .withColumn("_shard_block", block)
        .withColumn("slot", offset + F.row_number().over(inside) - 1)
        .withColumn("shard", F.floor(F.col("_shard_block") / blocks).cast("int"))
        .drop("_shard_key", "_shard_block")
    )


def text_key(doc_id: str = "doc_id") -> Column:
    """A sort key that puts equal texts side by side: 44 bits of the text's hash, 20 of the id's."""
    low = (1 << 20) - 1
    return F.xxhash64(whole()).bitwiseAND(F.lit(~low)).bitwiseOR(F.xxhash64(F.col(doc_id)).bitwiseAND(F.lit(low)))


def op1_histogram_sharding(spark, sf_dir):
    from .common import read_table

    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(whole()) + 16).cast("long").alias("size"), F.crc32(whole()).alias("text_crc32"),
        text_key().alias("_sort"),
    )
    placed = histogram_shards(docs, F.col("_sort"), F.col("size"), ["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
