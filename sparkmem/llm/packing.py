"""Mixture-controlled packing: deficit round-robin over source queues into sequences of fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import read_table, whole
from .tokens import END_OF_DOCUMENT, PieceEncoder, vocabulary_path

#: Rounds whose sums are added up in one task.
_SPAN = 4096


def packets(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """Documents as runs of at most ``length`` token ids, the packets of the round-robin.

    (doc_id, _source, _block, _row, _part, _tokens of the document, _at the packet's place in its source's
    part of the block, _n, _ids). Ids are 16-bit, the document's followed by id 0. A block is one input task.
    """
    def cut(batches):
        encoder = PieceEncoder(vocabulary)
        end = np.asarray([END_OF_DOCUMENT], "<u2").tobytes()
        block, row, queued = TaskContext.get().partitionId(), 0, {}
        names = ["doc_id", "_source", "_block", "_row", "_part", "_tokens", "_at", "_n", "_ids"]
        rows = {n: [] for n in names}
        held = 0

        def flush():
            nonlocal rows, held
            out = pa.RecordBatch.from_arrays([pa.array(rows[n], t) for n, t in zip(names, types)], names)
            rows, held = {n: [] for n in names}, 0
            return out

        types = [id_type, pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for doc_id, source, text in zip(*(batch.column(i) for i in range(3))):
                ids = encoder.encode(text.as_py()) + end
                tokens, source = len(ids) // 2, source.as_py()
                at = queued.get(source, 0)
                queued[source] = at + tokens
                for part, start in enumerate(range(0, tokens, length)):
                    piece = ids[2 * start:2 * (start + length)]
                    for n, v in zip(names, (doc_id.as_py(), source, block, row, part, tokens, at + start, len(piece) // 2, piece)):
                        rows[n].append(v)
                held += len(ids)
                row += 1
                if held > 2 << 20:
                    yield flush()
        if held:
            yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    slim = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")), whole())
    return slim.mapInArrow(cut, (
        f"doc_id {kind.simpleString()}, _source string, _block int, _row long, _part long, _tokens long, _at long, _n long, _ids binary"
    ))


def running(df: DataFrame, keys: list[str], order: list[str], size: str):
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size).over(w), F.lit(0))


def mixture_order(cut: DataFrame, shares: DataFrame | None, window: int) -> DataFrame:
    """Add ``_place``, the position of a packet's first token in the packed stream.

    Deficit round-robin: in each round (a window of ``window`` tokens) a source's counter grows by
    its share of the window, and its packets are served while the counter covers them; what
    is left over carries into the next round. As a queue's counter never resets while it has
    packets, a packet whose last token is the c-th of its queue is served in round
    ceil(c / quantum): no task has to replay the rounds of another, and the deficits carry
    over windows and input partitions by prefix sums. A source that has run dry drops out of the later rounds.

    ``shares``: (_source, _share > 0); None takes the sources' token shares, so all run dry together. A source
    missing from ``shares`` takes its token share.
    """
    blocks = cut.groupBy("_source", "_block").agg(F.sum("_n").alias("_size"))
    blocks = blocks.withColumns({"_base": running(blocks, ["_source"], ["_block"], "_size"), "_supply": F.sum("_size").over(Window.partitionBy("_source"))})
    total = blocks.agg(F.sum("_size")).first()[0] or 1
    natural = F.col("_supply") / F.lit(float(total))
    if shares is not None:
        blocks = blocks.join(shares.select("_source", "_share"), "_source", "left")
        natural = F.coalesce(F.col("_share"), natural)
    blocks = stage(blocks.select("_source", "_block", "_base", (natural * window).alias("_quantum")), "queues")
    slim = cut.select("_source", "_block", "_row", "_part", "_at", "_n").join(blocks, ["_source", "_block"])
    start = F.col("_base") + F.col("_at")
    slim = slim.select(
        "_source", "_block", "_row", "_part", "_n", start.alias("_start"),
        F.ceil((start + F.col("_n")) / F.col("_quantum")).cast("long").alias("_round"),
    )
    turns = slim.groupBy("_round", "_source").agg(F.sum("_n").alias("_size"), F.min("_start").alias("_first"))
    turns = stage(turns.withColumn("_span", F.floor(F.col("_round") / _SPAN)), "turns")
    spans = turns.groupBy("_span").agg(F.sum("_size").alias("_size"))
    spans = spans.select("_span", running(spans, [], ["_span"], "_size").alias("_before"))
    turns = turns.join(spans, "_span").select(
        "_round", "_source", (F.col("_before") + running(turns, ["_span"], ["_round", "_source"], "_size") - F.col("_first")).alias("_shift"),
    )
    return slim.join(turns, ["_round", "_source"]).select("_block", "_row", "_part", (F.col("_shift") + F.col("_start")).alias("_place"), "_round")


def checked_shares(shares: DataFrame) -> DataFrame:
    """``shares`` (_source, _share) with one positive share a source, scaled to add up to 1; raises where that cannot be.

    A NULL source is the queue named ''. One row a source reaches no driver: sums and counts are checked.
    """
    named = stage(shares.select(F.coalesce(F.col("_source").cast("string"), F.lit("")).alias("_source"), F.col("_share").cast("double").alias("_share")), "shares")
    bad = F.col("_share").isNull() | F.isnan("_share") | (F.col("_share") <= 0) | (F.col("_share") == float("inf"))
    total, rows, sources, wrong = named.agg(F.sum("_share"), F.count("*"), F.count_distinct("_source"), F.count_if(bad)).first()
    if wrong:
        raise ValueError(f"{wrong} shares are not positive numbers")
    if sources < rows:
        raise ValueError("a source has several shares")
    return named.withColumn("_share", F.col("_share") / F.lit(total or 1.0))


def packed(
    docs: DataFrame, vocabulary: str | None = None, length: int = 1024, window: int = 64 * 1024, shares: DataFrame | None = None,
) -> DataFrame:
    """Pieces of documents in sequences of ``length`` tokens; each token lies in exactly one piece.

    (doc_id, source, start, length, doc_tokens, sequence_id, offset, ids: 16-bit little-endian bytes). Every window of
    ``window`` tokens holds the sources in their target shares, up to one packet of ``length`` tokens a source, while all have packets
    left. ``shares`` (_source, _share) are scaled to add up to 1; a source they do not name takes its token share. Sequences
    follow one another without padding; only the last one is short.

    NULL and empty texts are one token (the end mark), a NULL source is a queue named '';
    repeated rows are packed as often as they occur; an empty table gives an empty result; other columns are not read.
    ``docs`` should be a stored table or one step from it: each input task is a block of the queues.
    """
    if shares is not None:
        shares = checked_shares(shares)
    cut = stage(packets(docs, vocabulary or vocabulary_path(), length), "packets")
    placed = mixture_order(cut, shares, window)
    both = placed.join(cut.select("_block", "_row", "_part", "doc_id", "_source", "_tokens", "_n", "_ids"), ["_block", "_row", "_part"])
    first = F.least(F.col("_n"), length - F.pmod(F.col("_place"), F.lit(length)))
    pieces = both.select(
        "doc_id", "_source", "_part", "_tokens", "_place", "_ids", F.explode(F.when(first < F.col("_n"), F.array(
            F.struct(F.lit(0).cast("long").alias("from"), first.alias("to")), F.struct(first.alias("from"), F.col("_n").alias("to")),
        )).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("_n").alias("to"))))).alias("_cut"),
    )
    begin, size = F.col("_cut.from"), F.col("_cut.to") - F.col("_cut.from")
    return pieces.select(
        "doc_id", F.col("_source").alias("source"), (F.col("_part") * length + begin).alias("start"), size.alias("length"),
        F.col("_tokens").alias("doc_tokens"), F.floor((F.col("_place") + begin) / length).alias("sequence_id"),
        F.pmod(F.col("_place") + begin, F.lit(length)).alias("offset"), F.expr("substring(_ids, int(2 * _cut.from + 1), int(2 * (_cut.to - _cut.from)))").alias("ids"),
    )


def wide_crc(batches):
    """Replace the last column, 16-bit ids, by the CRC-32 of the ids as unsigned 32-bit numbers."""
    for batch in batches:
        found = [zlib.crc32(np.frombuffer(x.as_py(), "<u2").astype("<u4").tobytes()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "ids_crc32"])


def op2_mixture_packing(spark, sf_dir):
    pieces = packed(read_table(spark, sf_dir, "documents"))
    slim = pieces.select("doc_id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    return slim.mapInArrow(wide_crc, (
        "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long"
    ))
