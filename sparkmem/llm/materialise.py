"""Token sequences written in training order as fixed-stride binary shards."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.staging import shared_dir, stage
from .common import read_table, whole
from .tokens import END_OF_DOCUMENT, PieceEncoder, vocabulary_path
from .words import mix

LENGTH = 1024
#: Text of about so many bytes goes to one shard.
SHARD_BYTES = 16 << 20


def sequences(docs: DataFrame, vocabulary: str, length: int) -> DataFrame:
    """(_block, _index, n_tokens, doc_ids, ids): the documents of each input task in a row, each followed by id 0, cut every ``length`` tokens.

    ``ids`` are 16-bit little-endian numbers. Only the last sequence of a block is short.
    """
    kind = docs.schema["doc_id"].dataType

    def cut(batches):
        encoder = PieceEncoder(vocabulary)
        end = np.asarray([END_OF_DOCUMENT], "<u2").tobytes()
        block, index, width = TaskContext.get().partitionId(), 0, 2 * length
        rest, owners = bytearray(), []  # bytes not yet cut; (doc_id, bytes of it in ``rest``)
        out: list[tuple] = []

        def take(size):
            nonlocal index, rest
            ids, left, names = bytes(rest[:size]), size, []
            del rest[:size]
            while left and owners:
                doc, held = owners[0]
                names.append(doc)
                if held > left:
                    owners[0] = (doc, held - left)
                    left = 0
                else:
                    left -= held
                    owners.pop(0)
            out.append((block, index, size // 2, names, ids))
            index += 1

        def flush():
            columns = list(zip(*out)) if out else [()] * 5
            out.clear()
            types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(to_arrow_type(kind)), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["_block", "_index", "n_tokens", "doc_ids", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                rest += ids
                owners.append((doc.as_py(), len(ids)))
                while len(rest) >= width:
                    take(width)
                if len(out) > 4096:
                    yield flush()
        if rest:
            take(len(rest))
        yield flush()

    return docs.select("doc_id", whole()).mapInArrow(
        cut, f"_block int, _index long, n_tokens long, doc_ids array<{kind.simpleString()}>, ids binary"
    )


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 … n - 1: a balanced Feistel network over the next even power of two, walked until inside."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (1 << 64) - 1))
    out = index.astype(np.uint64)
    open_ = np.arange(len(out))
    while len(open_):
        a, b = out[open_] >> half, out[open_] & mask
        for k in keys:
            a, b = b, a ^ (mix(b ^ k) & mask)
        out[open_] = a << half | b
        open_ = open_[out[open_] >= n]
    return out.astype(np.int64)


def _local(path: str) -> str | None:
    """A path that plain files reach, or None for a store only its own client reads."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


class _Sink:
    """Writes one file under a name of its own and gives it its final name at the end, so a repeated or lost attempt leaves no half file in place."""

    def __init__(self, folder: str, name: str):
        self._draft = f"{folder}/_{name}.{uuid.uuid4().hex}"
        self._final = f"{folder}/{name}"
        if _local(folder) is not None:
            self._fs, self._draft, self._final = None, _local(self._draft), _local(self._final)
            os.makedirs(os.path.dirname(self._draft), exist_ok=True)
            self.file = open(self._draft, "wb")
        else:
            from pyarrow import fs

            self._fs, self._draft = fs.FileSystem.from_uri(self._draft)
            self._final = self._draft.rsplit("/", 1)[0] + "/" + name
            self._fs.create_dir(self._draft.rsplit("/", 1)[0], recursive=True)
            self.file = self._fs.open_output_stream(self._draft)

    def close(self):
        self.file.close()
        if self._fs is None:
            os.replace(self._draft, self._final)
        else:
            self._fs.move(self._draft, self._final)


def record(ids: bytes, length: int) -> bytes:
    """The number of ids as an unsigned 32-bit number, then ``length`` 16-bit ids, zeros at the end."""
    return (len(ids) // 2).to_bytes(4, "little") + ids.ljust(2 * length, b"\0")


def read_shard(path: str, length: int = LENGTH, first: int = 0):
    """The ids of the records of one shard from record ``first`` on, read in sequence."""
    stride = 4 + 2 * length
    with open(path, "rb") as f:
        f.seek(first * stride)
        while chunk := f.read(stride):
            n = int.from_bytes(chunk[:4], "little")
            yield np.frombuffer(chunk, "<u2", n, 4)


def materialised(
    docs: DataFrame, folder: str, key: int = 17, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, vocabulary: str | None = None,
) -> DataFrame:
    """Write all token sequences of ``docs`` under ``folder`` in a keyed random order; one row per sequence comes back.

    (slot, shard, offset in the file, n_tokens, ids_crc32 of the 16-bit ids, doc_ids). A first pass sums rows and bytes per input
    task. A token has at least one byte, so these bound a task's sequences and give each task a range of numbers of its own;
    a sequence's number goes through a Feistel permutation of all n numbers, walked until inside n. Equal ranges of the permuted
    numbers are the shards: one exchange deals the sequences out, and a task writes its shards front to back and
    renames each when complete. As bounds leave unused numbers, ``slot`` counts the used ones: 0, 1, … over the shards in
    order. A run resumes at any slot: a shard's first slot is the records before it, a record lies at its place × stride.

    NULL and empty texts are one end mark; repeated rows are written as often as they occur; an empty table writes
    no file; other columns are not read. ``docs`` should be a stored table or one step from it: both passes
    must see the same input tasks, and the second raises if a task outgrows its range.
    """
    sizes = docs.groupBy(F.spark_partition_id().alias("block")).agg(F.count("*").alias("rows"), F.sum(F.octet_length(whole())).alias("bytes")).collect()
    rooms = np.zeros(max((r.block for r in sizes), default=-1) + 1, np.int64)
    for r in sizes:
        rooms[r.block] = -(-(r.rows + r.bytes) // length)
    bases, n = np.append(0, np.cumsum(rooms)), int(rooms.sum())
    shards = max(1, -(-sum(r.bytes for r in sizes) // shard_bytes))
    width = -(-max(1, n) // shards)

    def permute(batches):
        for batch in batches:
            block, index = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(block) and (block.max() >= len(rooms) or (index >= rooms[block]).any()):
                raise ValueError("the input tasks of the two passes differ; store the documents first")
            yield pa.RecordBatch.from_arrays(
                [pa.array(feistel(bases[block] + index, n, key)), *batch.columns[2:]], ["_number", "n_tokens", "doc_ids", "ids"]
            )

    cut = sequences(docs, vocabulary or vocabulary_path(), length)
    kind = cut.schema["doc_ids"].dataType.simpleString()
    placed = cut.mapInArrow(permute, f"_number long, n_tokens long, doc_ids {kind}, ids binary")
    placed = placed.withColumn("shard", F.floor(F.col("_number") / width)).repartition("shard").sortWithinPartitions("_number")
    stride = 4 + 2 * length

    def write(batches):
        sink, current, place = None, None, 0
        for batch in batches:
            shards_, places, crc = (batch.column(0).to_numpy() // width).tolist(), [], []
            for shard, ids in zip(shards_, batch.column(3)):
                if shard != current:
                    if sink:
                        sink.close()
                    sink, current, place = _Sink(folder, f"shard-{shard:08d}.bin"), shard, 0
                ids = ids.as_py()
                sink.file.write(record(ids, length))
                crc.append(zlib.crc32(ids))
                places.append(place)
                place += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(shards_, pa.int64()), pa.array(places, pa.int64()), batch.column(1), pa.array(crc, pa.int64()), batch.column(2)],
                ["shard", "_place", "n_tokens", "ids_crc32", "doc_ids"],
            )
        if sink:
            sink.close()

    written = stage(placed.mapInArrow(write, f"shard long, _place long, n_tokens long, ids_crc32 long, doc_ids {kind}"), "training-order")
    counts = written.groupBy("shard").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written.join(counts.select("shard", before.alias("_before")), "shard").select(
        (F.col("_before") + F.col("_place")).alias("slot"), "shard", (F.col("_place") * stride).alias("offset"), "n_tokens", "ids_crc32", "doc_ids",
    )


def op5_training_order(spark, sf_dir):
    folder = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    return materialised(read_table(spark, sf_dir, "documents"), folder)
