"""Notes to chunks."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of chunks that leave a task together.
_CHARS_OUT = 16 << 20


def pack_chunks(content: str, max_chars: int) -> list[str]:
    """Greedy packing of paragraphs; long paragraphs fall apart into sentences and lines."""
    chunks, held, size = [], [], 0
    for paragraph in content.split("\n\n"):
        long = len(paragraph) > max_chars
        for piece in re.split(r"(?<=\.) |\n", paragraph) if long else [paragraph]:
            if held and size + len(piece) > max_chars:
                chunks.append("\n\n".join(held))
                held, size = [], 0
            held.append(piece)
            size += len(piece)
    chunks.append("\n\n".join(held))
    return chunks


def chunk_corpus(notes: DataFrame, max_chars: int = 2000, keys: tuple[str, ...] = ("file_name",)) -> DataFrame:
    """(keys, pos, chunk) for every note. Packing is sequential inside one note, parallel over notes."""
    kinds = ", ".join(f"`{k}` {notes.schema[k].dataType.simpleString()}" for k in keys)

    def gathered(batch, at, pos, out):
        rows = batch.select(list(keys)).take(pa.array(at, pa.int64()))
        return pa.RecordBatch.from_arrays(
            [*rows.columns, pa.array(pos, pa.int32()), pa.array(out, pa.string())], [*keys, "pos", "chunk"]
        )

    def task(batches):
        for batch in batches:
            at, pos, out, held = [], [], [], 0
            for row, text in enumerate(batch.column("content")):
                for i, chunk in enumerate(pack_chunks(text.as_py() or "", max_chars)):
                    at.append(row)
                    pos.append(i)
                    out.append(chunk)
                    held += len(chunk)
                    if held >= _CHARS_OUT:
                        yield gathered(batch, at, pos, out)
                        at, pos, out, held = [], [], [], 0
            yield gathered(batch, at, pos, out)

    return notes.select(*keys, "content").mapInArrow(task, f"{kinds}, pos int, chunk string")
