"""Recall for prompts as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..options import DecayOptions, RecallOptions
from ..plans.recall import recall, recall_increments


def stream_recall(
    prompts: DataFrame,
    memories,
    now,
    hits_path: str,
    increments_path: str,
    checkpoint: str,
    opts: RecallOptions = RecallOptions(),
    decay_opts: DecayOptions = DecayOptions(),
    trigger: dict | None = None,
):
    """Start a query that answers each micro-batch of prompts from the memory table.

    Hits and increments land under ``batch_id=N``; a replayed batch overwrites its own folder. Increments of
    all batches add up (``apply_increments``). ``now`` and ``memories`` may be functions of the batch id, so that
    later batches see a later version of the table.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        at = now(batch_id) if callable(now) else now
        table = memories(batch_id) if callable(memories) else memories
        hits = recall(batch, table, at, opts, decay_opts).hits
        target = f"{hits_path}/batch_id={batch_id}"
        hits.write.mode("overwrite").parquet(target)
        written = batch.sparkSession.read.schema(hits.schema).parquet(target)
        recall_increments(written, at).write.mode("overwrite").parquet(f"{increments_path}/batch_id={batch_id}")

    return (
        prompts.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
