"""Batches of rounds from a stream of rounds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.expr import strip_tool_calls
from ..operators.conversation import CONVERSATION, with_batch_id
from ..options import SummaryOptions
from ..plans.remember import remember
from ..sources.staging import stage

_ROUND = T.StructType(
    [
        T.StructField("round_id", T.StringType()),
        T.StructField("user_text", T.StringType()),
        T.StructField("assistant_text", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)
_COUNT = T.StructType([T.StructField("seen", T.LongType()), T.StructField("batches", T.LongType())])


class RoundBatcher(StatefulProcessor):
    """Holds the rounds of the open batch of one conversation: never more than every - 1."""

    def __init__(self, every: int, idle_ms: int | None, ttl_ms: int | None, by_event: bool = False):
        self.every, self.idle_ms, self.ttl_ms, self.by_event = every, idle_ms, ttl_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _ROUND, self.ttl_ms)
        self.count = handle.getValueState("count", _COUNT, self.ttl_ms)

    def _rows(self, key, held, first, batch_no):
        frame = pd.DataFrame(held, columns=_ROUND.names)
        frame.insert(0, "user_id", key[0])
        frame.insert(1, "conv_id", key[1])
        frame["round"] = range(first, first + len(held))
        frame["batch_no"] = batch_no
        frame["batch_size"] = len(held)
        frame["flush"] = len(held) < self.every
        return frame

    def handleInputRows(self, key, rows, timerValues):
        seen, batches = self.count.get() if self.count.exists() else (0, 0)
        held = list(self.open.get()) if self.open.exists() else []
        for frame in rows:
            frame = frame.sort_values(["ts", "round_id"], kind="stable")
            for r in frame[_ROUND.names].itertuples(index=False, name=None):
                held.append(r)
                if len(held) == self.every:
                    yield self._rows(key, held, seen + 1, batches)
                    seen, batches, held = seen + self.every, batches + 1, []
        self.open.clear()
        if held:
            self.open.put([_plain(r) for r in held])
        self.count.update((int(seen), int(batches)))
        if self.idle_ms is None:
            return
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held:
            last = max(pd.Timestamp(r[3]).value // 1_000_000 for r in held) if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(last + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = list(self.open.get()) if self.open.exists() else []
        if held:
            seen, batches = self.count.get()
            yield self._rows(key, held, seen + 1, batches)
            self.open.clear()
            self.count.update((int(seen) + len(held), int(batches) + 1))

    def close(self) -> None:
        pass


def _plain(row):
    round_id, user, assistant, ts = row
    return round_id, user, assistant, pd.Timestamp(ts).to_pydatetime()


BATCHED = (
    "user_id bigint, conv_id string, round_id string, user_text string, assistant_text string, "
    "ts timestamp, round bigint, batch_no bigint, batch_size int, flush boolean"
)


def stream_round_batches(
    rounds: DataFrame, every: int = 10, idle_seconds: float | None = 1800, ttl_days: float | None = 30, delay: str | None = None
) -> DataFrame:
    """Emit the rounds of a batch when its last one arrives, or when the conversation goes idle.

    Rounds count in order of arrival (by time inside one trigger). State that is not
    touched for ``ttl_days`` expires; counting then starts anew, and ``with_batch_id`` still tells the batches
    apart by their rounds. Needs the RocksDB state store, and a processing-time
    trigger: its timers follow the clock, so ``availableNow`` would not end. With ``idle_seconds=None`` only full
    batches leave, nothing follows the clock (no expiry either), and ``availableNow`` ends.

    With a ``delay``, idleness is told by the times of the rounds instead of the clock: a batch leaves when rounds
    ``delay`` later than its last one plus ``idle_seconds`` have been seen in any conversation. ``availableNow`` then ends
    with these flushes; state does not expire.
    """
    if delay is not None:
        batcher = RoundBatcher(every, int(idle_seconds * 1000), None, by_event=True)
        return (
            rounds.select("user_id", F.col("conv_id").cast("string").alias("conv_id"), *_ROUND.names)
            .withWatermark("ts", delay)
            .groupBy(*CONVERSATION)
            .transformWithStateInPandas(batcher, BATCHED, outputMode="append", timeMode="eventTime", eventTimeColumnName="ts")
        )
    timed = idle_seconds is not None
    ttl = int(ttl_days * 86_400_000) if timed and ttl_days is not None else None
    batcher = RoundBatcher(every, int(idle_seconds * 1000) if timed else None, ttl)
    return (
        rounds.select("user_id", F.col("conv_id").cast("string").alias("conv_id"), *_ROUND.names)
        .groupBy(*CONVERSATION)
        .transformWithStateInPandas(batcher, BATCHED, outputMode="append", timeMode="processingTime" if timed else "none")
    )


def stream_remember(
    rounds: DataFrame,
    now,
    memories_path: str,
    checkpoint: str,
    summarizer=None,
    embedder=None,
    opts: SummaryOptions = SummaryOptions(),
    idle_seconds: float | None = 1800,
    ttl_days: float | None = 30,
    trigger: dict | None = None,
):
    """Start a query that condenses rounds into memory rows as their batches leave the stream.

    Rows land under ``batch_id=N``; a replayed micro-batch overwrites its own folder. ``now`` may be a function of the
    batch id. Idle batches shorter than ``opts.min_rounds`` and unusable replies
    leave no memory; ``summarize_batches`` over the log with the ids of these memories as ``known`` meets them again.
    """

    def condense(batch: DataFrame, batch_id: int) -> None:
        at = now(batch_id) if callable(now) else now
        rows = batch.withColumn("assistant_text", strip_tool_calls("assistant_text"))
        rows = stage(with_batch_id(rows), "stream-rounds")  # the state is read once
        out = remember(rows, at, summarizer, embedder, opts)
        out.memories.write.mode("overwrite").parquet(f"{memories_path}/batch_id={batch_id}")

    return (
        stream_round_batches(rounds, opts.every, idle_seconds, ttl_days)
        .writeStream.foreachBatch(condense)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or ({"availableNow": True} if idle_seconds is None else {"processingTime": "1 minute"})))
        .start()
    )


def stream_sessions(rounds: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Closed sessions: a conversation without a round for ``gap``. One row with its bounds and
    size; ``session_rounds`` fetches the rounds."""
    return (
        rounds.withWatermark("ts", gap)
        .groupBy(*CONVERSATION, F.session_window("ts", gap).alias("session"))
        .agg(F.count("*").alias("rounds"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(*CONVERSATION, "rounds", "first_ts", "last_ts")
    )


def session_rounds(sessions: DataFrame, rounds: DataFrame) -> DataFrame:
    """The rounds of closed sessions, from the table they are logged to."""
    return rounds.join(sessions.select(*CONVERSATION, "first_ts", "last_ts"), CONVERSATION).where(
        F.col("ts").between(F.col("first_ts"), F.col("last_ts"))
    )
