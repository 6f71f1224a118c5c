import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import sparkmem as sm
from registry.inputs import NOW, memories, prompts, rounds

from .conftest import SF


def log_lines(n, conv="c", user=1, start=datetime(2024, 1, 1), step=timedelta(minutes=1)):
    for i in range(n):
        yield {
            "id": f"{conv}-{i:04d}", "user_id": user, "conv_id": conv, "round": i + 1, "user": f"question {i}",
            "assistant": f"answer {i}", "timestamp": (start + i * step).isoformat() + "Z",
        }


def write_file(folder, name, lines):
    """One log file; files arrive in the order of their numbers."""
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(x) for x in lines) + "\n{broken\n\n")
    at = time.time() - 1000 + 10 * int(name.split(".")[0])
    os.utime(folder / name, (at, at))


def run_batches(spark, src, out, ckpt, rounds_in, every=3, idle=3600.0):
    """Run until ``rounds_in`` rounds are taken in, then stop: timers keep such a query alive."""
    stream = sm.stream_round_batches(sm.stream_rounds(spark, str(src), files_per_trigger=1), every, idle)
    q = (
        stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(ckpt))
        .outputMode("append").trigger(processingTime="3 seconds").start()
    )
    end = time.time() + 90
    while time.time() < end and sum(p["numInputRows"] for p in q.recentProgress) < rounds_in:
        assert q.exception() is None
        time.sleep(0.2)
    while q.status["isTriggerActive"]:
        time.sleep(0.1)
    q.stop()


COLUMNS = ["user_id", "conv_id", "round_id", "user_text", "round", "batch_no", "batch_size", "flush"]


def test_full_batches_equal_the_batch_job_across_a_restart(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", tmp_path / "ckpt"
    a, b = list(log_lines(8, "a")), list(log_lines(4, "b", user=2))
    write_file(src, "1.json", a[:4] + b[:1])
    run_batches(spark, src, out, ckpt, 5)
    write_file(src, "2.json", a[4:5])
    write_file(src, "3.json", a[5:] + b[1:])
    run_batches(spark, src, out, ckpt, 7)
    got = spark.read.parquet(str(out)).select(*COLUMNS)
    want = sm.round_batches(sm.read_rounds(spark, str(src)), 3).where("not flush").select(*COLUMNS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.count() == 9


def test_idle_conversation_flushes_its_open_batch(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", log_lines(4, "a"))
    stream = sm.stream_round_batches(sm.stream_rounds(spark, str(src)), 3, idle_seconds=0.5)
    q = (
        stream.writeStream.format("memory").queryName("idle_out").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(processingTime="300 milliseconds").start()
    )
    try:
        end = time.time() + 90
        while time.time() < end and spark.table("idle_out").where("flush").count() == 0:
            time.sleep(0.5)
        rows = spark.table("idle_out").orderBy("round").collect()
    finally:
        q.stop()
    assert [(r["round"], r.batch_no, r.batch_size, r.flush) for r in rows] == [
        (1, 0, 3, False), (2, 0, 3, False), (3, 0, 3, False), (4, 1, 1, True),
    ]


def test_sessions_close_after_the_gap(spark, tmp_path):
    src = tmp_path / "in"
    first = list(log_lines(3, "a")) + list(log_lines(2, "a2", user=1))
    later = list(log_lines(2, "a", start=datetime(2024, 1, 1, 5)))
    late_id = [dict(x, id="z" + x["id"]) for x in later]
    closer = list(log_lines(1, "z", user=9, start=datetime(2024, 1, 2)))
    write_file(src, "1.json", first)
    write_file(src, "2.json", late_id)
    write_file(src, "3.json", closer)
    q = (
        sm.stream_sessions(sm.stream_rounds(spark, str(src), 1), "30 minutes")
        .writeStream.format("memory").queryName("sessions_out").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(240)
    closed = spark.table("sessions_out")
    got = sorted((r.conv_id, r.rounds, str(r.first_ts)) for r in closed.collect())
    assert got == [("a", 2, "2024-01-01 05:00:00"), ("a", 3, "2024-01-01 00:00:00"), ("a2", 2, "2024-01-01 00:00:00")]
    table = sm.read_rounds(spark, str(src))
    assert sm.session_rounds(closed, table).count() == 7


def test_stream_recall_equals_batch_recall(spark, tmp_path):
    m = sm.stage(memories(spark, SF), "m")
    asked = prompts(spark, SF)
    src = tmp_path / "prompts"
    asked.repartition(3).write.parquet(str(src))
    opts = sm.RecallOptions(min_score=0.2, min_cosine=0.2)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    q = sm.stream_recall(stream, m, NOW, str(tmp_path / "hits"), str(tmp_path / "updates"), str(tmp_path / "ckpt"), opts)
    q.awaitTermination(240)
    assert q.exception() is None
    columns = ["query_id", "id", "rank", "score"]
    got = spark.read.parquet(str(tmp_path / "hits")).select(*columns)
    want = sm.recall(asked, m, NOW, opts).hits.select(*columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and not want.isEmpty()
    gained = spark.read.parquet(str(tmp_path / "updates"))
    assert gained.select("batch_id").distinct().count() == 3
    assert gained.agg(F.sum("hits")).first()[0] == want.count()
    after = sm.apply_increments(m, gained).select("id", "access_count", "last_accessed")
    at_once = sm.update_metadata(m, sm.recall(asked, m, NOW, opts).updates).select("id", "access_count", "last_accessed")
    assert after.exceptAll(at_once).isEmpty() and at_once.exceptAll(after).isEmpty()


def test_streamed_rounds_become_the_memories_of_the_batch_job(spark, tmp_path):
    src = tmp_path / "in"
    write_file(src, "1.json", list(log_lines(4, "a")) + list(log_lines(3, "b", user=2)))
    write_file(src, "2.json", log_lines(3, "c"))
    opts = sm.SummaryOptions(every=3, min_rounds=2)
    q = sm.stream_remember(sm.stream_rounds(spark, str(src), 1), NOW, str(tmp_path / "out"), str(tmp_path / "ckpt"), opts=opts,
                           idle_seconds=None)
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive
    columns = ["id", "user_id", "content", "session_id"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()))
    log = sm.read_rounds(spark, str(src))
    want = sm.summarize_batches(log, NOW, opts=opts)
    assert got == sorted(map(tuple, want.memories.select(*columns).collect())) and len(got) == 3
    # The log then holds nothing new but what the stream still waits for.
    assert sm.summarize_batches(log, NOW, opts=opts, known=spark.read.parquet(str(tmp_path / "out"))).memories.isEmpty()


def test_streamed_rounds_are_the_read_rounds(spark, tmp_path):
    r = rounds(spark, SF)
    path = str(tmp_path / "log")
    sm.append_rounds(r, path)
    stored = sm.read_rounds(spark, path)
    q = (
        sm.stream_rounds(spark, path).writeStream.format("memory").queryName("rounds_out")
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    assert spark.table("rounds_out").exceptAll(stored).isEmpty()
    assert stored.count() == r.count() == spark.table("rounds_out").count()


def test_sessions_of_a_table_that_is_a_folder_of_files(spark, tmp_path):
    from registry.queries import stream_sessions

    turns = [(c, t, "user" if t % 2 == 0 else "assistant", "x") for c in range(6) for t in range(3)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    rows.repartition(3).write.parquet(str(tmp_path / "many" / "conversations.parquet"))
    (tmp_path / "one").mkdir()
    rows.toPandas().to_parquet(tmp_path / "one" / "conversations.parquet")
    many, one = (sorted(stream_sessions(spark, str(tmp_path / d)).collect(), key=lambda r: r.conv_id) for d in ("many", "one"))
    assert many == one and [r.conv_id for r in many] == list("01234")
