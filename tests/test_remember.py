import json
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

import sparkmem as sm
from registry.inputs import NOW
from sparkmem.functions.models import extractive_summarizer
from sparkmem.operators.merging import extractive_reducer

ROUNDS = "user_id long, conv_id string, round_id string, user_text string, assistant_text string, ts timestamp"


def rounds(spark, n, conv="c", text="Tell me about the garden. And more.", step=timedelta(minutes=7)):
    start = datetime(2024, 3, 1)
    return spark.createDataFrame([(1, conv, f"r{i:05d}", text, f"answer {i}", start + i * step) for i in range(n)], ROUNDS)


def test_round_numbers_of_one_huge_conversation(spark):
    """Numbers run through hours and seconds without a gap, equal times included."""
    r = rounds(spark, 5000, step=timedelta(seconds=97)).unionByName(
        rounds(spark, 50, step=timedelta(0)).withColumn("round_id", F.concat(F.lit("a"), "round_id")))
    out = sm.round_batches(r.repartition(8), 10).orderBy("ts", "round_id").collect()
    assert [x["round"] for x in out] == list(range(1, 5051))
    assert [x.batch_no for x in out] == [i // 10 for i in range(5050)]
    assert {x.flush for x in out} == {False}
    plan = sm.round_batches(r, 10)._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan  # no task ever holds a whole conversation, nor a whole second


def test_last_short_batch_is_flushed_or_left(spark):
    out = sm.summarize_batches(rounds(spark, 21), NOW)
    assert out.memories.count() == 2 and [r.round_id for r in out.leftover.collect()] == ["r00020"]
    assert sm.summarize_batches(rounds(spark, 22), NOW).memories.count() == 3


def test_summary_of_a_batch(spark):
    said = ["Plan the garden. It is big.", "Garden roses need water! Yes.", "", "What about garden tools?"]
    r = spark.createDataFrame(
        [(1, "c", f"r{i}", t, "reply\nwith lines <tool_use>x</tool_use>", datetime(2024, 3, 1, 0, i)) for i, t in enumerate(said)], ROUNDS)
    (m,) = sm.summarize_batches(r, NOW).memories.collect()
    assert m.content == "Plan the garden. Garden roses need water! What about garden tools?"
    assert m.topics == ["garden", "about", "need", "plan", "roses"]
    assert m.key_facts == ["Plan the garden.", "Garden roses need water!", "What about garden tools?"]
    assert (m.tier, m.source, m.importance, m.access_count) == ("daily", "auto_summary", 0.5, 0)
    assert m.session_id.startswith("session-2024-03-01-") and str(m.created_at) == NOW
    assert (m.id,) == tuple(x.id for x in sm.summarize_batches(r, NOW).memories.collect())


def test_text_of_a_batch(spark):
    r = spark.createDataFrame([(1, "c", "a", "hi\nthere ", " ", datetime(2024, 3, 1)), (1, "c", "b", "", "ok", datetime(2024, 3, 1, 1))], ROUNDS)
    from sparkmem.operators.conversation import with_batch_id

    batches = with_batch_id(sm.round_batches(r, 10))
    t = sm.assemble_conversation(batches, sm.SummaryOptions(user_label="U", assistant_label="A")).first()
    assert t.text == "[U | 2024-03-01T00:00:00] - hi there\n[A | 2024-03-01T01:00:00] - ok"
    cut = sm.assemble_conversation(batches, sm.SummaryOptions(max_chars=20)).first().text
    assert cut == "[user | 2024-03-01T0\n...(对话过长已截断)"


def test_model_calls_and_unusable_replies(spark):
    def reply(texts):
        return [json.dumps({"summary": t[:6], "importance": 0.9}) if "r" in t and "00:00:00" in t else "[]" for t in texts]

    def make():
        def predict(batch):
            return np.array([[len(t), 1.0] for t in batch])

        return predict

    out = sm.summarize_batches(rounds(spark, 20), NOW, sm.model_summarizer(reply), sm.model_embedder(make, 8))
    (m,) = out.memories.collect()
    assert m.content == "[user " and m.importance == 0.9
    assert abs(np.linalg.norm(m.embedding) - 1) < 1e-6 and len(m.embedding) == 2
    (q,) = out.quarantined.collect()
    assert q.problem == "not an object" and q.batch_no == 1 and q.text.startswith("[user")


def test_prompts_as_text_find_their_memories(spark):
    m = sm.summarize_batches(rounds(spark, 20), NOW).memories.select("*")
    q = spark.createDataFrame([("a", 1, "Tell me about the garden."), ("b", 1, ""), ("c", 1, "zzz qqq")],
                              "query_id string, user_id long, prompt string")
    hits = sm.recall(q, m, NOW).hits.collect()
    assert {(r.query_id, r["rank"]) for r in hits} == {("a", 1), ("a", 2)}


def test_each_text_reaches_the_model_once(spark, tmp_path):
    folder = str(tmp_path)

    def reply(texts):
        import os
        import uuid

        for _ in texts:
            open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return ['{"summary":"s"}' for _ in texts]

    out = sm.summarize_batches(rounds(spark, 40), NOW, sm.model_summarizer(reply))
    assert out.memories.count() == 4 and out.memories.count() == 4 and out.quarantined.isEmpty()
    assert len(list(tmp_path.iterdir())) == 4


def test_a_growing_log_is_condensed_once(spark):
    """Consumed rounds stay away, short rests and the next day's rounds come; known batches reach no model."""
    opts = sm.SummaryOptions(every=10, min_rounds=3)
    first = sm.summarize_batches(rounds(spark, 22), NOW, opts=opts)
    assert first.memories.count() == 2 and first.consumed.count() == 20
    again = sm.summarize_batches(rounds(spark, 22), NOW, opts=opts, consumed=first.consumed)
    assert again.memories.isEmpty() and again.consumed.isEmpty() and again.leftover.count() == 2
    later = sm.summarize_batches(rounds(spark, 35), NOW, opts=opts, consumed=first.consumed)
    assert later.memories.count() == 2 and later.consumed.select("round_id").distinct().count() == 15
    ids = first.memories.select("id").unionByName(later.memories.select("id"))
    assert ids.distinct().count() == 4

    def no_call(texts):
        raise AssertionError("condensed again")

    known = sm.summarize_batches(rounds(spark, 22), NOW, sm.model_summarizer(no_call), opts=opts, known=first.memories)
    assert known.memories.isEmpty() and known.quarantined.isEmpty()


def test_a_consumed_round_of_no_conversation_is_known(spark):
    r = rounds(spark, 3).withColumns({"conv_id": F.lit(None).cast("string"), "user_id": F.lit(None).cast("long")})
    done = sm.summarize_batches(r, NOW)
    assert done.memories.count() == 1 and sm.without_consumed(r, done.consumed).isEmpty()


def test_rounds_without_conversation_or_user_are_numbered(spark):
    from sparkmem.operators.ordering import number_rows

    rows = [(None, "u", 3, "a"), (None, "u", 1, "b"), ("c", None, 2, "d"), (None, None, None, "e")]
    df = spark.createDataFrame(rows, "conv_id string, user_id string, at int, round_id string").withColumn("ts", F.timestamp_seconds("at"))
    got = {r.round_id: (r.position, r.group_rows) for r in number_rows(df, ["conv_id", "user_id"], ["ts", "round_id"]).collect()}
    assert got == {"b": (1, 2), "a": (2, 2), "d": (1, 1), "e": (1, 1)}


def test_one_moment_that_holds_all_rounds_is_numbered_in_many_tasks(spark):
    from sparkmem.operators.ordering import number_rows

    n = 20000
    rows = spark.range(n).select(
        F.lit("c").alias("conv_id"), F.lit(None).cast("timestamp").alias("ts"),
        F.when(F.col("id") % 4 > 0, F.col("id").cast("string")).alias("round_id"), (F.col("id") % 977).alias("text"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few bytes would else go to one task
    try:
        got = number_rows(rows, ["conv_id"], ["ts", "round_id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbers = [r.position for r in got.orderBy("position").collect()]
    assert numbers == list(range(1, n + 1)) and {r.group_rows for r in got.limit(5).collect()} == {n}
    ids = [r.round_id for r in got.where("round_id is not null").orderBy("position").collect()]
    assert ids == sorted(ids)
    files = got.inputFiles()
    assert len(files) > 1  # written by the tasks of the range exchange
    held = [spark.read.parquet(f).count() for f in files]
    assert max(held) < 0.6 * n
    again = {(r.round_id, r.text, r.position) for r in number_rows(rows.repartition(3), ["conv_id"], ["ts", "round_id"]).collect()}
    assert again == {(r.round_id, r.text, r.position) for r in got.collect()}


def test_all_rows_can_be_one_group(spark):
    from sparkmem.operators.ordering import number_rows

    got = number_rows(spark.range(100).repartition(4), [], [F.desc("id")]).collect()
    assert all(r.position == 100 - r.id and r.group_rows == 100 for r in got)
    assert number_rows(spark.range(0), [], ["id"]).isEmpty()


def test_summarizer_counts_a_text_in_its_row(spark):
    """No word is shuffled; texts that share their name are counted together, those without one keep nothing."""
    said = ["Rose garden plan. Rose and water. Nothing new rose.", "Empty", "", None, "Ağaç ağaç. Ördek GÖL göl!", "x. " * 400 + "Zebra zebra runs."]
    rows = spark.createDataFrame([(f"b{i}", t) for i, t in enumerate(said)], "batch_id string, text string")
    out = extractive_summarizer(max_chars=30)(rows)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.batch_id: json.loads(r.raw) for r in out.collect()}
    assert got["b0"]["summary"] == "Rose garden plan." and got["b0"]["topics"] == ["rose", "garden", "nothing", "plan", "water"]
    assert got["b2"]["summary"] == got["b3"]["summary"] == "" and got["b2"]["topics"] == []
    assert got["b4"]["topics"] == ["ağaç", "ördek"]
    assert got["b5"]["summary"].endswith("Zebra zebra runs.") and len(got["b5"]["summary"]) <= 30
    twice = rows.where("batch_id = 'b0'").unionByName(rows).unionByName(spark.createDataFrame([(None, "Lost.")], rows.schema))
    again = [(r.batch_id, json.loads(r.raw)) for r in extractive_summarizer(max_chars=30)(twice).collect()]
    assert len(again) == 8 and [r["topics"] for b, r in again if b == "b0"] == [got["b0"]["topics"]] * 2
    assert [r["summary"] for b, r in again if b is None] == [""]
    assert all(r == got[b] for b, r in again if b not in ("b0", None))


def test_numbered_rows_are_dealt_out_once(spark):
    """The counts that shift the numbers are written down, so the rows meet them without a second exchange."""
    from sparkmem.operators.ordering import number_rows

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = number_rows(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    assert [r.position for r in number_rows(df, ["k"], ["id"]).where("k = 1").orderBy("id").collect()] == [*range(1, 334)]


def test_reducer_equals_brute_force_with_sentences_that_add_nothing(spark):
    """Repeated sentences fill what room is left, in order, and only if all that add a word fit."""
    import random

    draw = random.Random(7)
    texts = {}
    for user in range(8):
        words = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(3 + 3 * user)]
        texts[user] = [". ".join(" ".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(draw.randint(1, 5))) + ".\n!?\n" if i % 5 else None for i in range(30)]

    def expected(contents, budget):
        said = [[s.strip() + "." for s in (c or "").split("\n")[0].split(".") if s.strip()] for c in contents]
        counts, first, rows = {}, {}, [(i, j, s) for i, c in enumerate(said) for j, s in enumerate(c)]
        for i, j, s in rows:
            for w in s[:-1].split():
                counts[w] = counts.get(w, 0) + 1
                first.setdefault(w, (i, j))
        score = {(i, j): sum(n.bit_length() for w, n in counts.items() if first[w] == (i, j)) for i, j, _ in rows}
        kept, total = [], 0
        for i, j, s in sorted(rows, key=lambda r: (-score[r[:2]], r[:2])):
            total += len(s) + 1
            if total <= budget + 1:
                kept.append((i, j, s))
        lines = {}
        for i, _, s in sorted(kept):
            lines.setdefault(i, []).append(s)
        return "\n".join(" ".join(lines[i]) for i in sorted(lines))

    rows = [(u, "2024-01", 1, datetime(2024, 1, 1, 0, i), f"m{i:02d}", c, [], [], 0.5, None) for u, cs in texts.items() for i, c in enumerate(cs)]
    members = spark.createDataFrame(rows, "user_id long, period string, ord int, created_at timestamp, id string, content string, topics array<string>, key_facts array<string>, base double, sentiment string")
    for budget in (60, 400):
        got = {r.user_id: r.summary for r in extractive_reducer(budget)(members).collect()}
        assert got == {u: expected(cs, budget) for u, cs in texts.items()}
