import json

from pyspark.sql import functions as F

import sparkmem as sm
from registry.inputs import NOW, memories, rounds

from .conftest import SF, memory_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_memories_round_trip_with_pruning_and_pushdown(spark, tmp_path):
    path = str(tmp_path / "m")
    m = memories(spark, SF)
    sm.write_memories(m, path)
    back = sm.read_memories(spark, path)
    assert back.columns == m.columns and back.count() == m.count()
    assert back.exceptAll(m).isEmpty()
    assert "embedding" not in plan(sm.read_memories(spark, path, vectors=False))
    assert "GreaterThanOrEqual(importance,0.3)" in plan(sm.min_importance(back))
    text = plan(sm.by_tier_and_period(back, "daily", "2024-05"))
    assert "GreaterThanOrEqual(created_at" in text and "LessThan(created_at" in text
    assert "PartitionFilters: [isnotnull(tier" in text
    assert "GreaterThanOrEqual(created_at" in plan(sm.expire(back, NOW))
    for df in (sm.decay(back, NOW), sm.session_start(back, NOW)):
        assert "Python" not in plan(df) and "InArrow" not in plan(df)


def test_empty_values_are_stored_as_null(spark, tmp_path):
    path = str(tmp_path / "m")
    sm.write_memories(memory_rows(spark, [{"id": "a", "content": "", "topics": [], "tier": "daily", "sentiment": "x"}]), path)
    r = sm.read_memories(spark, path).first()
    assert r.content is None and r.topics is None and r.sentiment == "x"


def test_append_rounds_numbers_on_and_strips_tool_calls(spark, tmp_path):
    path = str(tmp_path / "log")
    r = rounds(spark, SF).withColumn("assistant_text", F.concat("assistant_text", F.lit("<tool_use>x</tool_use>")))
    sm.append_rounds(r, path)
    first = sm.read_rounds(spark, path)
    assert first.where(F.col("assistant_text").contains("tool_use")).isEmpty()
    again = r.withColumn("round_id", F.concat("round_id", F.lit("-b")))
    sm.append_rounds(again, path, existing=sm.stage(first, "log"))
    numbers = spark.read.json(path).groupBy("conv_id").agg(F.sort_array(F.collect_list("round")).alias("n"))
    assert all(x.n == list(range(1, len(x.n) + 1)) for x in numbers.collect())
    assert sm.read_rounds(spark, path).select("ts").exceptAll(r.select("ts").union(r.select("ts"))).isEmpty()


def test_a_repeated_append_of_a_run_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    r = rounds(spark, SF).withColumn("round_id", F.when(F.col("round_id").endswith("0"), F.col("round_id")))
    sm.append_rounds(r, path, run="monday")
    once = sm.stage(sm.read_rounds(spark, path), "log")
    sm.append_rounds(r, path, run="monday")
    twice = sm.read_rounds(spark, path)
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    assert once.select("round_id").distinct().count() == r.count()
    sm.append_rounds(r, path, existing=once, run="tuesday")
    assert sm.read_rounds(spark, path).select("round_id").where("round_id like 'round-%'").distinct().count() == 2 * r.where("round_id is null").count()


def test_broken_and_blank_round_lines_are_skipped(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text('{"id":"a","user":"u","timestamp":"2024-01-01T00:00:00Z"}\n\n{broken\n   \n{"id":"b"}\n')
    rows = sorted(sm.read_rounds(spark, str(f)).collect())
    assert [(r.round_id, r.user_text, r.user_id, r.conv_id) for r in rows] == [("a", "u", 0, ""), ("b", "", 0, "")]


def test_notes_are_whole_markdown_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("one\n\ntwo\n", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    assert [tuple(r) for r in sm.read_notes(spark, str(tmp_path)).collect()] == [("a.md", "one\n\ntwo\n")]


def test_archive_index_and_lookup(spark, tmp_path):
    path = str(tmp_path / "archive")
    s = sm.settle(memories(spark, SF), sm.DAILY_TO_MONTHLY, NOW)
    archived = sm.stage(s.archived, "a")
    sm.write_archive(archived, path)
    archive, index = sm.read_archive(spark, path), sm.archive_index(spark, path)
    assert index.count() == archived.count() == archive.count()
    sm.write_archive(archived.where("period = '2024-02'"), path, "late")
    twice = sm.read_archive(spark, path).count()
    sm.write_archive(archived.where("period = '2024-02'"), path, "late")  # a retry adds nothing
    assert sm.read_archive(spark, path).count() == twice > archived.count()
    some = archived.where("period = '2024-02'").select("id")
    found = sm.lookup_archive(archive, some.union(spark.createDataFrame([("nope",)], "id string")), index)
    rows = found.collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in some.collect())
    assert all("tier=daily/period=2024-02" in r.path for r in rows)
    contents = {r.id: r.content for r in archived.collect()}
    assert all(r.content == contents[r.id] and r.metadata.base_importance is not None for r in rows)


def entry(kind, content, **more):
    return json.dumps({"type": kind, "message": {"content": content}, **more})


def test_last_user_message_of_transcript_files(spark, tmp_path):
    files = {
        "string": [entry("user", "first"), entry("user", "  last \n"), entry("assistant", "no")],
        "list": [entry("user", "x"), entry("user", [{"type": "image"}, {"type": "text", "text": " part "}, {"type": "text", "text": "p2"}])],
        "meta": [entry("user", "real"), entry("user", "meta", isMeta=True), entry("user", "   ")],
        "broken": [entry("user", "kept"), "{broken", entry("user", "tail") + " extra", ""],
        "image": [entry("user", [{"type": "image"}])],
        "odd": [json.dumps({"type": "user"}), "[1]", entry("user", "isfalse", isMeta=False), entry("user", 5)],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    (tmp_path / "long").write_text("\n".join(entry("user", f"line {i} " + "x" * 300) for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        lines = sm.read_transcript_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 8
        got = {r.transcript.rsplit("/", 1)[1]: r.last_user for r in sm.last_user_message(lines).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.pop("long").startswith("line 2999 ")
    assert got == {"string": "last", "list": "part", "meta": "real", "broken": "kept", "odd": "isfalse"}


def test_stage_needs_a_shared_folder_off_local(spark):
    from sparkmem.sources.staging import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_upsert_and_delete(spark):
    m = memory_rows(spark, [{"id": "a", "content": "old", "sentiment": "x", "access_count": 3}, {"id": "b", "content": "b"}])
    new = spark.createDataFrame([("a", "new", ""), ("c", "c", "y")], "id string, content string, sentiment string")
    got = {r.id: (r.content, r.sentiment, r.access_count) for r in sm.upsert(m, new).collect()}
    assert got == {"a": ("new", "x", 3), "b": ("b", None, None), "c": ("c", "y", None)}
    gone = sm.delete_ids(m, spark.createDataFrame([("a",), ("zzz",)], "id string"))
    assert [r.id for r in gone.collect()] == ["b"]
    assert sm.all_memories(m, gone.withColumn("merged_into", F.lit("s"))).where("archived").count() == 1
    assert sm.update_metadata(m, new.select("id", "sentiment")).count() == 2


def test_tier_weights(spark):
    h = spark.createDataFrame([("q", "a", 0.4, "daily", 0.5), ("q", "b", 0.9, "yearly", 0.5), ("q", "c", 0.1, "monthly", 0.0), ("q", "d", 0.3, None, 0.5)],
                              "query_id string, id string, effective double, tier string, distance double")
    assert [r.id for r in sm.tier_weighted_rank(h, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_kept_index_opens_only_the_files_it_names(spark, tmp_path):
    path, index = str(tmp_path / "archive"), str(tmp_path / "index")
    archived = sm.stage(sm.settle(memories(spark, SF), sm.DAILY_TO_MONTHLY, NOW).archived, "a")
    for run, rows in (("a", archived.where("access_count % 2 = 0")), ("b", archived.where("access_count % 2 = 1"))):
        for _ in range(2):  # a repeated run changes nothing
            sm.write_archive(rows, path, run)
            sm.write_archive_index(spark, path, index, run)
    one = archived.orderBy("id").limit(1)
    got = sm.find_archived(spark, path, index, one)
    (period, run), = {(r.period, "ab"[r.access_count % 2]) for r in one.collect()}
    assert [r.id for r in got.collect()] == [one.first().id]
    scan = got._jdf.queryExecution().optimizedPlan().collectLeaves().head().relation().location()
    assert len(scan.inputFiles()) == 1 and f"period={period}/run={run}" in scan.inputFiles()[0]
    every = sm.find_archived(spark, path, index, archived, few=10)
    assert sorted(r.id for r in every.collect()) == sorted(r.id for r in archived.collect())
    assert sorted(r.id for r in sm.find_archived(spark, path, index, archived, most_files=1).collect()) == sorted(r.id for r in archived.collect())
    assert sm.find_archived(spark, path, index, spark.createDataFrame([("no",), (None,)], "id string")).isEmpty()
