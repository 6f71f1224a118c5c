import json
import re
from collections import Counter
from datetime import datetime

import pytest

from pyspark.sql import functions as F

import sparkmem as sm
from registry.inputs import NOW, memories
from sparkmem.operators.merging import extractive_reducer

from .conftest import SF, memory_rows

DAY, MONTH = sm.DAILY_TO_MONTHLY, sm.MONTHLY_TO_YEARLY


def daily(i, user=1, day=None, **over):
    row = {
        "id": f"m{i:03d}", "user_id": user, "content": f"content {i}", "topics": [f"t{i % 3}"], "key_facts": [f"f{i}"],
        "importance": 0.9, "base_importance": 0.4, "sentiment": "neutral", "source": "auto_summary", "tier": "daily",
        "access_count": 0, "created_at": day or datetime(2024, 1, 1 + i), "embedding": [1.0, float(i)],
    }
    row.update(over)
    return row


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_two_faded_rows_stay_three_settle(spark):
    two = [daily(i, user=1) for i in range(2)] + [daily(9, user=1, day=datetime(2024, 6, 30), base_importance=0.9)]
    three = [daily(i, user=2, id=f"n{i}") for i in range(3)]
    s = sm.settle(memory_rows(spark, two + three), DAY, NOW)
    hot = {r.id: r for r in s.hot.collect()}
    assert sorted(r.id for r in s.archived.collect()) == ["n0", "n1", "n2"]
    (new,) = [r for r in hot.values() if r.tier == "monthly"]
    assert new.content == "content 0\ncontent 1\ncontent 2"
    assert new.topics == ["t0", "t1", "t2"] and new.key_facts == ["f0", "f1", "f2"]
    assert (new.user_id, new.source, new.session_id, new.access_count, new.merge_count) == (2, "settlement", "settle-2024-01", 0, 1)
    assert new.parent_ids is None and new.importance == new.base_importance == 0.4
    assert str(new.created_at) == "2024-01-01 00:00:00" and len(new.embedding) == 512
    assert {"m000", "m001", "m009"} < set(hot) and hot["m000"].importance < 0.35
    assert {r.merged_into for r in s.archived.collect()} == {new.id}


def test_settlement_merges_into_the_summary_of_the_period(spark):
    old = daily(50, tier="monthly", day=datetime(2024, 1, 20), content="old", parent_ids=["x"], merge_count=2, base_importance=0.8)
    later = daily(51, tier="monthly", day=datetime(2024, 1, 25), content="later")
    s = sm.settle(memory_rows(spark, [daily(i) for i in range(3)] + [old, later]), DAY, NOW)
    hot = {r.id: r for r in s.hot.collect()}
    assert sorted(hot) == ["m050", "m051"]
    new = hot["m050"]
    assert new.content == "old\ncontent 0\ncontent 1\ncontent 2"
    assert new.parent_ids == ["x"] and new.merge_count == 3
    assert ids(sm.lineage_edges(s.archived, s.merged)) == ["m000", "m001", "m002", "x"]
    assert new.importance == 0.5 and hot["m051"].content == "later"


def test_rows_without_a_tier_join_only_when_the_user_has_no_daily_row(spark):
    rows = [daily(i, user=1, tier=None) for i in range(3)]
    rows += [daily(i + 10, user=2, tier=None, day=datetime(2024, 1, 5)) for i in range(3)] + [daily(20, user=2)]
    s = sm.settle(memory_rows(spark, rows), DAY, NOW)
    assert ids(s.archived) == ["m000", "m001", "m002"]
    hot = {r.id: r for r in s.hot.collect()}
    assert all(hot[f"m01{i}"].tier is None and hot[f"m01{i}"].importance == 0.9 for i in range(3))


def test_below_shield_also_copies_the_middle_band(spark):
    rows = [daily(i) for i in range(3)] + [daily(7, day=datetime(2024, 1, 30), base_importance=1.0, access_count=0)]
    now = "2024-02-24 00:00:00"  # the last row is at exp(-25/30) = 0.4346
    s = sm.settle(memory_rows(spark, rows), DAY, now, archive_band="below_shield")
    assert ids(s.archived) == ["m000", "m001", "m002", "m007"] and "m007" in ids(s.hot)
    assert {r.id for r in s.archived.where("merged_into is null").collect()} == {"m007"}
    assert ids(sm.settle(memory_rows(spark, rows), DAY, now).archived) == ["m000", "m001", "m002"]


def test_semantic_target_takes_a_near_summary_of_another_period(spark):
    embed = sm.hashing_embedder(64)
    rows = [daily(i, content="alpha beta gamma") for i in range(3)]
    rows.append(daily(30, tier="monthly", day=datetime(2023, 11, 1), content="alpha beta gamma"))
    rows.append(daily(31, tier="monthly", day=datetime(2023, 10, 1), content="something else entirely"))
    m = embed(memory_rows(spark, rows).drop("embedding"), "content", "embedding").select(*memory_rows(spark, rows).columns)
    # Of four equal vectors the three with the smallest ids are nearest, so the summary needs a small one.
    m = m.withColumn("id", F.when(F.col("id") == "m030", "a030").otherwise(F.col("id")))
    assert "a030" not in ids(sm.settle(m, DAY, NOW).merged)
    s = sm.settle(m, DAY, NOW, embedder=embed, semantic_target=True)
    (new,) = s.merged.collect()
    assert new.id == "a030" and ids(s.hot) == ["a030", "m031"]


def test_nothing_is_lost_and_settling_again_changes_nothing(spark):
    m = sm.stage(memories(spark, SF), "m")
    for rule in (DAY, MONTH):
        s = sm.settle(m, rule, NOW)
        hot, archived, merged, unsettled = (sm.stage(x, "s") for x in s)
        assert unsettled.isEmpty()
        new = merged.join(m, "id", "left_anti")
        assert ids(hot.select("id").union(archived.select("id"))) == ids(m.select("id").union(new.select("id")))
        assert archived.groupBy("id").count().where("count > 1").isEmpty()
        again = sm.settle(hot, rule, NOW)
        assert again.archived.isEmpty() and again.merged.isEmpty() and ids(again.hot) == ids(hot)
        assert hot.where("tier = 'yearly'").count() >= m.where("tier = 'yearly'").count()


def salient(contents, budget):
    """The sentences that say most, in plain Python: contents are one sentence each here."""
    words = [re.findall(r"[^\W\d_]{2,}", c.lower()) for c in contents]
    count = Counter(w for ws in words for w in ws)
    first = {}
    for i, ws in enumerate(words):
        for w in ws:
            first.setdefault(w, i)
    score = [sum(count[w].bit_length() for w in set(ws) if first[w] == i) for i, ws in enumerate(words)]
    kept, room = [], 0
    for i in sorted(range(len(contents)), key=lambda i: (-score[i], i)):
        room += len(contents[i]) + 1
        if room > budget + 1:
            break
        kept.append(i)
    return "\n".join(contents[i] for i in sorted(kept))


def test_hot_group_is_merged_like_a_small_one(spark):
    """One period with thousands of members: the same text, lists and mean as plain Python finds; the last one is heard."""
    rows = [daily(i, day=datetime(2024, 1, 1 + i % 28, i % 24), id=f"h{i:05d}", content=f"c{i} " + "x" * (i % 37 + 1),
                  topics=[f"t{i % 11}"], base_importance=(i % 30) / 100, sentiment="negative" if i % 3 else "positive")
            for i in range(4999)]
    rows.append(daily(0, day=datetime(2024, 1, 28, 23), id="z", content="only here a zebra", topics=["t1"], base_importance=0.1, sentiment="negative"))
    s = sm.settle(memory_rows(spark, rows).repartition(8), DAY, NOW)
    (new,) = s.merged.collect()
    ordered = sorted(rows, key=lambda r: (r["created_at"], r["id"]))
    assert ordered[-1]["id"] == "z" and "zebra" in new.content
    assert new.content == salient([r["content"] for r in ordered], 8000) and 7900 < len(new.content) <= 8000
    assert new.topics == list(dict.fromkeys(r["topics"][0] for r in ordered))[:5]
    assert new.key_facts == list(dict.fromkeys(r["key_facts"][0] for r in ordered))[:5]
    base = [r["base_importance"] or r["importance"] for r in rows]
    assert new.importance == round(sum(base) / len(base), 4) and new.sentiment == "negative"
    low = s.archived.count()
    assert new.parent_ids is None and low == 5000 - sum(1 for r in s.hot.collect() if r.tier == "daily")
    assert sm.originals(sm.lineage_edges(s.archived)).where(F.col("summary") == new.id).count() == low


def test_lineage_is_kept_over_several_merges(spark):
    first = sm.settle(memory_rows(spark, [daily(i) for i in range(4)]), DAY, NOW)
    later = [daily(i, id=f"late{i}") for i in range(10, 13)]
    second = sm.settle(first.hot.unionByName(memory_rows(spark, later)), DAY, NOW)
    (one,), (two,) = first.merged.collect(), second.merged.collect()
    edges = sm.lineage_edges(first.archived.unionByName(second.archived))
    assert one.id == two.id and ids(edges) == [*(f"late{i}" for i in range(10, 13)), *(f"m{i:03d}" for i in range(4))]


def test_lineage_is_followed_to_the_last_summary(spark):
    chain = [(f"s{i}", f"s{i + 1}") for i in range(20)] + [("a", "s0"), ("b", "s0"), ("c", "s7"), ("d", "other"), ("e", None)]
    edges = sm.lineage_edges(spark.createDataFrame(chain, "id string, merged_into string"))
    last = {r.id: (r.merged_into, r.steps) for r in sm.last_summaries(edges).collect()}
    assert last["a"] == ("s20", 21) and last["c"] == ("s20", 14) and last["s19"] == ("s20", 1) and "e" not in last
    assert {(r.summary, r.id) for r in sm.originals(edges).collect()} == {("s20", "a"), ("s20", "b"), ("s20", "c"), ("other", "d")}
    with pytest.raises(ValueError):
        sm.last_summaries(spark.createDataFrame([("x", "y"), ("y", "x")], "id string, merged_into string"), 5)
    assert sm.originals(edges.limit(0)).isEmpty()


def test_a_summary_merged_too_often_is_rebuilt_from_the_archive(spark):
    """What is rebuilt is what merging all members at once gives; a memory that was never built stays merged."""
    first = sm.settle(memory_rows(spark, [daily(i, content=f"word{i} {'ab' * i}.") for i in range(8)]), DAY, NOW)
    hot, archive = sm.stage(first.hot, "h"), sm.stage(first.archived, "a")
    late = memory_rows(spark, [daily(i, id=f"z{i}", content=f"late{i} {'cd' * i}.") for i in range(4)])
    raw = memory_rows(spark, [daily(i, user=2, id=f"q{i}") for i in range(12)] + [daily(50, user=2, id="raw", tier="monthly", content="was here", day=datetime(2024, 1, 1))])
    (again, other) = sorted(sm.settle(hot.unionByName(late).unionByName(raw), DAY, NOW, archive=archive).merged.collect(), key=lambda r: r.user_id)
    (once,) = sm.settle(memory_rows(spark, [daily(i, content=f"word{i} {'ab' * i}.") for i in range(8)] + [daily(i, id=f"z{i}", content=f"late{i} {'cd' * i}.") for i in range(4)]), DAY, NOW).merged.collect()
    assert (again.id, again.content, again.topics, again.importance, again.merge_count) == (first.merged.first().id, once.content, once.topics, once.importance, 1)
    assert other.id == "raw" and other.content.startswith("was here")


def test_only_due_rows_are_read_and_settle_alike(spark, tmp_path):
    rows = [daily(i, day=datetime(2024, 1 + i % 6, 1 + i % 28), base_importance=(i % 50) / 50, access_count=i % 9, id=f"d{i}", tier=[None, "daily", "monthly"][i % 3], user=1 + i % 4) for i in range(300)]
    rows += [daily(0, created_at=None, base_importance=b, id=f"n{b}") for b in (0.0, 0.2, 0.9)] + [daily(0, day=datetime(2025, 1, 1), base_importance=0.1, id="future")]
    sm.write_memories(memory_rows(spark, rows), str(tmp_path / "m"))
    table = sm.read_memories(spark, str(tmp_path / "m"))
    for rule in (DAY, MONTH):
        due = sm.read_due(spark, str(tmp_path / "m"), rule, NOW)
        plan = due._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(due_at" in plan.split("PushedFilters:")[1]
        a, b = sm.settle(table, rule, NOW, due=due), sm.settle(table, rule, NOW)
        assert ids(a.archived) == ids(b.archived) and ids(a.hot) == ids(b.hot) and len(ids(a.archived)) > 5
        assert 0 < due.count() < table.count()


def test_the_model_reads_members_in_order_however_they_are_dealt(spark):
    """The same texts for any number of partitions, just under, at and over the sizes that once changed the packing."""
    def texts_of(n, partitions):
        seen = []

        def noting(df):
            seen.append(sorted((r.user_id, r.text) for r in df.collect()))
            return df.withColumn("raw", F.to_json(F.struct(F.substring("text", 1, 40).alias("summary"))))

        rows = [daily(i, content=f"w{i} " + "x" * (i % 50), day=datetime(2024, 1, 1 + i % 28), id=f"r{i:05d}") for i in range(n)]
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            sm.settle(memory_rows(spark, rows), DAY, NOW, reducer=sm.model_reducer(noting, 20000)).merged.collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        return seen

    for n, others in ((999, (8,)), (5000, (16,))):
        want = texts_of(n, 1)
        shown = [m for _, t in sorted(want[0], key=lambda x: int(re.search(r"w(\d+)", x[1])[1]) % 28) for m in re.findall(r"- w(\d+)", t)]
        assert sorted(map(int, shown)) == list(range(n))
        for _, text in want[0]:
            days = [int(m) % 28 for m in re.findall(r"- w(\d+)", text)]
            assert days == sorted(days)
        assert all(texts_of(n, p) == want for p in others)


def test_nearest_pairs_are_matched_first(spark):
    from sparkmem.operators.tables import one_to_one

    pairs = [(1, "a", "x", 0.1), (1, "b", "x", 0.05), (1, "a", "y", 0.2), (1, "c", "y", 0.2), (2, "a", "x", 0.3), (1, "c", "z", 0.9), (1, "d", "x", 0.05)]
    got = one_to_one(spark.createDataFrame(pairs, "user_id long, period string, id string, distance double")).collect()
    assert sorted(tuple(r) for r in got) == [(1, "a", "y"), (1, "b", "x"), (1, "c", "z"), (2, "a", "x")]
    assert one_to_one(spark.createDataFrame([], "user_id long, period string, id string, distance double")).isEmpty()


def test_known_texts_do_not_reach_the_embedder_again(spark, tmp_path):
    asked = []

    def counting(df, text, out):
        asked.append(sorted(r[0] for r in df.select(text).collect()))
        return sm.hashing_embedder(16)(df, text, out)

    embed = sm.remembering_embedder(counting, str(tmp_path / "v"), "m")
    first = embed(spark.createDataFrame([("a b",), ("c",), ("a b",), (None,)], "t string"), "t", "v")
    assert first.count() == 4 and asked == [["", "a b", "c"]]
    second = embed(spark.createDataFrame([("c", 1), ("d", 2), ("a b", 3)], "t string, _key int"), "t", "v").collect()
    assert asked[1:] == [["d"]] and {r._key for r in second} == {1, 2, 3}
    plain = {r.t: r.v for r in sm.hashing_embedder(16)(spark.createDataFrame([("c",), ("d",), ("a b",)], "t string"), "t", "v").collect()}
    assert {r.t: r.v for r in second} == plain
    sm.remembering_embedder(counting, str(tmp_path / "v"), "other")(spark.createDataFrame([("c",)], "t string"), "t", "v")
    assert asked[2:] == [["c"]]


def test_several_updates_of_one_memory_give_one_row(spark):
    table = memory_rows(spark, [daily(1), daily(2)])
    name = daily(1)["id"]
    updates = spark.createDataFrame([(name, 3, "positive"), (name, 5, None), ("other", 9, None)], "id string, access_count int, sentiment string")
    got = {r.id: (r.access_count, r.sentiment) for r in sm.update_metadata(table, updates).collect()}
    assert len(got) == 2 and got[name] == (5, "positive")


def test_model_reducer_shows_every_member_to_the_model(spark):
    """The model keeps the words it was shown, so the final summary must name every member."""

    def reply(texts):
        import re

        return [json.dumps({"summary": " ".join(sorted(set(re.findall(r"w\d+", t)))), "topics": ["merged"], "importance": 0.6})
                for t in texts]

    rows = [daily(i, content=f"w{i} " + "x" * 100, day=datetime(2024, 1, 1 + i % 28), id=f"r{i:04d}") for i in range(300)]
    rows += [daily(i, user=2, content=f"w{i}", id=f"s{i}") for i in range(3)]
    reducer = sm.model_reducer(sm.model_summarizer(reply), max_chars=2000)
    s = sm.settle(memory_rows(spark, rows), DAY, NOW, reducer=reducer)
    got = {r.user_id: r for r in s.merged.collect()}
    assert got[1].content.split() == sorted(f"w{i}" for i in range(300)) and got[1].importance == 0.6
    assert got[2].content == "w0 w1 w2" and got[1].topics == ["merged"]


def test_an_unusable_reply_leaves_its_group_hot_and_no_other(spark):
    def reply(texts):
        return ["[]" if "broken" in t else '{"summary": "fine"}' for t in texts]

    reducer = sm.model_reducer(sm.model_summarizer(reply))
    target = daily(90, user=2, tier="monthly", id="kept", content="broken", day=datetime(2024, 1, 1))
    rows = [daily(i, id=f"g{i}") for i in range(3)] + [daily(i, user=2, id=f"b{i}") for i in range(3)] + [target]
    s = sm.settle(memory_rows(spark, rows), DAY, NOW, reducer=reducer)
    assert [(r.user_id, r.content) for r in s.merged.collect()] == [(1, "fine")]
    assert sorted(r.id for r in s.hot.where("user_id = 2").collect()) == ["b0", "b1", "b2", "kept"]
    assert sorted(r.id for r in s.archived.collect()) == ["g0", "g1", "g2"]
    assert [(r.user_id, r.n_low) for r in s.unsettled.collect()] == [(2, 3)]


def test_the_model_sees_all_fields_and_which_text_is_the_existing_summary(spark):
    def reply(texts):
        return [json.dumps({"summary": t}) for t in texts]

    rows = [daily(i, id=f"m{i}", content=f"c{i}", topics=["t"], key_facts=[f"f{i}"], sentiment="calm") for i in range(3)]
    rows.append(daily(9, id="old", tier="monthly", content="before", day=datetime(2024, 1, 1)))
    s = sm.settle(memory_rows(spark, rows), DAY, NOW, reducer=sm.model_reducer(sm.model_summarizer(reply)))
    text = s.merged.first().content
    assert text.startswith("- [existing summary] before\n") and text.count("existing") == 1
    for i in range(3):
        assert f"- c{i}\n  topics: t\n  key facts: f{i}\n  importance: " in text
    assert text.count("  sentiment: calm") >= 3


def test_late_members_never_reuse_the_id_of_an_archived_summary(spark):
    """A month settles into its year; late days of that month settle again under an id of their own."""
    month = sm.settle(memory_rows(spark, [daily(i, id=f"a{i}") for i in range(3)]), DAY, NOW)
    (first,) = [r.id for r in month.merged.collect()]
    late = sm.settle(memory_rows(spark, [daily(i, id=f"z{i}") for i in range(3)]), DAY, NOW)
    (second,) = [r.id for r in late.merged.collect()]
    assert first != second
    assert {r.merged_into for r in month.archived.collect()} == {first} and {r.merged_into for r in late.archived.collect()} == {second}


def test_session_end_flushes_ages_and_settles_both_steps(spark):
    old = [daily(i, day=datetime(2023, 1 + i // 3, 1 + i % 3), base_importance=0.5, id=f"o{i}") for i in range(6)]
    rounds = spark.createDataFrame(
        [(1, "c", f"r{i}", f"Question {i}.", "answer", datetime(2024, 6, 30, 0, i)) for i in range(12)]
        + [(1, "d", "r99", "Single.", "", datetime(2024, 6, 30))],
        "user_id long, conv_id string, round_id string, user_text string, assistant_text string, ts timestamp")
    out = sm.session_end(memory_rows(spark, old), rounds, NOW)
    hot = out.hot.collect()
    by_tier = sorted(r.tier for r in hot)
    # Two months of three days each become months and, both faded already, one year in the same run.
    assert by_tier == ["daily", "daily", "yearly"]
    assert sorted((r.id[0], r.tier) for r in out.archived.collect() if r.id[0] == "o") == [("o", "daily")] * 6
    assert out.archived.where("tier = 'monthly'").count() == 2
    assert [r.round_id for r in out.remembered.leftover.collect()] == ["r99"]


def test_rebuild_finds_all_originals(spark):
    m = memory_rows(spark, [daily(i) for i in range(12)])
    first = sm.settle(m, DAY, NOW)
    hot, archive = sm.stage(first.hot, "h"), sm.stage(first.archived, "a")
    more = hot.unionByName(memory_rows(spark, [daily(i + 20, day=datetime(2024, 1, 15)) for i in range(3)]))
    groups = sm.settlement_groups(more, DAY, NOW)
    plan = sm.merge_plan(groups, more, archive, DAY, NOW)
    (p,) = plan.collect()
    assert (p.raw, p.merges, p.plan) == (15, 1, "rebuild")
    rebuilt = extractive_reducer()(sm.rebuild_members(plan, archive)).first()
    assert rebuilt.summary == "\n".join(f"content {i}" for i in range(12))


def test_decay_of_memories_with_missing_parts(spark):
    rows = [daily(0, base_importance=0.0, importance=0.7, day=datetime(2024, 7, 1)),
            daily(1, base_importance=None, importance=None, day=datetime(2024, 7, 1)), daily(2, created_at=None)]
    got = {r.id: r.importance for r in sm.decay(memory_rows(spark, rows), NOW).collect()}
    assert got == {"m000": 0.7, "m001": 0.5, "m002": 0.4}
    assert sm.decay_changes(memory_rows(spark, rows), NOW).first().changed == 2


def test_forget_keeps_rows_it_cannot_judge(spark):
    rows = [daily(0, importance=0.1), daily(1, importance=0.3), daily(2, importance=None), daily(3, importance=0.1, day=datetime(2024, 6, 20))]
    kept, dropped = sm.forget(memory_rows(spark, rows), NOW)
    assert ids(kept) == ["m001", "m002", "m003"] and dropped.first().dropped == 1


def test_a_summary_is_the_target_of_one_group_only(spark):
    embed = sm.hashing_embedder(64)
    rows = [daily(i, content="alpha beta", day=datetime(2024, 1 + i // 3, 1 + i % 3)) for i in range(6)]
    rows.append(daily(30, tier="monthly", day=datetime(2023, 11, 1), content="alpha beta", id="a030"))
    m = memory_rows(spark, rows)
    m = embed(m.drop("embedding"), "content", "embedding").select(*m.columns)
    s = sm.settle(m, DAY, NOW, embedder=embed, semantic_target=True)
    made = {r.session_id: r.id for r in s.merged.collect()}
    assert made["settle-2024-01"] == "a030" != made["settle-2024-02"]
    assert len(ids(s.hot)) == len(set(ids(s.hot))) == 2


def test_plans_shuffle_only_what_settles(spark, tmp_path):
    path = str(tmp_path / "m")
    sm.write_memories(memories(spark, SF), path)
    m = sm.read_memories(spark, path)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(sm.decay(m, NOW)) and "Python" not in plan(sm.decay(m, NOW))
    hot = plan(sm.settle(m, DAY, NOW).hot)
    assert "CartesianProduct" not in hot and "Nested" not in hot and "MapInArrow" not in hot
    assert hot.count("BroadcastExchange") >= 2  # groups and targets: written tables of known size
    recent = plan(sm.recent(m.drop("content", "embedding"), 20))
    assert recent.count("WindowGroupLimit") >= 2
