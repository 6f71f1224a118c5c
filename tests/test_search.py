import numpy as np
import pytest
from pyspark.sql import functions as F

import sparkmem as sm
from registry.inputs import NOW, memories, prompts, table
from sparkmem.operators import search

from .conftest import SF, memory_rows


def brute_force(asked, stored, k, floor=None):
    """(query_id, rank) → (id, cosine) by plain comparison of every pair of a user."""
    unit = lambda v: np.asarray(v, float) / (np.linalg.norm(v) or 1.0)
    out = {}
    for q in asked:
        near = [(-round(float(unit(q.q_embedding) @ unit(m.embedding)), 10), m.id) for m in stored
                if m.user_id == q.user_id and m.embedding is not None]
        near = sorted(x for x in near if floor is None or -x[0] >= floor)[:k]
        out.update({(q.query_id, i + 1): (id, -c) for i, (c, id) in enumerate(near)})
    return out


def result(df):
    return {(r.query_id, r["rank"]): (r.id, r.cosine) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == want[key][0], key
        assert abs(got[key][1] - want[key][1]) < 2e-10


@pytest.fixture(scope="module")
def crowd(spark):
    """Half the memories are copies of one vector; one is zero, one has none."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 8)).tolist()
    rows = [{"id": f"m{i:03d}", "user_id": i % 2, "embedding": base[i % 40], "importance": (i % 10) / 10} for i in range(80)]
    rows += [{"id": f"copy{i:03d}", "user_id": 0, "embedding": base[0], "importance": 0.5} for i in range(90)]
    rows += [{"id": "zero", "user_id": 0, "embedding": [0.0] * 8}, {"id": "none", "user_id": 0}]
    m = sm.stage(memory_rows(spark, rows), "crowd").repartition(5)
    q = spark.createDataFrame([(i, i % 2, base[i]) for i in range(30)] + [(99, 7, base[0])],
                              "query_id long, user_id long, q_embedding array<float>")
    return q, m, rows


@pytest.mark.parametrize("few", [True, False])
@pytest.mark.parametrize("k,floor", [(7, None), (120, None), (20, 0.58), (5, 1.1)])
def test_scan_and_grid_equal_brute_force(spark, crowd, monkeypatch, few, k, floor):
    monkeypatch.setattr(search, "MEMORY_BLOCK", 16)
    monkeypatch.setattr(search, "QUERY_BLOCK", 4)
    q, m, _ = crowd
    same(result(sm.knn(q, m, k, min_cosine=floor, few_prompts=few)), brute_force(q.collect(), m.collect(), k, floor))


def test_grid_cells_stay_small_for_a_hot_user(spark, crowd, monkeypatch):
    """The blocks of the user who owns most rows are of bounded size and cover each pair once."""
    monkeypatch.setattr(search, "MEMORY_BLOCK", 16)
    q, m, rows = crowd
    hits = sm.knn(q, m, 1000)
    stored = sum(1 for r in rows if r["user_id"] == 0 and r.get("embedding"))
    per_query = hits.where("query_id % 2 = 0").groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    assert {(r.n, r.d) for r in per_query.collect()} == {(stored, stored)}


def test_filter_applies_before_the_cut_and_importance_after_it(spark, crowd):
    q, m, _ = crowd
    kept = m.where("importance >= 0.5")
    same(result(sm.knn(q, m, 5, where={"importance": {"$gte": 0.5}})), brute_force(q.collect(), kept.collect(), 5))
    after = result(sm.knn_min_importance(q, m, 5, 0.55))
    wide = brute_force(q.collect(), m.collect(), 10)
    importance = {r.id: r.importance for r in m.collect()}
    for query in {k[0] for k in wide}:
        left = [i for (n, _), (i, _) in sorted(wide.items()) if n == query and (importance[i] or 0) >= 0.55][:5]
        assert left == [after[(query, r + 1)][0] for r in range(len(left))] and (query, len(left) + 1) not in after


def test_approximate_search_finds_most_and_all_when_it_looks_everywhere(spark):
    v = sm.stage(table(spark, SF, "embeddings"), "v")
    m = v.select(F.concat(F.lit("m"), "vec_id").alias("id"), F.lit(1).cast("long").alias("user_id"), "embedding")
    q = v.select(F.col("vec_id").alias("query_id"), F.lit(1).cast("long").alias("user_id"), F.col("embedding").alias("q_embedding"))
    exact = sm.stage(sm.knn(q, m, 10).select("query_id", "id"), "exact")
    total = exact.count()
    found = sm.knn_approx(q, m, 10, lists=16, probes=12).join(exact, ["query_id", "id"], "left_semi").count()
    assert found / total >= 0.9
    everywhere = sm.knn_approx(q, m, 10, lists=4, probes=4).select("query_id", "id")
    assert everywhere.exceptAll(exact).isEmpty() and everywhere.count() == total


def test_approximate_search_finds_k_wherever_k_exist(spark, crowd):
    q, m, rows = crowd
    owned = {u: sum(1 for r in rows if r["user_id"] == u and r.get("embedding")) for u in (0, 1)}
    found = sm.knn_approx(q, m, 50, lists=16, probes=1).groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("d"))
    got = {r.query_id: (r.n, r.d) for r in found.collect()}
    assert got == {i: (min(50, owned[i % 2]),) * 2 for i in range(30)}


def test_approximate_search_learns_clusters_and_looks_into_few_lists(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 32))
    x = centres[rng.integers(40, size=6000)] + 0.15 * rng.normal(size=(6000, 32))
    v = sm.stage(spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "n long, e array<float>"), "v")
    user = F.lit(1).cast("long").alias("user_id")
    m = v.select(F.concat(F.lit("m"), "n").alias("id"), user, F.col("e").alias("embedding"))
    q = v.where("n % 20 = 0").select(F.col("n").alias("query_id"), user, F.col("e").alias("q_embedding"))
    vectors, asked = search._vectors(m, "embedding"), search._vectors(q, "q_embedding")
    centroids, probes = search._trained(vectors, asked, 10, 64, 0.95, 7)
    assert list(centroids) == [32] and centroids[32].shape == (64, 32) and probes <= 8
    exact = sm.stage(sm.knn(q, m, 10).select("query_id", "id"), "exact")
    found = sm.knn_approx(q, m, 10)
    assert found.join(exact, ["query_id", "id"], "left_semi").count() >= 0.9 * exact.count() and found.count() == exact.count()
    # Without clusters more lists are looked into, and as much is found.
    r = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=32)]) for i in range(800)], "n long, e array<float>")
    m, q = r.select(F.concat(F.lit("m"), "n").alias("id"), user, F.col("e").alias("embedding")), r.select(F.col("n").alias("query_id"), user, F.col("e").alias("q_embedding"))
    assert search._trained(search._vectors(m, "embedding"), search._vectors(q, "q_embedding"), 10, 64, 0.95, 7)[1] > 16
    assert sm.knn_approx(q, m, 10).select("query_id", "id").intersect(sm.knn(q, m, 10).select("query_id", "id")).count() >= 0.9 * 8000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cross_join_and_cut_before_the_shuffle(spark, crowd):
    q, m, _ = crowd
    for few in (True, False):
        text = plan(sm.knn(q, m, 5, few_prompts=few))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert text.count("WindowGroupLimit") >= 2


def test_scan_reads_only_the_users_who_ask(spark, tmp_path):
    path = str(tmp_path / "m")
    sm.write_memories(memories(spark, SF), path)
    text = plan(sm.knn(prompts(spark, SF).where("user_id = 4"), sm.read_memories(spark, path), 3, few_prompts=True))
    assert "EqualTo(user_id,4)" in text or "In(user_id, [4])" in text


@pytest.mark.parametrize("few", [True, False])
def test_vectors_of_another_length_and_users_unknown_do_not_match(spark, few):
    rows = [{"id": "two", "user_id": 1, "embedding": [1.0, 0.0]}, {"id": "four", "user_id": 1, "embedding": [1.0, 0.0, 0.0, 0.0]},
            {"id": "six", "user_id": 1, "embedding": [1.0] * 6}, {"id": "nobody", "embedding": [1.0, 0.0, 0.0, 0.0]}]
    m = memory_rows(spark, rows).repartition(1)
    q = spark.createDataFrame([("a", 1, [1.0, 0.0, 0.0, 0.0]), ("b", 1, [0.0, 1.0]), ("c", None, [1.0, 0.0])],
                              "query_id string, user_id long, q_embedding array<float>")
    want = {("a", 1): "four", ("b", 1): "two"}
    assert {k: v[0] for k, v in result(sm.knn(q, m, 3, few_prompts=few)).items()} == want
    if not few:
        assert {k: v[0] for k, v in result(sm.knn_approx(q.where("query_id <> 'c'"), m, 3, lists=2, probes=2)).items()} == want


def test_more_prompts_than_a_closure_takes_are_refused(spark, crowd, monkeypatch):
    q, m, _ = crowd
    monkeypatch.setattr(search, "SMALL_QUERIES", 30)
    with pytest.raises(ValueError, match="at most 30"):
        sm.knn(q, m, 3, few_prompts=True)


def test_recall_checklist(spark):
    """A greeting-like prompt recalls and changes nothing; an exact one finds its memory."""
    rows = [{"id": f"m{i}", "user_id": 1, "content": f"c{i}", "embedding": [float(i == j) for j in range(4)],
             "base_importance": 0.8, "access_count": 2, "topics": ["t"]} for i in range(3)]
    m = memory_rows(spark, rows).withColumn("created_at", F.to_timestamp(F.lit("2024-06-30")))
    q = spark.createDataFrame([("greeting", 1, [0.0, 0.0, 0.0, 1.0]), ("exact", 1, [0.0, 2.0, 0.0, 0.0]), ("again", 1, [0.0, 1.0, 0.0, 0.1])],
                              "query_id string, user_id long, q_embedding array<float>")
    out = sm.recall(q, m, NOW)
    assert sorted((r.query_id, r.id) for r in out.hits.collect()) == [("again", "m1"), ("exact", "m1")]
    (u,) = out.updates.collect()
    assert (u.id, u.access_count) == ("m1", 4)
    after = {r.id: r for r in sm.update_metadata(m, out.updates).collect()}
    assert after["m1"].access_count == 4 and after["m0"].access_count == 2
    assert after["m1"].importance == u.importance and str(after["m1"].last_accessed) == NOW
    text = {r.query_id: r.context for r in sm.recall_context(out.hits).collect()}
    assert set(text) == {"exact", "again"} and text["exact"].startswith("[相关记忆]\n- [2024-06-30] c1 (主题：t) (0.6×1.00+")
    cut = sm.recall_context(out.hits, sm.RecallOptions(max_chars=10)).first().context
    assert cut.endswith("\n...(记忆已截断)") and len(cut) == 10 + len("\n...(记忆已截断)")


def test_every_hit_passes_both_bars(spark):
    opts = sm.RecallOptions(min_score=0.25, min_cosine=0.1, top_k=3)
    hits = sm.recall(prompts(spark, SF), memories(spark, SF), NOW, opts).hits
    assert hits.where("score < 0.25 or cosine < 0.1 or rank > 3").isEmpty() and not hits.isEmpty()


def test_letter_vectors_count_each_text_once(spark):
    """A filter on the vectors repeats nothing of what they are computed from."""
    from registry.queries import letter_embedder

    texts = spark.createDataFrame([(1, "Abba, a b"), (2, ""), (3, None)], "n int, t string")
    vectors = letter_embedder("ab")(texts, "t", "v")
    plan = vectors.where(F.col("v").isNotNull() & (F.size("v") > 0))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1
    found = {r.n: list(r.v) for r in vectors.collect()}
    assert np.allclose(found[1], [0.5 ** 0.5, 0.5 ** 0.5]) and found[2] == found[3] == [0.0, 0.0]


def test_candidates_are_ranked_without_their_texts(spark, monkeypatch):
    """Texts meet the hits that are left; rows of one id that say different things stay apart."""
    from sparkmem.plans import recall as plan

    carried = []
    monkeypatch.setattr(plan, "knn", lambda *a, carry, **more: carried.extend(carry) or search.knn(*a, carry=carry, **more))
    rows = [{"id": i, "user_id": 1, "content": c, "embedding": [1.0, 0.0], "base_importance": 0.5, "access_count": 0}
            for i, c in (("a", "x"), ("a", "y"), ("b", "z"))]
    asked = spark.createDataFrame([(1, 1, [1.0, 0.0])], "query_id long, user_id long, q_embedding array<float>")
    out = sm.recall(asked, memory_rows(spark, rows), NOW, sm.RecallOptions(min_score=0.0, min_cosine=0.0))
    assert sorted((r.id, r.content) for r in out.hits.collect()) == [("a", "x"), ("a", "x"), ("a", "y"), ("a", "y"), ("b", "z")]
    assert carried and not {"content", "topics"} & set(carried)
    assert {r.id: r.access_count for r in out.updates.collect()} == {"a": 4, "b": 1}
