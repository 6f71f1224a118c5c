"""The stages of the pipeline and what they share: clashing names, given shares, labels that are held out, the whole run."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkmem.llm import decontamination, neardup, packing, toxicity

WORDS = "the of and river stone morning paper quiet garden window seven blue sudden letter walk under".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[rng.integers(len(WORDS))]}{rng.integers(40)}" for _ in range(n))


def test_columns_of_any_name_pass_the_removing_stages(spark):
    rows = [(i, prose(i, 60), 1, "h", b"x", 2.0) for i in range(8)] + [(9, prose(3, 60), 5, "i", b"y", 3.0), (None, None, 6, "j", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id int, _h string, _hash binary, __h double")
    items = spark.createDataFrame([(1, prose(5, 60)[40:180])], "item_id long, text string")
    clean = decontamination.without_contaminated(docs, items)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert clean.columns == docs.columns and ids(clean) == {None, 0, 1, 2, 3, 4, 6, 7, 9}
    single = neardup.without_near_duplicates(docs)
    assert single.columns == docs.columns and ids(single) == {None, *range(8)}
    assert {r._hash for r in single.collect()} == {b"x", None}


def test_given_shares_fill_every_window(spark):
    """While all sources last, each window holds them in the asked proportions, up to a packet of each."""
    rows = [(i, prose(i, 60), "en", ("a", "b", None)[i % 3], 1) for i in range(120)]
    docs = spark.createDataFrame(rows, SCHEMA)
    shares = spark.createDataFrame([("a", 3.0), ("b", 2.0), (None, 1.0)], "_source string, _share double")
    got = packing.packed(docs, length=64, window=768, shares=shares).toPandas()
    got["place"] = got.sequence_id * 64 + got.offset
    total = got.groupby(got.source.fillna(""))["length"].sum()
    lasting = min(total[s] / w for s, w in (("a", 3 / 6), ("b", 2 / 6), ("", 1 / 6)))
    for window in range(int(lasting // 768) - 1):
        inside = got[(got.place >= window * 768) & (got.place < (window + 1) * 768)]
        held = inside.groupby(inside.source.fillna(""))["length"].sum()
        for source, share in (("a", 3 / 6), ("b", 2 / 6), ("", 1 / 6)):
            assert abs(held.get(source, 0) - share * 768) <= 3 * 64
    assert lasting > 4 * 768 and got.groupby("doc_id").length.sum().eq(got.groupby("doc_id").doc_tokens.first()).all()


@pytest.mark.parametrize("shares", [[("a", 0.0)], [("a", None)], [("a", -1.0)], [("a", 1.0), ("a", 2.0)], [("a", float("nan"))]])
def test_shares_that_cannot_be_are_refused(spark, shares):
    docs = spark.createDataFrame([(1, "text", "en", "a", 1)], SCHEMA)
    with pytest.raises(ValueError):
        packing.packed(docs, shares=spark.createDataFrame(shares, "_source string, _share double"))


def test_held_out_labels_teach_nothing(spark):
    vile = lambda i: prose(i, 40) + (" vile rotten fool" * 3 if i % 4 == 0 else "")
    docs = spark.createDataFrame([(i, vile(i)) for i in range(400)], "doc_id long, text string")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    true = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("toxic"))
    false = true.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.fit_toxicity(docs, labels) for labels in (true, false))
    assert np.array_equal(a.units, b.units) and np.allclose(a.weights, b.weights)
    got = toxicity.score_toxicity(docs, a).where(held).collect()
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in got]) > 0.95


def test_the_whole_pipeline_on_planted_documents(spark, tmp_path):
    """Toxic, copied and contaminated documents go, personal data are replaced, and every clean document is packed whole."""
    rng = np.random.default_rng(0)
    plain = [(i, prose(i, 80)) for i in range(60)]
    toxic = [(100 + i, prose(100 + i, 50) + " vile rotten fool" * 6) for i in range(40)]
    copies = [(200 + i, prose(i, 80)) for i in range(10)] + [(220 + i, prose(i, 80) + " end") for i in range(10, 20)]
    leaked = [(300 + i, f"{prose(300 + i, 30)} {prose(999, 24)} {prose(400 + i, 30)}") for i in range(5)]
    private = [(500, prose(500, 40) + " write to Mary Miller at m.miller@mail.org")]
    odd = [(600, None), (601, ""), (None, prose(601, 50))]
    rows = [(i, t, "en", f"s{rng.integers(3)}", len(t or "")) for i, t in plain + toxic + copies + leaked + private + odd]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in plain] + [(i, 0, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 24))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path)).persist()
        seen[name] = docs
    ids = lambda df: sorted((r.doc_id for r in df.select("doc_id").distinct().collect()), key=lambda x: (x is None, x))
    clean = [i for i, _ in plain]
    assert not set(ids(seen["toxicity"])) & {i for i, _ in toxic} and set(clean) <= set(ids(seen["toxicity"]))
    assert not set(ids(seen["near_duplicates"])) & {i for i, _ in copies} and set(clean) <= set(ids(seen["near_duplicates"]))
    assert not set(ids(seen["decontamination"])) & {i for i, _ in leaked}
    text = seen["personal_data"].where("doc_id = 500").first().text
    assert "Miller" not in text and "m.miller@mail.org" not in text and text.startswith(prose(500, 40))
    packed = seen["packing"]
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert all(r.n == r.of for r in whole if r.doc_id is not None) and {*clean, 500} <= {r.doc_id for r in whole}
    assert all(seen[n].columns == seen["toxicity"].columns for n in ("near_duplicates", "decontamination", "personal_data"))
