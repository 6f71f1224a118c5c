import re

import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
import sparkmem as sm
from sparkmem.operators.corpus import chunk_corpus, pack_chunks

texts = st.text(alphabet="ab. \n", max_size=200)


@given(texts, st.integers(1, 30))
def test_chunks_keep_every_piece_in_order_and_respect_the_limit(text, limit):
    chunks = pack_chunks(text, limit)
    letters = lambda s: re.sub(r"[ \n]", "", s)
    assert letters("".join(chunks)) == letters(text)
    for c in chunks:
        pieces = c.split("\n\n")
        assert len(pieces) == 1 or sum(map(len, pieces)) <= limit or "" in pieces


def test_long_paragraphs_split_after_sentences_and_on_lines():
    assert pack_chunks("One. Two. Three\nfour\n\nfive", 10) == ["One.\n\nTwo.", "Three\n\nfour", "five"]
    assert pack_chunks("aaaa\n\nbbbb\n\ncc", 8) == ["aaaa\n\nbbbb", "cc"]
    assert pack_chunks("x" * 25, 10) == ["x" * 25]
    assert pack_chunks("", 10) == [""]


def test_chunk_corpus_reads_whole_notes(spark):
    long = "\n\n".join(f"paragraph {i} " + "w" * 90 for i in range(5000))
    df = spark.createDataFrame([("a.md", long), ("b.md", "short"), ("c.md", None)], "file_name string, content string")
    rows = chunk_corpus(df, 2000).orderBy("file_name", "pos").collect()
    a = [r.chunk for r in rows if r.file_name == "a.md"]
    assert "\n\n".join(a) == long and [r.pos for r in rows if r.file_name == "a.md"] == list(range(len(a)))
    assert [r.chunk for r in rows if r.file_name != "a.md"] == ["short", ""]


def test_ingest_counts_files_and_skips_what_is_excluded(spark):
    keep = "A useful note about the plan. It is long enough to be kept in memory."
    rows = [("a.md", keep), ("private.md", keep), ("c.md", keep + " My PassWord is here."), ("d.md", "   tiny   ")]
    notes = spark.createDataFrame(rows, "file_name string, content string")
    out = sm.ingest_notes(notes, "2024-07-01", file_names=("private.md",), patterns=("password",))
    assert tuple(out.totals.first()) == (4, 2, 1)
    files = {r.file_name: (r.excluded, r.imported) for r in out.files.collect()}
    assert files == {"a.md": (False, 1), "private.md": (True, 0), "c.md": (True, 0), "d.md": (False, 0)}
    m = out.memories.first()
    assert m.source == "manual" and m.content == "A useful note about the plan. It is long enough to be kept in memory." and m.session_id.startswith("manual-2024-07-01-")
    assert len(m.embedding) == 512 and abs(sum(x * x for x in m.embedding) - 1) < 1e-5


def test_reembed_uses_the_short_text(spark):
    m = spark.createDataFrame([("a", "content", ["t1", "t2"], ["f"]), ("b", "content", None, []), ("c", "t1 t2 f", None, None)],
                              "id string, content string, topics array<string>, key_facts array<string>")
    rows = {r.id: r for r in sm.reembed(m, sm.hashing_embedder(64)).collect()}
    assert rows["a"].embedding_text == "t1 t2 f" and rows["b"].embedding_text == "content"
    assert rows["a"].embedding == rows["c"].embedding != rows["b"].embedding


def test_python_workers_get_bounded_batches(spark):
    """Whatever the texts' size, a worker is given some 4 MB together, in every stage that has Python tasks."""
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(2000).coalesce(1).select(F.repeat(F.lit("long text "), 1000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    step = corpus_pipeline._in_small_batches(lambda spark, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
    got = [r.n for r in step(spark, docs, "").collect()]
    assert sum(got) >= 20_000_000 and max(got) < 2 * corpus_pipeline.BATCH_BYTES
    bounded = [name for name, stage in corpus_pipeline.STAGES if hasattr(stage, "__wrapped__")]
    assert bounded == ["toxicity", "near_duplicates", "personal_data", "packing"]
