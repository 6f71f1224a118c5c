"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import json
import uuid
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import sparkmem as sm
from sparkmem.functions import expr as X
from sparkmem.functions.binding import computed
from sparkmem.operators.conversation import with_batch_id
from sparkmem.operators.corpus import chunk_corpus
from sparkmem.operators.merging import extractive_reducer, leading_text
from sparkmem.plans.ingest import note_chunks
from sparkmem.plans.lifecycle import _as_members, _scored, _split
from sparkmem.plans.recall import score
from sparkmem.sources.staging import shared_dir

from .inputs import NOW, accesses, memories, notes, owner, prompts, replies, rounds, table, transcript_lines

# The test vectors are nearly orthogonal, so most queries use lower bars than the defaults.
LOW_BARS = sm.RecallOptions(min_score=0.2, min_cosine=0.2)
SHORT = sm.SummaryOptions(every=2)
FILES, PATTERNS = ("note3.md", "note7.md"), ("THE OF", "eaux la")


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _joined(c):
    return F.coalesce(F.array_join(c, "|"), F.lit(""))


def _flat(df: DataFrame) -> DataFrame:
    """A memory table in comparable form: no vector, arrays and times as text."""
    return df.select(
        "id", "user_id", "content", _joined("topics").alias("topics"), _joined("key_facts").alias("key_facts"),
        F.round("importance", 4).alias("importance"), F.round("base_importance", 4).alias("base_importance"),
        "sentiment", "source", "tier", "access_count", _stamp("last_accessed").alias("last_accessed"),
        _stamp("created_at").alias("created_at"), "session_id", _joined("parent_ids").alias("parent_ids"),
        "merge_count",
    )


def memories_scan(spark, d):
    return _flat(memories(spark, d))


def effective_importance(spark, d):
    eff = X.effective_importance("base_importance", "access_count", "created_at", NOW)
    return memories(spark, d).select("id", eff.alias("effective"))


def parse_created(spark, d):
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 180).cast("int")), "yyyy-MM-dd")
    text = (
        F.when(n % 6 == 0, day)
        .when(n % 6 == 1, F.concat(day, F.lit("T10:20:30Z")))
        .when(n % 6 == 2, F.concat(day, F.lit("T10:20:30+02:00")))
        .when(n % 6 == 3, F.concat(day, F.lit(" 10:20:30")))
        .when(n % 6 == 4, F.substring(day, 1, 7))
        .otherwise(F.col("lang"))
    )
    return table(spark, d, "documents").select("doc_id", _stamp(X.parse_created(text, NOW)).alias("created_at"))


def strip_tool_calls(spark, d):
    text = F.concat(
        F.lit("<tool_use>\n"), "text", F.lit("\n</tool_use>\n\n\n\n"), "text",
        F.lit("<command-name>x</command-name> <tool-response>"), "text", F.lit("</tool-response>\n"),
    )
    return table(spark, d, "conversations").select("conv_id", "turn", X.strip_tool_calls(text).alias("clean"))


def truncate_marked(spark, d):
    return table(spark, d, "documents").select("doc_id", X.truncate_marked("text", 2000, "\n...").alias("cut"))


def period_keys(spark, d):
    return memories(spark, d).select(
        "id", X.period_key("created_at", "month", NOW).alias("month"), X.period_key("created_at", "year", NOW).alias("year")
    )


def null_empty(spark, d):
    m = memories(spark, d).select(
        "id", F.when(F.col("access_count") % 2 == 0, "").otherwise(F.col("sentiment")).alias("sentiment"),
        F.filter("topics", lambda t: t != "en").alias("topics"),
        F.filter("topics", lambda t: t == "xx").alias("none"),
    )
    out = X.null_empty(m)
    return out.select("id", "sentiment", F.size("topics").alias("n_topics"), F.col("none").isNull().alias("none_is_null"))


def vector_functions(spark, d):
    """Cosine to the mirrored vector and the length after normalizing, all in the JVM."""
    v = table(spark, d, "embeddings").withColumn("mirror", F.reverse("embedding"))
    unit = X.l2_normalize("mirror")
    length = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    return v.select("vec_id", F.round(X.cosine("embedding", "mirror"), 8).alias("cosine"), F.round(length, 6).alias("length"))


def memory_lines(spark, d):
    line = X.memory_line("created_at", "importance", "access_count", "base_importance", "content")
    return memories(spark, d).select("id", line.alias("line"))


def new_ids(spark, d):
    return memories(spark, d).select("id", X.new_id("mem-", "user_id", "id").alias("made"),
                                     X.new_id("mem-", "id", digits=12).alias("short"))


def input_caps(spark, d):
    return memories(spark, d).select("id", F.size(X.capped(F.split("content", " "), 5)).alias("words"),
                                     _joined(X.capped("topics", 1)).alias("topics"))


def where_metadata(spark, d):
    m = sm.where_metadata(memories(spark, d), {"tier": {"$in": ["daily", "yearly"]}, "importance": {"$gte": 0.3},
                                               "$or": [{"sentiment": "positive"}, {"access_count": {"$gt": 6}}]})
    return m.select("id", "tier", "importance")


def by_tier_and_period(spark, d):
    return sm.by_tier_and_period(memories(spark, d), "daily", "2024-05").select("id", _stamp("created_at").alias("created_at"))


def min_importance(spark, d):
    return sm.min_importance(memories(spark, d)).select("id", "importance")


def exclude_notes(spark, d):
    return sm.exclude_notes(notes(spark, d), FILES, PATTERNS).select("file_name", F.length("content").alias("chars"))


def long_enough(spark, d):
    return sm.long_enough(table(spark, d, "documents"), "text", 50).select("doc_id")


def expire(spark, d):
    return sm.expire(memories(spark, d), NOW, 100).select("id")


def forget(spark, d):
    return sm.forget(memories(spark, d), NOW)[0].select("id", "importance")


def forget_count(spark, d):
    return sm.forget(memories(spark, d), NOW)[1]


def _hits(h):
    return h.select("query_id", "user_id", "id", "cosine",
                    F.round("distance", 10).alias("distance"), "rank")


def knn(spark, d):
    return _hits(sm.knn(prompts(spark, d), memories(spark, d), 10))


def knn_where(spark, d):
    return _hits(sm.knn(prompts(spark, d), memories(spark, d), 3, where={"tier": "daily"}))


def knn_min_importance(spark, d):
    return _hits(sm.knn_min_importance(prompts(spark, d), memories(spark, d), 5))


def knn_approx(spark, d):
    return _hits(sm.knn_approx(prompts(spark, d), memories(spark, d), 10))


def knn_approx_all(spark, d):
    """The approximate search with all lists looked into, which is exact."""
    return _hits(sm.knn_approx(prompts(spark, d), memories(spark, d), 10, lists=16, probes=16))


def update_metadata(spark, d):
    tally = sm.access_tally(accesses(spark, d))
    updates = tally.select("id", F.col("hits").cast("int").alias("access_count"), F.col("last_hit").alias("last_accessed"),
                           F.when(F.col("hits") % 2 == 0, F.lit("")).otherwise("seen").alias("sentiment"))
    return _flat(sm.update_metadata(memories(spark, d), updates))


def _rows_to_upsert(spark, d):
    return table(spark, d, "conversations").select(
        F.concat(F.lit("mem-"), (F.col("conv_id") * 10 + F.col("turn")).cast("string")).alias("id"),
        F.col("text").alias("content"), F.lit("manual").alias("source"),
        F.when(F.col("role") == "user", F.lit("")).otherwise("neutral").alias("sentiment"),
    )


def upsert(spark, d):
    return _flat(sm.upsert(memories(spark, d), _rows_to_upsert(spark, d)))


def delete_ids(spark, d):
    return sm.delete_ids(memories(spark, d), accesses(spark, d)).select("id", "tier")


def find_merge_target(spark, d):
    m = memories(spark, d)
    groups = sm.settlement_groups(m, sm.DAILY_TO_MONTHLY, NOW)
    t = sm.find_merge_target(groups, m, "monthly", "month", NOW)
    return t.select("user_id", "period", F.col("target.id").alias("target_id"))


def letter_embedder(letters: str = "abcdefgh"):
    """How often each letter occurs, at unit length: vectors SQL can repeat."""
    def embed(df, text, out):
        # Each step comes out of a generator: a filter on the vector would repeat what it is computed from, per letter.
        said = F.lower(F.coalesce(F.col(text), F.lit("")))
        counts = lambda s: [F.array(*[(F.size(F.split(s, c)) - 1).cast("double") for c in letters]).alias("_counts")]
        df = computed(df.drop(out), said, counts)
        norm = F.sqrt(F.aggregate("_counts", F.lit(0.0), lambda a, x: a + x * x))
        over = lambda n: [F.transform("_counts", lambda x: x / F.when(n > 0, n).otherwise(1.0)).cast("array<float>").alias(out)]
        return computed(df, norm, over).drop("_counts")

    return embed


def find_merge_target_semantic(spark, d):
    """Targets by date, and for the other groups the nearest free monthly summary among their three nearest memories."""
    m = memories(spark, d)
    groups = sm.settlement_groups(m, sm.DAILY_TO_MONTHLY, NOW)
    # Written down without the texts, so that their letters are counted once however often the vectors are read.
    vectors = sm.stage(letter_embedder()(m, "content", "embedding").drop("content"), "letter-vectors")
    members = _scored(_split(m, sm.DAILY_TO_MONTHLY)[0], sm.DAILY_TO_MONTHLY, NOW, sm.DecayOptions())
    text = leading_text(_as_members(members.where(F.col("importance") < sm.DAILY_TO_MONTHLY.threshold)), 500, " ")
    text = text.withColumn("text", F.substring("text", 1, 500))
    t = sm.find_merge_target(groups, vectors, "monthly", "month", NOW, text, letter_embedder(), max_distance=0.9)
    return t.select("user_id", "period", F.col("target.id").alias("target_id"))


def settle_due(spark, d):
    """Settlement that reads only what is due from the written table: archived and merged rows."""
    path = _fresh(spark, "due")
    sm.write_memories(memories(spark, d), path)
    due = sm.read_due(spark, path, sm.DAILY_TO_MONTHLY, NOW)
    s = sm.settle(sm.read_memories(spark, path), sm.DAILY_TO_MONTHLY, NOW, due=due)
    return s.archived.select("id", "merged_into", "content").unionByName(s.merged.select("id", F.lit(None).cast("string").alias("merged_into"), "content"))


def settle_rebuild(spark, d):
    """Half of the memories settle, then the others, with the archive at hand: summaries merged too often or of too many are rebuilt."""
    m = _stored(spark, d)
    first = sm.settle(m.where("access_count % 2 = 0"), sm.DAILY_TO_MONTHLY, NOW)
    hot, archive = sm.stage(first.hot, "half-hot"), sm.stage(first.archived, "half-archive")
    both = hot.unionByName(m.where("access_count % 2 = 1"))
    return _flat(sm.settle(both, sm.DAILY_TO_MONTHLY, NOW, archive=archive).merged)


def reembed(spark, d):
    """Every vector replaced by that of the short text; equal texts reach the embedder once."""
    embed = sm.remembering_embedder(letter_embedder(), _fresh(spark, "vectors"), "letters")
    out = sm.reembed(memories(spark, d), embed)
    return out.select("id", *[F.round(F.col("embedding")[i].cast("double"), 4).alias(f"x{i}") for i in range(8)])


def stream_round_batches(spark, d):
    """All rounds as a stream: full batches, and short ones of conversations that went idle by its end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    logged, path, out = rounds(spark, d), _fresh(spark, "log"), _fresh(spark, "batches")
    logged.write.parquet(path)
    stream = sm.stream_round_batches(spark.readStream.schema(logged.schema).parquet(path), 2, idle_seconds=7200, delay="0 seconds")
    stream.writeStream.option("checkpointLocation", _fresh(spark, "stream")).trigger(availableNow=True).start(out, "parquet").awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select("user_id", "conv_id", "round_id", "round", "batch_no", "batch_size", "flush")


def settlement_groups(spark, d):
    return sm.settlement_groups(memories(spark, d), sm.DAILY_TO_MONTHLY, NOW)


def merge_members(spark, d):
    """Fold every faded daily row of a period, whatever the group size."""
    members = _scored(_split(memories(spark, d), sm.DAILY_TO_MONTHLY)[0], sm.DAILY_TO_MONTHLY, NOW, sm.DecayOptions())
    out = extractive_reducer()(_as_members(members.where("importance < 0.35")))
    return out.select("user_id", "period", "summary", _joined("topics").alias("topics"),
                      _joined("key_facts").alias("key_facts"), "sentiment", "importance")


def assemble_conversation(spark, d):
    t = sm.assemble_conversation(with_batch_id(sm.round_batches(rounds(spark, d), 2)))
    return t.select("user_id", "conv_id", "batch_no", "batch_size", "text")


def access_tally(spark, d):
    return sm.access_tally(accesses(spark, d)).select("id", "hits", _stamp("last_hit").alias("last_hit"))


def count_memories(spark, d):
    return sm.count_memories(memories(spark, d), ("user_id", "tier"))


def decay_changes(spark, d):
    return sm.decay_changes(memories(spark, d), NOW)


def round_batches(spark, d):
    b = sm.round_batches(rounds(spark, d), 2)
    return b.select("user_id", "conv_id", "round_id", "round", "batch_no", "batch_size", "flush")


def recent(spark, d):
    return sm.recent(memories(spark, d), 20).select("user_id", "id", "age_rank")


def pack_context(spark, d):
    return sm.pack_context(memories(spark, d))


def session_start(spark, d):
    return sm.session_start(memories(spark, d), NOW)


def rerank(spark, d):
    """Rank every access as a candidate of the memory's user: score, floor and cut without a search."""
    m = memories(spark, d)
    c = sm.access_tally(accesses(spark, d)).join(m, "id").withColumn("cosine", F.least(F.lit(1.0), 0.3 + F.col("hits") / 10.0))
    scored = score(c.withColumn("query_id", F.col("user_id")), NOW)
    return sm.rerank(scored).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _recall(spark, d, opts=LOW_BARS, stored=None):
    return sm.recall(prompts(spark, d), memories(spark, d) if stored is None else stored, NOW, opts)


def _stored(spark, d):
    """The memories written once, as a job that reads them several times keeps them."""
    return sm.stage(memories(spark, d), "memories")


def recall(spark, d, opts=LOW_BARS):
    return _recall(spark, d, opts, _stored(spark, d)).hits.select(
        "query_id", "user_id", "id", "content", "rank", F.round("cosine", 6).alias("cosine"),
        "effective", F.round("score", 6).alias("score"),
    )


def recall_default(spark, d):
    return recall(spark, d, sm.RecallOptions())


def recall_updates(spark, d):
    return _recall(spark, d).updates.withColumn("last_accessed", _stamp("last_accessed"))


def recall_context(spark, d):
    return sm.recall_context(_recall(spark, d, stored=_stored(spark, d)).hits, LOW_BARS)


def tier_weighted_rank(spark, d):
    near = sm.knn(prompts(spark, d), memories(spark, d), 20, carry=("base_importance", "access_count", "created_at", "tier"))
    ranked = sm.tier_weighted_rank(score(near, NOW), 5)
    return ranked.select("query_id", "id", F.round("tier_score", 5).alias("tier_score"), "rank")


def decay(spark, d):
    return _flat(sm.decay(memories(spark, d), NOW))


def _settle(spark, d, rule, part):
    s = sm.settle(_stored(spark, d), rule, NOW)
    if part == "hot":
        return _flat(s.hot)
    a = s.archived
    return a.select("id", "user_id", "period", "tier", "merged_into", F.round("importance", 4).alias("importance"),
                    _stamp("archived_at").alias("archived_at"))


def archive_lookup(spark, d):
    archived = sm.settle(_stored(spark, d), sm.DAILY_TO_MONTHLY, NOW).archived
    return sm.lookup_archive(archived, accesses(spark, d)).select("id", "content", "merged_into")


def archive_found(spark, d):
    """The same ids looked up through files: two runs written and indexed, and only the files the index names read."""
    archived = sm.settle(_stored(spark, d), sm.DAILY_TO_MONTHLY, NOW).archived
    path, index = _fresh(spark, "archive"), _fresh(spark, "index")
    for run, rows in (("even", archived.where("access_count % 2 = 0")), ("odd", archived.where("access_count % 2 = 1"))):
        sm.write_archive(rows, path, run)
        sm.write_archive_index(spark, path, index, run)
    return sm.find_archived(spark, path, index, accesses(spark, d)).select("id", "content", "merged_into")


def all_memories(spark, d):
    s = sm.settle(_stored(spark, d), sm.DAILY_TO_MONTHLY, NOW)
    return sm.all_memories(s.hot, s.archived).select("id", "user_id", "tier", "archived", "merged_into")


def summarize_batches(spark, d):
    return _flat(sm.summarize_batches(rounds(spark, d), NOW, opts=SHORT).memories)


def leftover_rounds(spark, d):
    return sm.summarize_batches(rounds(spark, d), NOW, opts=SHORT).leftover.select("user_id", "conv_id", "round_id", "batch_no")


def ingest_notes(spark, d):
    return _flat(sm.ingest_notes(notes(spark, d), NOW, file_names=FILES, patterns=PATTERNS).memories)


def ingest_note_counts(spark, d):
    return sm.ingest_notes(notes(spark, d), NOW, file_names=FILES, patterns=PATTERNS).totals


def chunks(spark, d):
    return chunk_corpus(notes(spark, d), 2000)


def importable_chunks(spark, d):
    return note_chunks(notes(spark, d), FILES, PATTERNS).select("user_id", "file_name", "pos", "text")


def ingest_responses(spark, d):
    good, _, _ = sm.ingest_responses(replies(spark, d))
    return good.select("doc_id", "route", "summary", _joined("topics").alias("topics"),
                       _joined("key_facts").alias("key_facts"), "sentiment", "importance")


def quarantined_responses(spark, d):
    return sm.ingest_responses(replies(spark, d))[1].select("doc_id", "route", "problem", "raw")


def response_routes(spark, d):
    return sm.ingest_responses(replies(spark, d))[2]


def session_end(spark, d, part="hot"):
    s = sm.session_end(_stored(spark, d), rounds(spark, d), NOW, summary_opts=SHORT)
    return _flat(s.hot) if part == "hot" else s.archived.select("id", "user_id", "tier", "period", "merged_into")


def session_end_twice(spark, d):
    """A second call over the same log, with the archive and the consumed rounds of the first: nothing is new."""
    first = sm.session_end(_stored(spark, d), rounds(spark, d), NOW, summary_opts=SHORT)
    hot, archived = sm.stage(first.hot, "first-hot"), sm.stage(first.archived, "first-archive")
    second = sm.session_end(hot, rounds(spark, d), NOW, summary_opts=SHORT, archive=archived,
                            consumed=sm.stage(first.remembered.consumed, "first-consumed"))
    return second.hot.unionByName(second.archived, allowMissingColumns=True).unionByName(
        archived, allowMissingColumns=True).groupBy("id").agg(F.count("*").alias("versions"))


def yearly_originals(spark, d):
    """Every memory under each yearly summary, through the monthly ones."""
    end = sm.session_end(_stored(spark, d), rounds(spark, d), NOW, summary_opts=SHORT)
    yearly = end.hot.where("tier = 'yearly'").select(F.col("id").alias("summary"))
    return sm.originals(sm.lineage_edges(end.archived)).join(yearly, "summary", "left_semi")


def reset_base(spark, d):
    april = X.period_key("created_at", "month", NOW) == "2024-04"
    return _flat(sm.reset_base(memories(spark, d), april, 0.75))


def embedding_text(spark, d):
    return sm.embedding_text(memories(spark, d)).select("id", "embedding_text")


def merge_plan(spark, d):
    m = _stored(spark, d)
    first = sm.settle(m, sm.DAILY_TO_MONTHLY, NOW)
    groups = sm.settlement_groups(m, sm.DAILY_TO_MONTHLY, NOW)
    return sm.merge_plan(groups, first.hot, first.archived, sm.DAILY_TO_MONTHLY, NOW)


def last_user_message(spark, d):
    return sm.last_user_message(transcript_lines(spark, d))


def _fresh(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def memories_table(spark, d):
    path = _fresh(spark, "memories")
    sm.write_memories(memories(spark, d), path)
    return _flat(sm.read_memories(spark, path, vectors=False))


def rounds_log(spark, d):
    path = _fresh(spark, "rounds")
    sm.append_rounds(rounds(spark, d), path)
    return sm.read_rounds(spark, path).select(
        "user_id", "conv_id", "round_id", "user_text", "assistant_text", _stamp("ts").alias("ts"))


def archive_files(spark, d):
    """Write the archive, read it back, and find each row's file through the index."""
    path = _fresh(spark, "archive")
    sm.write_archive(sm.settle(_stored(spark, d), sm.DAILY_TO_MONTHLY, NOW).archived, path)
    archive = sm.read_archive(spark, path)
    found = sm.lookup_archive(archive, archive, sm.archive_index(spark, path))
    return found.select("id", "content", "merged_into", F.col("metadata.session_id").alias("session_id"),
                        F.regexp_extract("path", "(tier=[^/]*/period=[^/]*)/", 1).alias("folder"))


def summarize_with_model(spark, d):
    def reply(texts):
        from hashlib import md5

        return [json.dumps({"summary": f"{md5(t.encode()).hexdigest()} {len(t)}", "topics": ["m"], "importance": 0.75}) for t in texts]

    def load():
        return lambda texts: np.array([[int(t[:2], 16), 100.0] for t in texts], dtype=np.float32)

    m = sm.summarize_batches(rounds(spark, d), NOW, sm.model_summarizer(reply), sm.model_embedder(load, 256), SHORT).memories
    return m.select("id", "content", _joined("topics").alias("topics"), "importance",
                    F.round(F.col("embedding")[0].cast("double"), 5).alias("x"), F.size("embedding").alias("dim"))


def _stream(spark, d, name):
    # A pattern, because a stream takes no single file by its plain path; the table may be a file or a folder of files.
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name}[.]parquet")


def _streamed_recall(spark, d):
    """All prompts in three files, one a micro-batch: (hits, increments)."""
    asked, path = prompts(spark, d), _fresh(spark, "prompts")
    asked.repartition(3, "query_id").write.parquet(path)
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(path)
    hits, increments = _fresh(spark, "hits"), _fresh(spark, "increments")
    sm.stream_recall(stream, _stored(spark, d), NOW, hits, increments, _fresh(spark, "stream"), LOW_BARS).awaitTermination()
    return spark.read.parquet(hits), spark.read.parquet(increments)


def stream_recall(spark, d):
    """Prompts arrive as a stream; the answers are those of the batch job."""
    hits, _ = _streamed_recall(spark, d)
    return hits.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def stream_recall_increments(spark, d):
    """The increments of all micro-batches, applied together."""
    _, increments = _streamed_recall(spark, d)
    after = sm.apply_increments(memories(spark, d), increments)
    return after.select("id", "access_count", _stamp("last_accessed").alias("last_accessed"))


def stream_sessions(spark, d):
    """Every turn of every conversation as a stream; sessions that closed by its end."""
    turns = _stream(spark, d, "conversations").select(
        owner("conv_id").alias("user_id"), F.col("conv_id").cast("string").alias("conv_id"),
        (F.to_timestamp(F.lit("2024-01-01 00:00:00"))
         + F.make_dt_interval(hours=F.col("conv_id").cast("int"), mins=F.col("turn").cast("int"))).alias("ts"))
    closed = _fresh(spark, "sessions")
    (sm.stream_sessions(turns, "20 minutes").writeStream.format("parquet").option("path", closed)
     .option("checkpointLocation", _fresh(spark, "stream")).outputMode("append").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.parquet(closed).select("user_id", "conv_id", "rounds", _stamp("first_ts").alias("first_ts"),
                                             _stamp("last_ts").alias("last_ts"))


QUERIES = {
    "memories_table": memories_table,
    "rounds_log": rounds_log,
    "archive_files": archive_files,
    "summarize_with_model": summarize_with_model,
    "stream_recall": stream_recall,
    "stream_recall_increments": stream_recall_increments,
    "stream_sessions": stream_sessions,
    "memories_scan": memories_scan,
    "effective_importance": effective_importance,
    "parse_created": parse_created,
    "strip_tool_calls": strip_tool_calls,
    "truncate_marked": truncate_marked,
    "period_keys": period_keys,
    "null_empty": null_empty,
    "vector_functions": vector_functions,
    "memory_lines": memory_lines,
    "new_ids": new_ids,
    "input_caps": input_caps,
    "where_metadata": where_metadata,
    "by_tier_and_period": by_tier_and_period,
    "min_importance": min_importance,
    "exclude_notes": exclude_notes,
    "long_enough": long_enough,
    "expire": expire,
    "forget": forget,
    "forget_count": forget_count,
    "knn": knn,
    "knn_where": knn_where,
    "knn_min_importance": knn_min_importance,
    "knn_approx": knn_approx,
    "knn_approx_all": knn_approx_all,
    "update_metadata": update_metadata,
    "upsert": upsert,
    "delete_ids": delete_ids,
    "find_merge_target": find_merge_target,
    "find_merge_target_semantic": find_merge_target_semantic,
    "settle_due": settle_due,
    "settle_rebuild": settle_rebuild,
    "yearly_originals": yearly_originals,
    "reembed": reembed,
    "stream_round_batches": stream_round_batches,
    "settlement_groups": settlement_groups,
    "merge_members": merge_members,
    "assemble_conversation": assemble_conversation,
    "access_tally": access_tally,
    "count_memories": count_memories,
    "decay_changes": decay_changes,
    "round_batches": round_batches,
    "recent": recent,
    "pack_context": pack_context,
    "session_start": session_start,
    "rerank": rerank,
    "recall": recall,
    "recall_default": recall_default,
    "recall_updates": recall_updates,
    "recall_context": recall_context,
    "tier_weighted_rank": tier_weighted_rank,
    "decay": decay,
    "settle_daily": partial(_settle, rule=sm.DAILY_TO_MONTHLY, part="hot"),
    "settle_daily_archive": partial(_settle, rule=sm.DAILY_TO_MONTHLY, part="archived"),
    "settle_monthly": partial(_settle, rule=sm.MONTHLY_TO_YEARLY, part="hot"),
    "settle_monthly_archive": partial(_settle, rule=sm.MONTHLY_TO_YEARLY, part="archived"),
    "archive_lookup": archive_lookup,
    "archive_found": archive_found,
    "all_memories": all_memories,
    "summarize_batches": summarize_batches,
    "leftover_rounds": leftover_rounds,
    "ingest_notes": ingest_notes,
    "ingest_note_counts": ingest_note_counts,
    "chunks": chunks,
    "importable_chunks": importable_chunks,
    "ingest_responses": ingest_responses,
    "quarantined_responses": quarantined_responses,
    "response_routes": response_routes,
    "session_end": session_end,
    "session_end_archive": partial(session_end, part="archived"),
    "session_end_twice": session_end_twice,
    "reset_base": reset_base,
    "embedding_text": embedding_text,
    "merge_plan": merge_plan,
    "last_user_message": last_user_message,
}
