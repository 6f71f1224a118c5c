"""Long-term conversation memory as Spark jobs: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Tasks carry the functions they need, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .functions.models import (  # noqa: E402
    extractive_summarizer,
    hashing_embedder,
    model_embedder,
    model_summarizer,
    remembering_embedder,
)
from .functions.responses import ingest_responses, parse_replies
from .operators.conversation import (
    assemble_conversation,
    last_user_message,
    round_batches,
    with_batch_id,
    without_consumed,
)
from .operators.corpus import chunk_corpus
from .operators.filters import (
    by_tier_and_period,
    exclude_notes,
    expire,
    forget,
    long_enough,
    min_importance,
    where_metadata,
)
from .operators.merging import extractive_reducer, model_reducer
from .operators.search import knn, knn_approx, knn_min_importance
from .operators.tables import (
    access_tally,
    all_memories,
    apply_increments,
    count_memories,
    delete_ids,
    find_merge_target,
    update_metadata,
    upsert,
)
from .options import (
    DAILY_TO_MONTHLY,
    MONTHLY_TO_YEARLY,
    ContextOptions,
    DecayOptions,
    RecallOptions,
    SettleRule,
    SummaryOptions,
)
from .plans.context import pack_context, recent, session_start
from .plans.ingest import embedding_text, ingest_notes, reembed
from .plans.lifecycle import (
    decay,
    decay_changes,
    merge_plan,
    rebuild_members,
    reset_base,
    session_end,
    settle,
    settlement_groups,
)
from .plans.lineage import last_summaries, lineage_edges, originals
from .plans.recall import recall, recall_context, recall_increments, recall_updates, rerank, tier_weighted_rank
from .plans.remember import remember, summarize_batches
from .sources.archive import archive_index, find_archived, lookup_archive, read_archive, write_archive, write_archive_index
from .sources.memories import read_due, read_memories, write_memories
from .sources.notes import read_notes
from .sources.rounds import append_rounds, read_rounds, stream_rounds
from .sources.staging import stage
from .sources.transcripts import read_transcript_lines
from .streaming.recall import stream_recall
from .streaming.rounds import session_rounds, stream_remember, stream_round_batches, stream_sessions

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("sys", "cloudpickle")]
