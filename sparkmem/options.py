"""Keyword defaults of the jobs, as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values of the output formats.
RECALL_TEMPLATE = "[相关记忆]\n{memories}\n\n---\n"
RECALL_CUT_MARKER = "\n...(记忆已截断)"
CONVERSATION_CUT_MARKER = "\n...(对话过长已截断)"
TOPIC_LABEL = "主题："


@dataclass(frozen=True)
class DecayOptions:
    s0: float = 30.0
    alpha: float = 0.05


@dataclass(frozen=True)
class RecallOptions:
    top_k: int = 5
    candidates: int = 20
    min_score: float = 0.55
    min_cosine: float = 0.58
    weight_similarity: float = 0.6
    weight_importance: float = 0.4
    max_chars: int = 2000
    template: str = RECALL_TEMPLATE
    cut_marker: str = RECALL_CUT_MARKER


@dataclass(frozen=True)
class SettleRule:
    """One step of the roll-up: which tier fades into which, and when."""

    source_tier: str
    target_tier: str
    period: str  # 'month' or 'year'
    threshold: float
    min_members: int
    shield: float | None = None
    adopt_untiered: bool = False  # rows without a tier join when the user has none in source_tier

    def __post_init__(self):
        if self.shield is not None and self.shield < self.threshold:
            raise ValueError("shield must not be below threshold")


DAILY_TO_MONTHLY = SettleRule("daily", "monthly", "month", 0.35, 3, shield=0.5, adopt_untiered=True)
MONTHLY_TO_YEARLY = SettleRule("monthly", "yearly", "year", 0.25, 2)


@dataclass(frozen=True)
class SummaryOptions:
    every: int = 10  # rounds per batch
    min_rounds: int = 2  # shorter batches stay buffered
    max_chars: int = 8000
    cut_marker: str = CONVERSATION_CUT_MARKER
    user_label: str = "user"
    assistant_label: str = "assistant"
    max_topics: int = 5
    max_facts: int = 5


@dataclass(frozen=True)
class ContextOptions:
    recent: int = 20
    max_total: int = 10000
    max_memories: int = 9500
    guide: str = (
        "[Session context]\n"
        "Above are the most recent memories, oldest first. They are given once at the "
        "start of a session and were not chosen for the message that follows. If that "
        "message is only a greeting, pick up one or two recent topics; if it is a "
        "request, answer it first and let it win over anything above."
    )

    @property
    def budget(self) -> int:
        return min(self.max_memories, max(0, self.max_total - len(self.guide) - 2))
