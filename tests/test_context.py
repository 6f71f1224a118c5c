from datetime import datetime, timedelta

import pytest

import sparkmem as sm
from registry.inputs import NOW

from .conftest import memory_rows

DAY = datetime(2024, 6, 1)


def rows(n, content="c", user=1):
    return [{"id": f"m{i:04d}", "user_id": user, "content": f"{content}{i:04d}", "importance": 0.5, "base_importance": 0.5,
             "access_count": 1, "created_at": DAY + timedelta(hours=i)} for i in range(n)]


def line(r):
    return (f"create={r['created_at']:%Y-%m-%dT%H:%M:%S}, imp={r['importance']:.4f}, access_count=1, "
            f"base={r['base_importance']:.4f} {r['content']}")


def test_recent_keeps_the_newest(spark):
    got = sm.recent(memory_rows(spark, rows(30) + rows(3, user=2)), 5).orderBy("user_id", "age_rank").collect()
    assert [(r.user_id, r.id) for r in got] == [(1, f"m{i:04d}") for i in range(29, 24, -1)] + [(2, "m0002"), (2, "m0001"), (2, "m0000")]


@pytest.mark.parametrize("extra,kept", [(-1, 2), (0, 3), (1, 3)])
def test_budget_boundary(spark, extra, kept):
    r = rows(3)
    exact = len("\n\n".join(map(line, r)))
    opts = sm.ContextOptions(guide="G", max_memories=exact + extra, max_total=100000)
    out = sm.pack_context(memory_rows(spark, r), opts).first()
    assert out.memories == kept and out.context == "\n\n".join(map(line, r[3 - kept:])) + "\n\nG"


def test_a_newest_line_beyond_the_budget_is_cut(spark):
    r = rows(2)
    opts = sm.ContextOptions(guide="G", max_memories=30, max_total=1000)
    assert sm.pack_context(memory_rows(spark, r), opts).first().context == line(r[1])[:30].rstrip() + "\n\nG"
    none = sm.ContextOptions(guide="G" * 50, max_total=40)
    assert none.budget == 0 and sm.pack_context(memory_rows(spark, r), none).first().context == "G" * 50


def test_hot_user_packs_like_a_small_one(spark):
    r = rows(6000)
    opts = sm.ContextOptions()
    out = sm.pack_context(memory_rows(spark, r).repartition(8), opts).first()
    text, n = "", 0
    for x in reversed(r):
        longer = line(x) + ("\n\n" + text if text else "")
        if len(longer) > opts.budget:
            break
        text, n = longer, n + 1
    assert (out.memories, out.context) == (n, text + "\n\n" + opts.guide) and len(out.context) <= opts.max_total


def test_session_start_ages_first(spark):
    r = rows(25)
    out = sm.session_start(memory_rows(spark, r), NOW, sm.ContextOptions(guide="G")).first()
    assert out.memories == 20 and "imp=0.5000" not in out.context and out.context.index("c0005") < out.context.index("c0024")
