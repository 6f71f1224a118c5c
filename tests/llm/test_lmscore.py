"""Cross-entropy difference against counts in plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from sparkmem.llm import lmscore

SCHEMA = "doc_id long, text string, _row string, difference binary, bucket int"


def words(text):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (text or "").lower())


def counted(texts):
    events, pairs, n = Counter(), Counter(), 0
    for t in texts:
        if x := words(t):
            events.update([*x, "</s>"])
            pairs.update(zip(["<s>", *x], [*x, "</s>"]))
            n += 1
    return events, pairs, n


def brute(docs, target, background, s=64.0):
    models = [(*counted(target), 0), (*counted(docs if background is None else background), background is None)]
    kinds = len((set(models[0][0]) | set(models[1][0])) - {"</s>"}) + 2
    out = []
    for t in docs:
        x, losses = words(t), []
        steps = list(zip(["<s>", *x], [*x, "</s>"]))
        mine, mine2 = Counter([*x, "</s>"]), Counter(steps)
        for events, pairs, n, own in models:
            loss = 0.0
            for v, w in steps:
                single = (events[w] - own * mine[w] + 1) / (events.total() + kinds)
                before = n - own if v == "<s>" else events[v] - own * mine[v]
                loss -= np.log2((pairs[v, w] - own * mine2[v, w] + s * single) / (before + s))
            losses.append(loss / len(steps) if x else 0.0)
        out.append((len(x), *losses))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "r", b"d", 1) for i, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def corpora():
    rng = np.random.default_rng(0)
    draw = lambda most, top: " ".join(f"W{int(x)}" for x in rng.zipf(1.3, rng.integers(0, most)) % top)
    docs = [draw(80, 500) for _ in range(60)] + [None, "", "...", "w1 w1 w1 w2", "zq zq zq", "été " * 300, draw(20000, 400), "W7 " * 5000]
    return [*docs, docs[0], docs[1]], [draw(50, 300) for _ in range(30)] + ["newword w1", None]


@pytest.mark.parametrize("known", [{}, {"frequent": 0, "heavy": 0}, {"frequent": 40, "heavy": 30, "run": 300}])
@pytest.mark.parametrize("apart", [False, True])
def test_cross_entropy_difference_equals_brute_force(spark, corpora, monkeypatch, known, apart):
    """Whatever rides along with the tasks, and whether or not the texts are their own background."""
    monkeypatch.setattr(lmscore, "_OFTEN", 2)
    docs, target = corpora
    background = docs[:20] + ["other words"] if apart else None
    got = lmscore.cross_entropy_difference(
        frame(spark, docs).repartition(3), frame(spark, target), frame(spark, background) if apart else None, **known
    ).collect()
    want = brute(docs, target, background)
    assert sorted(r.doc_id for r in got) == list(range(len(docs)))
    for r in got:
        n, t, b = want[r.doc_id]
        assert r.n_tokens == n and abs(r.loss_target - t) < 1e-9 and abs(r.loss_background - b) < 1e-9
        assert r.difference == r.loss_target - r.loss_background and r.bucket == 1 and "_row" not in r.asDict()


def test_all_words_count_in_cross_entropy(spark):
    # More distinct words than any fixed table held; the texts differ only in the rarest of them.
    common = [" ".join(f"w{(i * 40 + j) % 4000}" for j in range(400)) for i in range(60)]
    target, other = common + ["w1 alpha beta w2"], common + ["w1 gamma delta w2"]
    table = ["w1 alpha beta w2", "w1 gamma delta w2", "w1 gamma delta w2", "new alpha W1 unseen words", None, "gamma"]
    got = lmscore.cross_entropy_difference(frame(spark, table), frame(spark, target), frame(spark, other), frequent=100).collect()
    for r, (n, t, b) in zip(sorted(got), brute(table, target, other)):
        assert r.n_tokens == n and abs(r.loss_target - t) < 1e-9 and abs(r.loss_background - b) < 1e-9
    by = {r.doc_id: r.difference for r in got}
    assert by[0] < -0.5 and by[1] > 0.5


def test_a_text_does_not_know_its_own_words(spark):
    """A word that only one text holds is as new to the background as to the target."""
    docs = [f"common words here {w} {w} {w}" for w in ("alpha", "beta", "gamma")] + ["common words here"] * 20
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(frame(spark, docs), frame(spark, docs[3:])).collect()}
    assert abs(got[0].difference) < 0.5 and abs(got[0].loss_background - got[1].loss_background) < 1e-9


def test_empty_corpora(spark, corpora):
    none = frame(spark, [])
    assert lmscore.cross_entropy_difference(none, frame(spark, corpora[1])).count() == 0
    docs = corpora[0][:9]
    got = lmscore.cross_entropy_difference(frame(spark, docs), none, none)
    assert got.where("abs(difference) > 1e-9").count() == 0 and got.count() == 9
    for r, (n, t, b) in zip(sorted(lmscore.cross_entropy_difference(frame(spark, docs), none).collect()), brute(docs, [], None)):
        assert abs(r.loss_target - t) < 1e-9 and abs(r.loss_background - b) < 1e-9
