"""Toxic passages by maximum-scoring segment search over token log-odds."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import held_out, labelled, labelled_sample, read_table, whole
from .words import pieces, word_hashes

#: Byte lengths of the stems that stand in for longer words, so inflected and compound forms are known by their beginning.
STEMS = (4, 5, 6)
#: Labelled documents of each class that are learned from, at most.
TRAINING_ROWS = 10_000
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    """Token scores and their calibration; without both classes among the labels, ``units`` is empty."""

    units: np.ndarray  # sorted hashes of scored words and stems
    scores: np.ndarray
    weight: np.ndarray  # their significance: of a word and its stems the most significant one counts
    other: float  # score of every other word
    decay: float  # lambda of the extreme-value law: P(best >= s) = 1 - exp(-scale n exp(-decay s))
    scale: float  # K of the same law
    weights: np.ndarray  # logistic weights of (1, best, total)
    level: float  # chance that a clean text holds a passage counted as significant


def unit_counts(sample: DataFrame) -> DataFrame:
    """(unit, stem, toxic, clean): occurrences per class of (text, label) rows, added up per batch before the shuffle.

    Units are words (stem 0) and stems (their length).
    """
    def count(batches):
        for batch in batches:
            label = np.asarray(batch.column(1))
            for first, last, data, at in pieces(batch.column(0)):
                hashes, text, _, _, *stems = word_hashes(data, at, STEMS)
                for stem, found in zip((0, *STEMS), (hashes, *stems)):
                    there = found != 0
                    units, spot = np.unique(found[there], return_inverse=True)
                    toxic = np.bincount(spot, label[first:last][text[there]], len(units)).astype(np.int64)
                    clean = np.bincount(spot, minlength=len(units)) - toxic
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(units.view(np.int64)), pa.array(np.full(len(units), stem, np.int32)), pa.array(toxic), pa.array(clean)],
                        ["unit", "stem", "toxic", "clean"],
                    )

    rows = sample.select("text", F.col("label").cast("long")).mapInArrow(count, "unit long, stem int, toxic long, clean long")
    return rows.groupBy("unit", "stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def log_odds(counts: DataFrame, prior: float, least_z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units whose log-odds ratio is significant under an informative Dirichlet prior: (unit, ratio, |z|).

    The prior of a unit is its share of all tokens times ``prior`` tokens, so rare units are drawn to zero.
    """
    n1, n0 = counts.where("stem = 0").agg(F.sum("toxic"), F.sum("clean")).first()
    if not n1 or not n0:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    a = (F.col("toxic") + F.col("clean")) * (prior / (n1 + n0))
    up, down = F.col("toxic") + a, F.col("clean") + a
    ratio = F.log(up / (n1 + prior - up)) - F.log(down / (n0 + prior - down))
    z = F.abs(ratio / F.sqrt(1 / up + 1 / down))
    rows = counts.select("unit", ratio.alias("ratio"), z.alias("z")).where(F.col("z") >= least_z).toPandas().sort_values("unit")
    return rows.unit.to_numpy(np.int64), rows.ratio.to_numpy(float), rows.z.to_numpy(float)


def token_scores(model: ToxicityModel, forms) -> np.ndarray:
    """The score of every token, given the hashes of the word and of its stems."""
    scores, weight = np.full(len(forms[0]), model.other), np.zeros(len(forms[0]))
    if len(model.units):
        for found in forms:
            found = found.view(np.int64)
            spot = np.minimum(np.searchsorted(model.units, found), len(model.units) - 1)
            better = np.flatnonzero((model.units[spot] == found) & (model.weight[spot] > weight))
            scores[better], weight[better] = model.scores[spot[better]], model.weight[spot[better]]
    return scores


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a token sequence, in linear time.

    Segments are kept in order, each with the running total before it and at its end. A new positive
    token looks back for the nearest segment that begins lower; if that one ends lower too, everything from
    there on becomes one segment. Links to the nearest lower beginning keep the look-back linear.
    """
    totals = np.cumsum(scores)
    kept: list[list] = []  # first, end, total before, total at end, index of nearest earlier segment that begins lower
    for i in np.flatnonzero(scores > 0).tolist():
        part = [i, i + 1, float(totals[i] - scores[i]), float(totals[i]), -1]
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= part[2]:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= part[3]:
                part[4] = j
                kept.append(part)
                break
            part = [kept[j][0], part[1], kept[j][2], part[3], -1]
            del kept[j:]
            j = len(kept) - 1
    return [(a, b, high - low) for a, b, low, high, _ in kept]


def _decay(values: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of E[exp(x score)] = 1 over clean tokens; 1 where none exists."""
    if not (values > 0).any() or values @ shares >= 0:
        return 1.0
    mean = lambda x: float(np.exp(np.minimum(x * values, 500)) @ shares)
    low, high = 0.0, 1.0
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return max(low, 1e-3)


def _clean_scores(model: ToxicityModel, clean: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The scores, to a tenth, of the tokens of clean texts and their shares."""
    def count(batches):
        for batch in batches:
            for _, _, data, at in pieces(batch.column(0)):
                hashes, _, _, _, *stems = word_hashes(data, at, STEMS)
                values, n = np.unique(np.round(token_scores(model, (hashes, *stems)) * 10).astype(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], ["tenths", "n"])

    rows = clean.mapInArrow(count, "tenths long, n long").groupBy("tenths").agg(F.sum("n").alias("n")).toPandas()
    total = max(1, rows.n.sum()) if len(rows) else 1
    return rows.tenths.to_numpy(float) / 10, rows.n.to_numpy(float) / total


def _scan(model: ToxicityModel, column: pa.Array):
    """Per text: passages [(first byte, end byte, bits)], best and total evidence beyond chance, words."""
    for _, _, data, at in pieces(column):
        hashes, text, starts, ends, *stems = word_hashes(data, at, STEMS)
        scores = token_scores(model, (hashes, *stems))
        bounds = np.searchsorted(text, np.arange(len(at)))
        some = np.add.reduceat(np.append(scores > 0, False), bounds[:-1]) * (np.diff(bounds) > 0) if len(at) > 1 else []
        for k in range(len(at) - 1):
            if not some[k]:
                yield [], 0.0, 0.0, int(bounds[k + 1] - bounds[k])
                continue
            a, b = bounds[k], bounds[k + 1]
            # Evidence of a segment: its score in natural units less what the best of so many clean words reaches by chance.
            chance = np.log(model.scale * (b - a))
            found = [(i, j, model.decay * s - chance) for i, j, s in segments(scores[a:b])]
            best = max(x for _, _, x in found)
            significant = [x for x in found if x[2] >= -np.log(-np.log1p(-model.level))]
            yield (
                [(int(starts[a + i] - at[k]), int(ends[a + j - 1] - at[k]), x / np.log(2)) for i, j, x in significant],
                best, float(sum(x for _, _, x in significant)), int(b - a),
            )


def _features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.clip(best, 0, 60) / 10, np.log1p(total)])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, prior: float = 2000.0, least_z: float = 2.0,
    drift: float = 0.5, level: float = 0.05,
) -> ToxicityModel:
    """Token scores from one half of a bounded labelled sample, calibration from the other.

    A token scores its significant log-odds less ``drift``, all others -``drift``, so a clean text's running total falls.
    Where ``rows`` cuts a class, the intercept moves the odds of the sample back to those of all labels.
    """
    sample = stage(labelled_sample(docs, labels, "toxic", rows).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2))), "toxic-sample")
    units, ratios, weight = log_odds(unit_counts(sample.where("half = 0")), prior, least_z)
    model = ToxicityModel(units, ratios - drift, weight, -drift, 1.0, 1.0, np.array([-20.0, 0.0, 0.0]), level)
    if not len(units):
        return model
    model.decay = _decay(*_clean_scores(model, sample.where("half = 1 AND label = 0").select("text")))
    calibration = sample.where("half = 1").select("text", "label")

    def seen():
        return calibration.mapInArrow(_evidence(model), "label int, n long, best double, total double").toPandas()

    # While scale is 1, the evidence of a clean text's best segment is spread about ln K by the Gumbel law: fit K to its mean.
    got = seen()
    clean = got[(got.label == 0) & (got.n > 0)]
    if len(clean):
        model.scale = float(np.exp(np.mean(np.maximum(clean.best, -np.log(clean.n))) - np.euler_gamma))
    got = seen()
    x, y = _features(got.best.to_numpy(float), got.total.to_numpy(float)), got.label.to_numpy(float)
    if 0 < y.sum() < len(y):
        model.weights = _logistic(x, y)
        n = {r.label: r.n for r in labelled(labels, "toxic").groupBy("label").agg(F.count("*").alias("n")).collect()}
        model.weights[0] += np.log(max(n[1] / rows, 1)) - np.log(max(n[0] / rows, 1))
    return model


def _evidence(model: ToxicityModel):
    def run(batches):
        for batch in batches:
            found = list(_scan(model, batch.column(0)))
            n = [x[3] for x in found]
            best, total = (pa.array([x[i] for x in found], pa.float64()) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), best, total], ["label", "n", "best", "total"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add ``score`` (0 to 1) and ``passages`` (first byte, end byte and bits of every significant passage).

    One narrow pass over whole texts. NULL and empty texts have no passages and the lowest score; columns of
    these names are replaced, all others are kept.
    """
    def run(batches):
        for batch in batches:
            found = list(_scan(model, batch.column(batch.num_columns - 1)))
            x = _features(np.array([f[1] for f in found]), np.array([f[2] for f in found]))
            score = 1 / (1 + np.exp(-np.clip(x @ model.weights, -30, 30)))
            passages = [[{"first": a, "end": b, "bits": float(s)} for a, b, s in f[0]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array(passages, kind)], [*batch.schema.names[:-1], "score", "passages"]
            )

    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
    kept = docs.drop("score", "passages", "_scanned")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double", "passages array<struct<first:int,end:int,bits:double>>"])
    return kept.withColumn("_scanned", whole()).mapInArrow(run, schema)


def op8_toxic_segments(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, read_table(spark, sf_dir, "labels"))
    slim = docs.select("doc_id", "text")
    return score_toxicity(slim, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
