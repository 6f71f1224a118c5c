"""Document quality by attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, labelled_sample, read_table, whole
from .words import pieces, word_hashes

#: Labelled documents of each class that are learned from, at most.
TRAINING_ROWS = 4_000
THRESHOLD = 0.7
#: Words in a passage.
PASSAGE = 64

# Every punctuation mark is a class of bytes; letters by case, digits, spaces, line ends, control and non-ASCII bytes are others.
_CLASS = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (
        1 if _b >= 128 else 2 if _c.isdigit() else 3 if _c.isupper() else 4 if _c.islower() else 5 if _c == " " else 6 if _c == "\n" else 0
    )
for _i, _b in enumerate(b for b in range(33, 127) if not chr(b).isalnum()):
    _CLASS[_b] = 7 + _i
_CLASSES = int(_CLASS.max()) + 1
FEATURES = _CLASSES + 5


def passages_of(column: pa.Array):
    """Per run of texts: features of every passage (passages × FEATURES) and the text each belongs to, from 0.

    A passage is ``PASSAGE`` words with what stands between them; a text has at least one. Features: square roots
    of byte class shares, and its fill, mean word length, share of distinct words, of words new to
    the text, and of bytes between words.
    """
    for first, last, data, at in pieces(column):
        texts = last - first
        hashes, text, starts, ends = word_hashes(data, at)
        begin = np.searchsorted(text, np.arange(texts + 1))
        place = np.arange(len(text)) - begin[text]
        cuts = np.flatnonzero((place % PASSAGE == 0) & (place > 0))
        marks = np.sort(np.concatenate([at[:-1], starts[cuts]]), kind="stable")
        owner = np.sort(np.concatenate([np.arange(texts), text[cuts]]), kind="stable")
        n = len(marks)
        size = np.diff(np.append(marks, len(data)))
        of_byte = np.repeat(np.arange(n), size)
        share = np.bincount(of_byte * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES) / np.maximum(size, 1)[:, None]
        # A word's passage: passages of earlier texts, and full passages before it in its own.
        base = np.searchsorted(owner, np.arange(texts))
        of_word = base[text] + place // PASSAGE
        words = np.bincount(of_word, minlength=n)
        some = np.maximum(words, 1)
        length = np.bincount(of_word, ends - starts, n)
        _, new_here = np.unique(hashes * np.uint64(0x9E3779B97F4A7C15) + of_word.astype(np.uint64), return_index=True)
        _, new_text = np.unique(hashes * np.uint64(0x9E3779B97F4A7C15) + text.astype(np.uint64), return_index=True)
        extra = np.column_stack([
            words / PASSAGE, np.log1p(length / some), np.bincount(of_word[new_here], minlength=n) / some,
            np.bincount(of_word[new_text], minlength=n) / some, (size - length) / np.maximum(size, 1),
        ])
        yield first, texts, np.hstack([np.sqrt(share), extra]).astype(np.float32), owner


@dataclass
class AttentionModel:
    """Gated attention: h = tanh(x E + e); weight ~ exp(w . (tanh(h V) * sigmoid(h U))); score = sigmoid(c . sum(weight h) + b)."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]
    shift: float  # moves the odds of the sample to those of all labels

    def forward(self, x: np.ndarray, owner: np.ndarray, texts: int):
        p = self.parts
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (v * u) @ p["w"]
        top = np.full(texts, -np.inf, a.dtype)
        np.maximum.at(top, owner, a)
        a = np.exp(a - top[owner])
        a /= np.bincount(owner, a, texts)[owner]
        z = np.zeros((texts, h.shape[1]), h.dtype)
        np.add.at(z, owner, a[:, None] * h)
        return x, h, v, u, a, z, z @ p["c"] + p["b"][0]

    def scores(self, x, owner, texts) -> tuple[np.ndarray, np.ndarray]:
        """Chance of label 1 per text, and the attention of each passage."""
        *_, a, _, logit = self.forward(x, owner, texts)
        return 1 / (1 + np.exp(-np.clip(logit + self.shift, -30, 30))), a


def fit_attention(bags: list[np.ndarray], label: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 30, seed: int = 5) -> AttentionModel:
    """Train on bags of passages with document labels by Adam; the gradients are written out."""
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 0.02
    d = every.shape[1]
    normal = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": normal(d, hidden), "e": np.zeros(hidden, np.float32), "V": normal(hidden, gate), "U": normal(hidden, gate), "w": normal(gate), "c": normal(hidden), "b": np.zeros(1, np.float32)}
    model = AttentionModel(mean, scale, p, 0.0)
    m, s = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, batch = 0, 64
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for i in range(0, len(order), batch):
            chosen = order[i:i + batch]
            sizes = [len(bags[j]) for j in chosen]
            owner, n = np.repeat(np.arange(len(chosen)), sizes), len(chosen)
            x, h, v, u, a, z, logit = model.forward(np.concatenate([bags[j] for j in chosen]), owner, n)
            err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label[chosen]) / n).astype(np.float32)
            g = {"c": z.T @ err, "b": np.array([err.sum()], np.float32)}
            dz = err[:, None] * p["c"]
            pull = (h * dz[owner]).sum(1)  # derivative of the loss by each attention weight
            da = a * (pull - np.bincount(owner, a * pull, n)[owner])
            g["w"] = (v * u).T @ da
            dv, du = da[:, None] * p["w"] * u * (1 - v * v), da[:, None] * p["w"] * v * u * (1 - u)
            g["V"], g["U"] = h.T @ dv, h.T @ du
            dh = (a[:, None] * dz[owner] + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
            g["E"], g["e"] = x.T @ dh, dh.sum(0)
            step += 1
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                s[k] = 0.999 * s[k] + 0.001 * grad * grad
                p[k] -= (0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, passages: int = 64) -> AttentionModel | None:
    """Learn from a bounded labelled sample: ``rows`` documents of each class and ``passages`` passages of each, evenly spread.

    The passages are encoded where the texts lie; only their features reach the driver. None if a class has no label.
    """
    def encode(batches):
        for batch in batches:
            for first, texts, x, owner in passages_of(batch.column(0)):
                ends = np.searchsorted(owner, np.arange(texts + 1))
                for k in range(texts):
                    bag = x[ends[k]:ends[k + 1]]
                    if len(bag) > passages:
                        bag = bag[np.linspace(0, len(bag) - 1, passages).astype(int)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(1).slice(first + k, 1), pa.array([bag.astype("<f4").tobytes()], pa.binary())], ["label", "bag"]
                    )

    counts = {r.quality: r.n for r in labels.where(F.col("quality").isin(0, 1) & ~held_out()).groupBy("quality").agg(F.countDistinct("doc_id").alias("n")).collect()}
    sample = labelled_sample(docs, labels, "quality", rows).orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label")
    got = sample.mapInArrow(encode, "label int, bag binary").toPandas()
    label = got.label.to_numpy(np.float32)
    if not 0 < label.sum() < len(label):
        return None
    model = fit_attention([np.frombuffer(b, "<f4").reshape(-1, FEATURES) for b in got.bag], label)
    model.shift = float(np.log(counts[1] / counts[0]) - np.log(label.sum() / (len(label) - label.sum())))
    return model


def score_quality(docs: DataFrame, model: AttentionModel | None) -> DataFrame:
    """Add ``score`` (chance of label 1), ``n_passages`` and ``attention`` (the largest weight and its passage).

    One narrow pass over whole texts. NULL and empty texts are one empty passage and get that passage's score; without a model
    every score is 0.5. Columns of these names are replaced, all others are kept.
    """
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            score, count, top, where = np.full(n, 0.5), np.ones(n, np.int64), np.ones(n), np.zeros(n, np.int64)
            for first, texts, x, owner in passages_of(batch.column(batch.num_columns - 1)):
                span = slice(first, first + texts)
                begin = np.searchsorted(owner, np.arange(texts + 1))
                count[span] = np.diff(begin)
                if model is not None:
                    score[span], a = model.scores(x, owner, texts)
                    top[span] = np.maximum.reduceat(a, begin[:-1])
                    best = np.flatnonzero(a >= top[span][owner])
                    where[first + owner[best][::-1]] = (best - begin[owner[best]])[::-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(score), pa.array(count), pa.array(top), pa.array(where)],
                [*batch.schema.names[:-1], "score", "n_passages", "attention", "attended"],
            )

    kept = docs.drop("score", "n_passages", "attention", "attended", "_scored")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double, n_passages long, attention double, attended long"])
    return kept.withColumn("_scored", whole()).mapInArrow(run, schema)


def op3_attention_quality(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", "attention",
    )
