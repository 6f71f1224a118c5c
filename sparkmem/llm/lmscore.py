"""Cross-entropy difference of two bigram models, of a target and of the background corpus.

Both models share one vocabulary: every word of either corpus. A text is the events w1 … wn and its end; an event w
after v (the start for the first one) has

    p(w | v) = (c(v, w) + S p(w)) / (c(v) + S),   p(w) = (c(w) + 1) / (N + K)

with S the smoothing, N all events of the corpus and K the distinct words of both corpora, one for the end and one for
all words of neither. The logarithm of the fraction is a term of (v, w) less a term of v, so a text's loss is a sum of
terms that are found apart: each where the counts it needs come together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import spread_of
from ..sources.staging import stage
from .common import read_table, whole
from .words import mix, pieces, word_hashes

#: Events a task adds up together; of scored texts, which need more about each event, half as many.
RUN = 1 << 19
#: So many of the most frequent words, and of the most frequent bigrams, ride along with the tasks at most.
FREQUENT, HEAVY = 1 << 18, 1 << 17
#: A bigram seen so often in one run may be among the most frequent.
_OFTEN = 32
#: Events whose terms are looked for in one group of rows, about.
_BUCKET = 1 << 21
_TURN = np.uint64(0x9E3779B97F4A7C15)
_START, _END = np.uint64(1), np.uint64(2)
_DOCS, _TARGET, _BACKGROUND = 0, 1, 2
_BY_BIGRAM, _BY_WORD, _OWN = 0, 1, 2


@dataclass
class _Model:
    """What every task knows; bounded by FREQUENT and HEAVY whatever the corpora."""

    smoothing: float
    own: bool  # the scored texts are the background: each is scored without its own counts
    texts: tuple[int, int]  # texts with a word, in target and background
    floor: tuple[float, float]  # S / (N + K)
    words: tuple[np.ndarray, np.ndarray, np.ndarray]  # most frequent words: hash (sorted), count in target, in background
    bigrams: tuple[np.ndarray, np.ndarray, np.ndarray]  # the same of bigrams

    def unigram(self, t, b):
        """S p(w) in both models from the counts of w."""
        return (t + 1) * self.floor[0], (b + 1) * self.floor[1]


def _runs(batches, run: int, column: int = 0):
    """(batches' row numbers, word, previous word, text) of the events of some ``run`` events; texts are whole.

    Rows are numbered over the run; a text without words has no events.
    """
    parts, held, rows = [], 0, 0
    for i, batch in enumerate(batches):
        for first, last, data, at in pieces(batch.column(column)):
            hashes, text, _, _ = word_hashes(data, at)
            there = np.bincount(text, minlength=last - first)
            full = np.flatnonzero(there)
            sizes = there[full] + 1
            ends = np.cumsum(sizes) - 1
            word = np.empty(int(sizes.sum()), np.uint64)
            inner = np.ones(len(word), bool)
            inner[ends] = False
            word[inner], word[ends] = hashes, _END
            before = np.empty_like(word)
            before[1:] = word[:-1]
            before[ends - sizes + 1] = _START
            parts.append((word, before, np.repeat(full, sizes) + rows, (i, first, last)))
            held += len(word)
            rows += last - first
            if held >= run:
                yield _run(parts, rows)
                parts, held, rows = [], 0, 0
                pa.default_memory_pool().release_unused()  # workers live on between tasks
    if rows:
        yield _run(parts, rows)
        pa.default_memory_pool().release_unused()


def _run(parts, rows):
    word, before, text = (np.concatenate(x) for x in list(zip(*parts))[:3])
    return word, before, text, rows, [p[3] for p in parts]


def _key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _TURN + word)


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _most(counts: DataFrame, limit: int) -> tuple[np.ndarray, ...]:
    """(key, t, b) of the keys with at least so many occurrences that no more than ``limit`` keys have them, sorted by key."""
    step = F.floor(F.log2(F.col("t") + F.col("b")) * 8)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).toPandas().sort_values("step", ascending=False)
    fits = steps.step[steps.rows.cumsum() <= limit]
    if not len(fits):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(step >= int(fits.min())).select("key", "t", "b").toArrow()
    key, t, b = (top.column(c).to_numpy() for c in ("key", "t", "b"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    return key[order], t[order], b[order]


def _both(target: DataFrame, background: DataFrame, job, schema: str) -> DataFrame:
    """``job(side)`` over the texts of both corpora."""
    return (
        target.select(whole()).mapInArrow(job(_TARGET), schema)
        .unionByName(background.select(whole()).mapInArrow(job(_BACKGROUND), schema))
    )


def _counted(side: int, **columns) -> pa.RecordBatch:
    n = columns.pop("n").astype(np.int64)
    none = np.zeros(len(n), np.int64)
    t, b = (n, none) if side == _TARGET else (none, n)
    return pa.RecordBatch.from_pydict({**columns, "t": t, "b": b})


def fit(target: DataFrame, background: DataFrame, own: bool, smoothing: float, frequent: int, heavy: int, run: int) -> _Model:
    """Totals of both corpora, the most frequent words, and exact counts of the most frequent bigrams.

    All words are counted, in a table that is written down; a task adds up its own before the shuffle. Which bigrams ride
    along decides how much is shuffled later and no result.
    """
    def words(side):
        def count(batches):
            for word, before, _, _, _ in _runs(batches, run):
                keys, n = np.unique(word, return_counts=True)
                pairs, often = np.unique(_key(before, word), return_counts=True)
                pairs, often = pairs[often >= _OFTEN], often[often >= _OFTEN]
                kind = np.repeat(np.array([0, 1], np.int8), [len(keys), len(pairs)])
                yield _counted(side, kind=kind, key=np.concatenate([keys, pairs]).view(np.int64), n=np.concatenate([n, often]))

        return count

    schema = "key long, t long, b long"
    counts = stage(
        _both(target, background, words, f"kind byte, {schema}").groupBy("kind", "key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words"
    )
    singles = counts.where("kind = 0").drop("kind")
    n_t, n_b, kinds = singles.agg(F.coalesce(F.sum("t"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0)), F.count("*")).first()
    ends = singles.where(F.col("key") == int(_END)).first()
    texts = (ends.t, ends.b) if ends else (0, 0)
    size = kinds + (1 if ends else 2)
    # The end of a text is no context, so it always rides along.
    often = _most(singles.where(F.col("key") != int(_END)), frequent)
    order = np.argsort(np.concatenate([often[0], [_END]]))
    often = tuple(np.concatenate([x, np.array([y], x.dtype)])[order] for x, y in zip(often, (_END, *texts)))
    candidates = _most(counts.where("kind = 1").drop("kind"), heavy)[0]

    def pairs(side):
        def count(batches):
            total = np.zeros(len(candidates), np.int64)
            for word, before, _, _, _ in _runs(batches, run):
                at, there = _found(candidates, _key(before, word))
                total += np.bincount(at[there], minlength=len(candidates))
            some = np.flatnonzero(total)
            yield _counted(side, key=candidates[some].view(np.int64), n=total[some])

        return count

    exact = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if len(candidates):
        found = _both(target, background, pairs, schema).groupBy("key").agg(F.sum("t").alias("t"), F.sum("b").alias("b")).toArrow()
        key, t, b = (found.column(c).to_numpy() for c in ("key", "t", "b"))
        order = np.argsort(key.view(np.uint64))
        exact = key.view(np.uint64)[order], t[order], b[order]
    floor = (smoothing / (n_t + size), smoothing / (n_b + size))
    return _Model(smoothing, own, texts, floor, often, exact)


_ENTRIES = "bucket int, batch long, side byte, kind byte, keys binary, extra binary, times binary, texts binary, sizes binary"
_EMPTY = b""


def _packed(side: int, kind: int, batch: int, buckets: int, keys, extra, times, text):
    """Entries as one row a bucket: by word where ``kind`` says so, else by bigram; of scored texts in the order of texts."""
    spread = (extra if kind == _BY_WORD else keys) >> np.uint64(11)
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket * (int(text.max(initial=0)) + 1) + text, kind="stable")
    bucket, keys, times, text = bucket[order], keys[order], times[order], text[order]
    extra = extra[order] if len(extra) else extra
    times = times.astype(np.uint8 if int(times.max(initial=0)) < 256 else np.uint32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for i in range(buckets):
        a, b = edges[i], edges[i + 1]
        if a < b:
            texts, sizes = np.unique(text[a:b], return_counts=True) if side == _DOCS else (np.zeros(0, np.uint32),) * 2
            yield (
                i, batch, side, kind, keys[a:b].tobytes(), extra[a:b].tobytes() if len(extra) else _EMPTY, times[a:b].tobytes(),
                texts.astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes(),
            )


def _rows(rows) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int8(), pa.int8()] + [pa.binary()] * 5
    names = [f.split()[0] for f in _ENTRIES.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _corpus_entries(texts: DataFrame, side: int, model: _Model, buckets: int, run: int) -> DataFrame:
    """Counts of the bigrams that do not ride along, added up over a run."""
    def entries(batches):
        for word, before, _, _, _ in _runs(batches, run):
            keys, first, times = np.unique(_key(before, word), return_index=True, return_counts=True)
            near = _found(model.words[0], word[first])[1]
            far = ~(near & _found(model.bigrams[0], keys)[1])
            keys, words, times, near = keys[far], word[first[far]], times[far], near[far]
            text = np.zeros(len(keys), np.int64)
            rows = [*_packed(side, _BY_BIGRAM, -1, buckets, keys[near], _none(), times[near], text[near]),
                    *_packed(side, _BY_WORD, -1, buckets, keys[~near], words[~near], times[~near], text[~near])]
            yield _rows(rows)

    return texts.select(whole()).mapInArrow(entries, _ENTRIES)


def _none() -> np.ndarray:
    return np.zeros(0, np.uint64)


def _text_entries(docs: DataFrame, model: _Model, buckets: int, run: int) -> DataFrame:
    """Per run of scored texts: one row with what is known of each, and an entry for each other bigram of each."""
    s, own = model.smoothing, int(model.own)
    words, words_t, words_b = model.words
    pairs, pairs_t, pairs_b = model.bigrams

    def entries(batches):
        number, ids = TaskContext.get().partitionId() << 32, []

        def noted():
            for batch in batches:
                ids.append(batch.column(0).to_numpy())
                yield batch

        for word, before, text, rows, spans in _runs(noted(), run // 2, 1):
            known = np.concatenate([ids[i][a:b] for i, a, b in spans])
            t, b = np.zeros(rows), np.zeros(rows)
            # How often each event's word occurs in its own text, and from that the context's.
            _, which, n = np.unique(mix(word + text.astype(np.uint64) * _TURN), return_inverse=True, return_counts=True)
            here = n[which]
            at, near = _found(words, word)
            context, after = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
            context[1:], after[1:] = here[:-1], np.where(near, at, -1)[:-1]
            start = before == _START
            open_ = ~start & (after >= 0)
            for sums, counts, off, of_texts in ((t, words_t, 0, model.texts[0]), (b, words_b, own, model.texts[1])):
                sums += np.bincount(text[open_], np.log2(counts[after[open_]] - off * context[open_] + s), rows)
                sums += np.bincount(text[start], minlength=rows) * np.log2(of_texts - off + s)
            keys, first, times = np.unique(
                mix(_key(before, word) + text.astype(np.uint64) * _TURN), return_index=True, return_counts=True
            )
            keys, at, near, here = _key(before[first], word[first]), at[first], near[first], here[first]
            of, ws = text[first], word[first]
            q_t, q_b = np.zeros(len(first)), np.zeros(len(first))
            q_t[near], q_b[near] = model.unigram(words_t[at[near]], words_b[at[near]] - own * here[near])
            spot, heavy = _found(pairs, keys)
            heavy &= near
            t -= np.bincount(of[heavy], times[heavy] * np.log2(pairs_t[spot[heavy]] + q_t[heavy]), rows)
            b -= np.bincount(of[heavy], times[heavy] * np.log2(pairs_b[spot[heavy]] - own * times[heavy] + q_b[heavy]), rows)
            far, rare = near & ~heavy, ~near
            # Which word and how often the text has it: in four bytes where all fit, else in eight.
            place, often = at[far].astype(np.uint64), here[far].astype(np.uint64)
            fits = int(place.max(initial=0)) < 1 << 20 and int(often.max(initial=0)) < 1 << 12
            known_words = (place << np.uint64(12) | often).astype(np.uint32) if fits else place << np.uint64(32) | often
            tokens = np.bincount(text, minlength=rows) - np.bincount(text[start], minlength=rows)
            out = [(number % buckets, number, _DOCS, _OWN, known.tobytes(), np.concatenate([t, b]).tobytes(), tokens.astype(np.int64).tobytes(), _EMPTY, _EMPTY)]
            out += _packed(_DOCS, _BY_BIGRAM, number, buckets, keys[far], known_words, times[far], of[far])
            out += _packed(_DOCS, _BY_WORD, number, buckets, keys[rare], ws[rare], times[rare], of[rare])
            yield _rows(out)
            number += 1

    return docs.select("_row", "_scored").mapInArrow(entries, _ENTRIES)


def _known(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Place among the frequent words, and occurrences in the text, of ``n`` entries."""
    kind, bits = (np.uint32, 12) if len(blob) == 4 * n else (np.uint64, 32)
    both = np.frombuffer(blob, kind).astype(np.int64)
    return both >> bits, both & ((1 << bits) - 1)


def _terms(model: _Model):
    """Of a bucket's entries: what each text in each run gains in both losses."""
    s, own = model.smoothing, int(model.own)

    def totals(inverse, kinds, side, times):
        t = np.bincount(inverse[side == _TARGET], times[side == _TARGET], kinds)
        from_background = side == (_DOCS if own else _BACKGROUND)
        return t, np.bincount(inverse[from_background], times[from_background], kinds)

    def add(table: pa.Table) -> pa.Table:
        batch, side, kind = (table.column(c).to_numpy() for c in ("batch", "side", "kind"))
        blob = {c: table.column(c).to_pylist() for c in ("keys", "extra", "times", "texts", "sizes")}
        out = [(int(batch[i]), blob["keys"][i], blob["extra"][i], blob["times"][i]) for i in np.flatnonzero(kind == _OWN)]
        for way in (_BY_BIGRAM, _BY_WORD):
            rows = np.flatnonzero(kind == way)
            if not (side[rows] == _DOCS).any():
                continue
            held = [len(blob["keys"][i]) // 8 for i in rows]
            keys = np.frombuffer(b"".join(blob["keys"][i] for i in rows), np.uint64)
            times = np.concatenate([
                np.frombuffer(blob["times"][i], np.uint8 if len(blob["times"][i]) == n else np.uint32) for i, n in zip(rows, held)
            ]).astype(np.float64)
            of = np.repeat(side[rows], held)
            kinds, pair = np.unique(keys, return_inverse=True)
            pair_t, pair_b = totals(pair, len(kinds), of, times)
            scored = np.flatnonzero(of == _DOCS)
            texts = [np.frombuffer(blob["texts"][i], np.uint32) for i in rows if side[i] == _DOCS]
            sizes = np.concatenate([np.frombuffer(blob["sizes"][i], np.uint32) for i in rows if side[i] == _DOCS])
            text = np.repeat(np.arange(len(sizes)), sizes)
            n, pair = times[scored], pair[scored]
            if way == _BY_BIGRAM:
                place, often = (np.concatenate(x) for x in zip(*(_known(blob["extra"][i], n) for i, n in zip(rows, held) if side[i] == _DOCS)))
                q_t, q_b = model.unigram(model.words[1][place], model.words[2][place] - own * often)
                after_t = after_b = 0.0
            else:
                words, word = np.unique(np.frombuffer(b"".join(blob["extra"][i] for i in rows), np.uint64), return_inverse=True)
                word_t, word_b = totals(word, len(words), of, times)
                word = word[scored]
                _, which = np.unique(text * len(words) + word, return_inverse=True)
                here = np.bincount(which, n)[which]
                c_t, c_b = word_t[word], word_b[word] - own * here
                q_t, q_b = model.unigram(c_t, c_b)
                after_t, after_b = n * np.log2(c_t + s), n * np.log2(c_b + s)  # the word as context of what follows it
            t = np.bincount(text, after_t - n * np.log2(pair_t[pair] + q_t), len(sizes))
            b = np.bincount(text, after_b - n * np.log2(pair_b[pair] - own * n + q_b), len(sizes))
            ends = np.cumsum([len(x) for x in texts])
            for i, x, stop in zip([i for i in rows if side[i] == _DOCS], texts, ends):
                a = stop - len(x)
                out.append((int(batch[i]), x.tobytes(), np.concatenate([t[a:stop], b[a:stop]]).tobytes(), None))
        columns = list(zip(*out)) if out else [()] * 4
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["batch", "texts", "sums", "tokens"])

    return add


def _scores(table: pa.Table) -> pa.Table:
    """Of all rows of a run: one row a text."""
    texts, sums, tokens = (table.column(c).to_pylist() for c in ("texts", "sums", "tokens"))
    own = next(i for i, x in enumerate(tokens) if x is not None)
    ids, n = np.frombuffer(texts[own], np.int64), np.frombuffer(tokens[own], np.int64)
    total = np.frombuffer(sums[own], np.float64).reshape(2, -1).copy()
    for i, x in enumerate(tokens):
        if x is None:
            total[:, np.frombuffer(texts[i], np.uint32)] += np.frombuffer(sums[i], np.float64).reshape(2, -1)
    events = np.where(n > 0, n + 1, 1)
    return pa.table({"_row": ids, "n_tokens": n, "loss_target": total[0] / events, "loss_background": total[1] / events})


def cross_entropy_difference(
    docs: DataFrame, target: DataFrame, background: DataFrame | None = None, text: str = "text", smoothing: float = 64.0,
    frequent: int = FREQUENT, heavy: int = HEAVY, run: int = RUN,
) -> DataFrame:
    """Add n_tokens, loss_target, loss_background (bits an event) and ``difference``, the first less the second: low is like the target.

    Without ``background`` the scored texts are the background, and each is scored as if it were not in it: its own words, contexts
    and bigrams come off the counts (the corpus totals stay), so what only this text says is not well known. All words of all
    texts count, however many there are and however long a text is.

    Terms of the most frequent words and bigrams are found where the texts are read. Every other bigram of a text
    goes, packed, to the group of its rare word, or of the bigram where the word is frequent: there the counts of
    both follow from the entries themselves, so no table of bigrams is ever written. No group is hot: a rare word has few
    occurrences by definition, and a bigram that holds a great share of any run is among the most frequent.

    Rows are told apart by a 64-bit hash of their columns; equal rows have equal results. NULL and empty texts have no
    tokens and 0 in all columns, and are no text of either corpus; an empty corpus gives every word the same p(w). An empty table
    stays empty. Columns of these names are replaced, all others are kept.
    """
    names = ["n_tokens", "loss_target", "loss_background", "difference"]
    kept = docs.drop(*names, "_row", "_scored")
    plain = [F.col(f"`{c}`") for c, kind in kept.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = kept.withColumn("_row", F.xxhash64(*plain))
    texts, wanted = keyed.select("_row", whole(text).alias("_scored")), target.select(_text(target, text))
    own = background is None
    other = texts.select(F.col("_scored").alias("text")) if own else background.select(_text(background, text))
    model = fit(wanted, other, own, smoothing, frequent, heavy, run)
    n = model.texts[1] + (0 if not model.floor[1] else int(smoothing / model.floor[1]))
    buckets = max(spread_of(docs), n // _BUCKET)
    entries = _text_entries(texts, model, buckets, run).unionByName(_corpus_entries(wanted, _TARGET, model, buckets, run))
    if not own:
        entries = entries.unionByName(_corpus_entries(other, _BACKGROUND, model, buckets, run))
    parts = entries.groupBy("bucket").applyInArrow(_terms(model), "batch long, texts binary, sums binary, tokens binary")
    scores = parts.groupBy("batch").applyInArrow(_scores, "_row long, n_tokens long, loss_target double, loss_background double")
    # Equal rows have been scored each for itself, with the same result.
    one = scores.groupBy("_row").agg(*[F.min(c).alias(c) for c in names[:3]])
    return keyed.join(one, "_row", "left").withColumn("difference", F.col("loss_target") - F.col("loss_background")).drop("_row")


def _text(df: DataFrame, text: str) -> Column:
    return whole(text if text in df.columns else df.columns[0]).alias("text")


def op7_cross_entropy_difference(spark, sf_dir):
    """Documents scored for likeness to dialogue: the target is all turns of the conversations."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return cross_entropy_difference(docs, read_table(spark, sf_dir, "conversations").select("text")).drop("text")
