"""Quality rules whose thresholds come from mergeable quantile sketches per language and source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import stage
from .common import read_table, whole

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Measure -> whether a low value counts against a document too; high ones always do.
MEASURES = {"word_length": True, "symbol_share": False, "dup_line_share": False, "repeat_share": False}
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, lang, source): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    A word is a run of characters other than space and U+0009 to U+000D. Only built-in functions over
    one row; linear in the text but for one sort of the row's window keys, and that only
    where some window of three words repeats. NULL and empty texts count as no words.
    """
    text = F.col("_text")
    trimmed = F.btrim(text, F.lit(_SPACE))
    rows = docs.select("doc_id", "lang", "source", whole().alias("_text")).select(
        "doc_id", "lang", "source",
        F.when(F.length(trimmed) > 0, F.split(trimmed, r"[ \t\n\x0B\f\r]+")).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(_SPACE))) > 0).alias("_lines"),
    )
    rows = rows.withColumns({
        "n_words": F.size("_words").cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
    }).drop("_lines")
    # SQL text from here, as only SQL has integer division. A key holds a window's hash above and
    # its place below, so one sort of longs brings equal windows together.
    rows = rows.withColumn("_windows", F.expr(
        "CASE WHEN n_words >= 4 THEN transform(sequence(0, size(_words) - 3), "
        "i -> xxhash64(get(_words, i), get(_words, i + 1), get(_words, i + 2))) END"
    )).drop("_words")
    rows = rows.withColumn("_keys", F.expr(
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, "
        "(x, i) -> pmod(x, 4611686018427387904 div n_words) * n_words + i)) END"
    )).drop("_windows")
    rows = rows.withColumn("_places", F.expr(
        "sort_array(transform(filter(_keys, (x, j) -> x div n_words = get(_keys, j - 1) div n_words "
        "OR x div n_words = get(_keys, j + 1) div n_words), x -> x % n_words))"
    )).drop("_keys")
    return rows.withColumn("n_repeat_words", F.expr(
        "coalesce(aggregate(transform(_places, (p, j) -> least(3L, p - coalesce(get(_places, j - 1), -3L))), "
        "0L, (total, x) -> total + x), 0L)"
    )).drop("_places")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _shares() -> dict[str, Column]:
    def share(part: str, of: str) -> Column:
        return F.col(part) / F.greatest(F.col(of), F.lit(1))

    return {
        "word_length": share("word_chars", "n_words"), "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "repeat_share": share("n_repeat_words", "n_words"),
    }


def thresholds(rows: DataFrame, k: int, tail: float, least_rows: int) -> DataFrame:
    """Fences per (_lang, _source): the quantiles of KLL sketches that leave ``tail`` of the rows beyond them.

    A group's sketch is built by partial aggregation, so a source with a third of all rows is sketched where its
    rows lie. Sketches of sources merge into their language's and these into one of all rows; a group of fewer than
    ``least_rows`` rows takes its fences from its language's, or from all.
    """
    names = list(MEASURES)
    groups = rows.groupBy("_lang", "_source").agg(
        F.count("*").alias("_n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in names]
    )

    def merged(df: DataFrame, keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.sum("_n").alias(f"_n_{tag}"), *[F.kll_merge_agg_double(m, F.lit(k)).alias(f"{m}_{tag}") for m in names]
        )

    langs = merged(groups, ["_lang"], "lang")
    every = merged(groups, [], "all")
    table = groups.join(langs, "_lang").join(every, F.lit(True))
    fences = []
    for m, low in MEASURES.items():
        sketch = F.when(F.col("_n") >= least_rows, F.col(m)).when(F.col("_n_lang") >= least_rows, F.col(f"{m}_lang")).otherwise(F.col(f"{m}_all"))
        fences.append(F.kll_sketch_get_quantile_double(sketch, F.lit(1 - tail)).alias(f"_high_{m}"))
        if low:
            fences.append(F.kll_sketch_get_quantile_double(sketch, F.lit(tail)).alias(f"_low_{m}"))
    return table.select("_lang", "_source", *fences)


def adaptive_rules(docs: DataFrame, k: int = 1024, tail: float = 0.025, least_rows: int = 100) -> DataFrame:
    """Measures and verdict per document: (doc_id, lang, source, counts, base_failed, kept).

    A document is kept if it passes the base rule (50 words or more, at most half of them in
    repeated windows) and each measure lies inside the fences of its language and source, ends included: the ``tail`` and
    1 - ``tail`` quantiles of the documents there that pass the base rule, and no constant. So about ``tail`` of a group goes
    by each fence, less where many documents share the outermost value. NULL lang or source is a group of its own;
    repeated rows are judged alike; a very long text is one row of built-in functions; an empty table gives an empty result;
    input columns beside doc_id, text, lang and source are not read.
    """
    rows = stage(measured(docs), "rules").withColumns({
        "_lang": F.coalesce("lang", F.lit("")), "_source": F.coalesce("source", F.lit("")), "base_failed": base_failed(), **_shares(),
    })
    fences = thresholds(rows.where(~F.col("base_failed")), k, tail, least_rows)
    inside = F.lit(True)
    for m, low in MEASURES.items():
        inside = inside & (F.col(m) <= F.col(f"_high_{m}"))
        if low:
            inside = inside & (F.col(m) >= F.col(f"_low_{m}"))
    # A group without fences has no document that passes the base rule.
    return rows.join(fences, ["_lang", "_source"], "left").select(
        "doc_id", "lang", "source", *_COUNTS, "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"),
    )


def op9_adaptive_rules(spark, sf_dir):
    return adaptive_rules(read_table(spark, sf_dir, "documents")).select("doc_id", *_COUNTS, "base_failed", "kept")
