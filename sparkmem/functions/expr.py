"""Column expressions. All of them stay inside the JVM."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..options import TOPIC_LABEL, DecayOptions

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def instant(now) -> Column:
    """``now`` as a timestamp literal: a Column, a datetime or an ISO string (naive = UTC)."""
    if isinstance(now, Column):
        return now
    if isinstance(now, str):
        now = datetime.fromisoformat(now)
    if now.tzinfo is None:
        now = now.replace(tzinfo=timezone.utc)
    return F.timestamp_micros(F.lit((now - _EPOCH) // timedelta(microseconds=1)).cast("long"))


def age_days(created, now) -> Column:
    """Days from ``created`` to ``now``, never negative; an unknown date counts as now."""
    micros = F.unix_micros(instant(now)) - F.unix_micros(_col(created))
    return F.greatest(F.lit(0.0), F.coalesce(micros / F.lit(1e6) / F.lit(86400.0), F.lit(0.0)))


def effective_importance(base, access, created, now, opts: DecayOptions = DecayOptions()) -> Column:
    """Importance after forgetting: a boosted base that fades exponentially with age."""
    boosted = F.greatest(_col(base), F.lit(0.01)) * (
        F.lit(1.0) + F.lit(opts.alpha) * F.ln(F.lit(1) + F.coalesce(_col(access), F.lit(0)))
    )
    adjusted = F.least(F.lit(1.0), boosted)
    strength = F.greatest(F.lit(float(opts.s0)) * adjusted, F.lit(0.001))
    faded = adjusted * F.exp(-age_days(created, now) / strength)
    return F.round(F.least(F.lit(1.0), faded), 4)


def fades_at(base, access, created, threshold: float, opts: DecayOptions = DecayOptions()) -> Column:
    """The time from which ``effective_importance`` may be below ``threshold`` (of at most four decimals): the forgetting curve
    solved for it, at most some seconds early and never late. 1970 where it always is, NULL where it never will be."""
    boosted = F.greatest(_col(base), F.lit(0.01)) * (
        F.lit(1.0) + F.lit(opts.alpha) * F.ln(F.lit(1) + F.coalesce(_col(access), F.lit(0)))
    )
    adjusted = F.least(F.lit(1.0), boosted)
    bar = F.lit(threshold - 0.00005)  # what rounds to less than the threshold
    days = F.greatest(F.lit(float(opts.s0)) * adjusted, F.lit(0.001)) * F.ln(adjusted / bar)
    micros = F.unix_micros(_col(created)) + F.floor(days * F.lit(86400e6) - F.lit(2e6)).cast("long")
    return F.when(adjusted <= bar + 1e-6, F.timestamp_seconds(F.lit(0))).otherwise(F.timestamp_micros(micros))


def stored_base(base="base_importance", importance="importance") -> Column:
    """The base a maintenance job ages from: base unless missing or zero, then importance, then 0.5."""
    return F.coalesce(F.nullif(_col(base), F.lit(0.0)), _col(importance), F.lit(0.5))


# Full ISO dates only: '2026-05' or a bare year must not pass.
_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_BASIC_OFFSET = r"([+-]\d{2})(\d{2})$"


def parse_created(text, now) -> Column:
    """ISO-8601 text as a timestamp (naive = session zone, to be UTC); anything else is ``now``."""
    t = _col(text)
    normal = F.regexp_replace(F.regexp_replace(t, ",", "."), r"(\d)" + _BASIC_OFFSET, "$1$2:$3")
    parsed = F.when(t.rlike(_ISO), F.try_to_timestamp(normal))
    return F.coalesce(parsed, instant(now))


# Every character that counts as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip_text(text) -> Column:
    """Remove whitespace of every kind at both ends."""
    return F.btrim(_col(text), F.lit(WHITESPACE))


# The block kinds that tools leave in an assistant message.
TOOL_BLOCKS = (
    r"(?s)<tool_use>.*?</tool_use>",
    r"(?s)<tool-response>.*?</tool-response>",
    r"(?s)<command-[^>]*>.*?</command-[^>]*>",
)


def strip_tool_calls(text) -> Column:
    out = _col(text)
    for pattern in TOOL_BLOCKS:
        out = F.regexp_replace(out, pattern, "")
    return strip_text(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def truncate_marked(text, n: int, marker: str) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(marker))).otherwise(t)


def recall_score(cosine, effective, w_sim: float = 0.6, w_imp: float = 0.4) -> Column:
    return F.lit(w_sim) * _col(cosine) + F.lit(w_imp) * _col(effective)


# The date formats of period keys.
PERIOD_FORMAT = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


def period_key(created, period: str, now) -> Column:
    return F.date_format(F.coalesce(_col(created), instant(now)), PERIOD_FORMAT[period])


def null_empty(df):
    """Empty strings and empty arrays become NULL, as a store without empty values keeps them."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        kind = f.dataType.typeName()
        if kind == "string":
            c = F.nullif(c, F.lit(""))
        elif kind == "array":
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)


def fixed(x, digits: int) -> Column:
    """A number as text with ``digits`` decimals, rounded half up on its decimal form."""
    return F.round(_col(x).cast("decimal(18,10)"), digits).cast("string")


def recall_line(created, content, topics, cosine, effective, score, w_sim=0.6, w_imp=0.4) -> Column:
    """One recalled memory as text: date, content, up to three topics and how it scored."""
    shown = F.array_join(F.slice(F.coalesce(_col(topics), F.array().cast("array<string>")), 1, 3), ", ")
    return F.concat(
        F.lit("- ["),
        F.coalesce(F.date_format(_col(created), "yyyy-MM-dd"), F.lit("")),
        F.lit("] "),
        F.coalesce(_col(content), F.lit("")),
        F.when(shown != "", F.concat(F.lit(f" ({TOPIC_LABEL}"), shown, F.lit(")"))).otherwise(F.lit("")),
        F.lit(f" ({w_sim:.1f}×"),
        fixed(cosine, 2),
        F.lit(f"+{w_imp:.1f}×"),
        fixed(effective, 2),
        F.lit("="),
        fixed(score, 2),
        F.lit(")"),
    )


def memory_line(created, importance, access, base, content) -> Column:
    """One memory as a listing line."""
    return F.concat(
        F.lit("create="),
        F.coalesce(F.date_format(_col(created), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")),
        F.lit(", imp="),
        fixed(F.coalesce(_col(importance), F.lit(0.5)), 4),
        F.lit(", access_count="),
        F.coalesce(_col(access), F.lit(0)).cast("string"),
        F.lit(", base="),
        fixed(F.coalesce(_col(base), _col(importance), F.lit(0.5)), 4),
        F.lit(" "),
        F.coalesce(_col(content), F.lit("")),
    )


def new_id(prefix: str, *key, digits: int = 32) -> Column:
    """A repeatable id from a key, so that a re-run task writes the same row.

    12 digits give the classic short form; 48 bits collide from some ten million
    rows on, so the default keeps 128.
    """
    text = F.concat_ws("\x1f", *[F.coalesce(_col(k).cast("string"), F.lit("\x00")) for k in key])
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, digits))


def whole_json(text) -> Column:
    """The JSON value a text consists of, or NULL if it is anything else or more than that.

    ``try_parse_json`` stops after the first value. Only a single value is valid both
    as the element of a list and as the value of a field.
    """
    t = _col(text)
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), t, F.lit("}")))
    as_item = F.try_parse_json(F.concat(F.lit("["), t, F.lit("]")))
    return F.when(as_field.isNotNull(), F.try_variant_get(as_item, "$[0]", "variant"))


def capped(items, n: int) -> Column:
    return F.slice(_col(items), 1, n)


def cosine(a, b) -> Column:
    """Cosine of two vectors in double precision; a zero vector has cosine 0."""
    return F.coalesce(_dot(a, b) / F.nullif(_norm(a) * _norm(b), F.lit(0.0)), F.lit(0.0))


def l2_normalize(a) -> Column:
    scale = _norm(a) + F.lit(1e-8)
    return F.transform(_col(a), lambda x: x.cast("double") / scale)


def _dot(a, b) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _norm(a) -> Column:
    return F.sqrt(_dot(a, a))
