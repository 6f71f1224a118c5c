import math
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkmem.functions import expr as X

NOW = datetime(2024, 7, 1, tzinfo=timezone.utc)


def by_hand(base, access, days, s0=30.0, alpha=0.05):
    adj = min(1.0, max(base, 0.01) * (1 + alpha * math.log(1 + access)))
    return round(min(1.0, adj * math.exp(-max(days, 0) / max(s0 * adj, 0.001))), 4)


def effective(spark, rows):
    df = spark.createDataFrame(rows, "base double, access int, created timestamp")
    return [r.e for r in df.select(X.effective_importance("base", "access", "created", NOW).alias("e")).collect()]


def test_effective_importance_corners(spark):
    ago = lambda d: NOW - timedelta(days=d)
    rows = [(0.5, 0, NOW), (0.5, 0, ago(-3)), (0.0, 0, NOW), (None, 0, NOW), (0.9, 1000, NOW), (0.5, 3, None),
            (1.0, 0, ago(30)), (0.5, None, ago(10)), (0.4, 2, ago(1000))]
    assert effective(spark, rows) == [
        0.5, 0.5, 0.01, 0.01, 1.0, by_hand(0.5, 3, 0), round(math.exp(-1), 4), by_hand(0.5, 0, 10), 0.0,
    ]


cases = st.lists(
    st.tuples(st.integers(0, 100), st.integers(0, 50), st.integers(0, 400)), min_size=20, max_size=60
)


@settings(max_examples=3, deadline=None)
@given(cases)
def test_effective_importance_is_bounded_and_falls_with_age(spark, rows):
    older = [(b / 100, a, NOW - timedelta(days=d + 1)) for b, a, d in rows]
    newer = [(b / 100, a, NOW - timedelta(days=d)) for b, a, d in rows]
    out = effective(spark, newer + older)
    young, old = out[: len(rows)], out[len(rows):]
    for (b, a, d), y, o in zip(rows, young, old):
        assert 0 <= o <= y <= 1
        assert abs(y - by_hand(b / 100, a, d)) <= 1.01e-4


def test_parse_created(spark):
    texts = ["2024-05-10", "2024-05-10T12:30:00", "2024-05-10 12:30:00", "2024-05-10T12:30:00Z",
             "2024-05-10T12:30:00+02:00", "2024-05-10T12:30:00.123456+0000", "2024-05", "2024", "nonsense", "",
             "2024-13-40", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.x for r in df.orderBy("i").select(F.date_format(X.parse_created("t", NOW), "MM-dd HH:mm:ss").alias("x")).collect()]
    noon = "05-10 12:30:00"
    now = "07-01 00:00:00"
    assert got == ["05-10 00:00:00", noon, noon, noon, "05-10 10:30:00", noon, now, now, now, now, now, now]


def one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn("t").alias("x")).first().x


def test_strip_tool_calls(spark):
    text = ("  before <tool_use>\n{a}\n</tool_use>\n\n\n\nmiddle <tool-response>x</tool-response>"
            "<command-name>y\n</command-name> <tool_use>open\x1f　\n")
    assert one(spark, text, X.strip_tool_calls) == "before \n\nmiddle  <tool_use>open"
    assert one(spark, None, X.strip_tool_calls) is None
    assert one(spark, " \n\t", X.strip_tool_calls) == ""


def test_truncate_keeps_the_exact_limit(spark):
    cut = lambda c: X.truncate_marked(c, 5, "…")
    assert [one(spark, t, cut) for t in ("1234", "12345", "123456")] == ["1234", "12345", "12345…"]


def test_period_key_of_an_unknown_date_is_now(spark):
    df = spark.createDataFrame([(None,), (datetime(2023, 2, 3),)], "c timestamp")
    got = df.select(X.period_key("c", "month", NOW).alias("m"), X.period_key("c", "year", NOW).alias("y")).collect()
    assert [tuple(r) for r in got] == [("2024-07", "2024"), ("2023-02", "2023")]


def test_new_id_is_repeatable_and_tells_keys_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None)], "x string, y string")
    ids = [r.i for r in df.select(X.new_id("m-", "x", "y").alias("i")).collect()]
    assert len(set(ids)) == 3 and ids == [r.i for r in df.select(X.new_id("m-", "x", "y").alias("i")).collect()]


def test_recall_line_rounds_half_up_on_the_decimal_form(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 2), "c", ["a", "b", "c", "d"], 0.285, 0.2, 0.251)],
                               "d timestamp, c string, t array<string>, cos double, e double, s double")
    line = df.select(X.recall_line("d", "c", "t", "cos", "e", "s").alias("x")).first().x
    assert line == "- [2024-01-02] c (主题：a, b, c) (0.6×0.29+0.4×0.20=0.25)"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    rows = df.select(X.cosine("a", "b").alias("c"), X.l2_normalize("a").alias("u")).collect()
    assert [round(r.c, 6) for r in rows] == [0.96, 0.0]
    assert [round(x, 6) for x in rows[0].u] == [0.6, 0.8] and rows[1].u == [0.0, 0.0]
