import sparkmem as sm

RAW = {
    "json": '{"summary":"s","topics":["a","b","c","d","e","f"],"key_facts":[1,"two"],"sentiment":"negative","importance":0.9}',
    "empty_object": "{}",
    "number_as_text": '{"importance":" 0.4 "}',
    "whole_number": '{"importance":1}',
    "true": '{"importance":true}',
    "fenced": '  ```json\n{"summary":"f"}\n```\n',
    "plain_fence": '```\n{"summary":"g","topics":[]}```',
    "loose": 'Here: "summary": "l", "topics": ["x", "y z"], "importance": 0.3, "sentiment": "positive"',
    "loose_bare": "no fields at all",
    "single_quotes": "{'summary': 'q'}",
    "list": "[1,2]",
    "scalar": "7",
    "null_topics": '{"topics":null}',
    "null_facts": '{"key_facts":null}',
    "null_importance": '{"importance":null}',
    "bad_importance": '{"importance":"high"}',
    "high": '{"importance":1.01}',
    "low": '{"importance":-0.1}',
    "loose_dots": '"importance": 0.3.4',
    "topics_text": '{"topics":"abc"}',
    "null_summary": '{"summary":null}',
    "none": None,
    "trailing": '{"summary":"t","importance":0.2} Hope this helps!',
    "two_values": '{"summary":"u"}, {"summary":"v"}',
    "closed_early": '{"summary":"w"}] }',
}


def test_each_route_and_every_quarantine_reason(spark):
    df = spark.createDataFrame(list(RAW.items()), "name string, raw string")
    good, bad, routes = sm.ingest_responses(df)
    got = {r.name: r for r in good.collect()}
    why = {r.name: r.problem for r in bad.collect()}
    assert set(got) | set(why) == set(RAW) and not set(got) & set(why)

    def fields(name):
        r = got[name]
        return r.route, r.summary, r.topics, r.key_facts, r.sentiment, r.importance

    record = "Conversation record"
    assert fields("json") == ("json", "s", ["a", "b", "c", "d", "e"], ["1", "two"], "negative", 0.9)
    assert fields("empty_object") == ("json", record, [], [], "neutral", 0.5)
    assert got["number_as_text"].importance == 0.4
    assert got["whole_number"].importance == 1.0 and got["true"].importance == 1.0
    assert fields("fenced")[:2] == ("fenced", "f") and fields("plain_fence")[:2] == ("fenced", "g")
    assert fields("loose") == ("loose", "l", ["x", "y z"], [], "positive", 0.3)
    assert fields("loose_bare") == ("loose", record, ["general"], [], "neutral", 0.5)
    assert got["single_quotes"].route == "loose"
    assert fields("trailing") == ("loose", "t", ["general"], [], "neutral", 0.2)
    assert fields("two_values")[:2] == ("loose", "u") and fields("closed_early")[:2] == ("loose", "w")
    assert why == {
        "list": "not an object", "scalar": "not an object", "null_topics": "topics not a list",
        "null_facts": "key_facts not a list", "null_importance": "importance not a number",
        "bad_importance": "importance not a number", "high": "importance out of range", "low": "importance out of range",
        "loose_dots": "importance not a number", "topics_text": "topics not a list",
        "null_summary": "summary not text", "none": "no reply",
    }
    assert {r.route: r.replies for r in routes.collect()} == {"json": 5, "fenced": 2, "loose": 6}
