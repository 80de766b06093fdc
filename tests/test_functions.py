"""Golden rows of the scalar expressions."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from mailmill.functions import html, labels, payload, prompts, text, times


@pytest.fixture(scope="module")
def run(spark):
    def evaluate(make, values, schema="x string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, {schema}")
        return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]

    return evaluate


def b64(s):
    data = s if isinstance(s, bytes) else s.encode()
    return base64.urlsafe_b64encode(data).decode()


def test_header_lookup(run):
    pairs = "x array<struct<name:string,value:string>>"
    values = [[("SUBJECT", "a"), ("Subject", "b")], [("From", "x")], [], None, [(None, "z")]]
    assert run(lambda c: text.header_value(c, "Subject"), values, pairs) == ["a"] + [None] * 4


def test_base64url(run):
    values = ["aMOpPz5-w78=", "aMOpPz5-w78", "aMOpPz5-w78=\r\n", "YQ==", "", None, "YWJjZ"]
    got = run(lambda c: text.decode_utf8(text.decode_base64url(c)), values)
    assert got == ["hé?>~ÿ"] * 3 + ["a", "", None, "abc"]


def test_malformed_utf8(run):
    bad = bytes.fromhex("61FFE2827AF09F98")
    assert run(text.decode_utf8, [bytearray(bad)], "x binary") == [bad.decode(errors="replace")]


@pytest.mark.parametrize("c", text.WHITESPACE)
def test_whitespace_is_python_whitespace(c):
    assert c.isspace()


def test_whitespace_is_complete():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_line_ends(run):
    import re

    values = ["a  \n\n b\n", "\xa0x\x1c", "\n   x", "a  \n　\n\tb", "  ", "", "a\r\n\r\nb\n   ", None]
    want = [None if v is None else re.sub(r"\s+\n", "\n", v).strip() for v in values]
    assert run(text.squeeze_line_ends, values) == want
    assert want[0] == "a\n b"


def test_long_run_of_spaces_is_linear(run):
    gap = " " * 2_000_000
    assert run(text.squeeze_line_ends, [f"x{gap}y", f"x{gap}\n{gap}y"]) == [f"x{gap}y", f"x\n{gap}y"]


def test_html(run):
    cases = {
        "<p>a</p><p> b </p>": "a b",
        "x<!-- no > <b> -->y": "x y",
        "<style>p{}</style><script>var t='</p>';</script>t": "t",
        "<SCRIPT src='a'>1</SCRIPT >z<template>q</template>": "z",
        '<a title="1 > 2">link</a>': "link",
        "1 < 2 and 3 > 2": "1 < 2 and 3 > 2",
        "&lt;b&gt; &amp;lt; &quot;q&quot;": '<b> &lt; "q"',
        "caf&eacute; &copy; &#8364; &#x20AC; &#150; &nosuch; AT&T": "café © € € – &nosuch AT&T",
        "a&nbsp;": "a",
        "&amp;copy;": "&copy;",
        "&#99999999999;|&#xD800;": "�|�",
        "<p it's>tail</p>": "tail",
        "<!DOCTYPE html><html><title>T</title><br/>x": "T x",
        "a\x01b": "a\x01b",
        "": "",
        "<b>": "",
    }
    assert dict(zip(cases, run(html.html_to_text, list(cases)))) == cases


def test_html_long_tag_does_not_overflow(run):
    page = "<a " + "x='1' y=\"2\" " * 50000 + ">t</a><b " + "'" * 100001 + ">u"
    assert run(html.html_to_text, [page])[0].startswith("t")


def tree(depth, leaf):
    return leaf if depth == 0 else {"mimeType": "multipart/mixed", "parts": [tree(depth - 1, leaf)]}


def plain(s, mime="text/plain"):
    return {"mimeType": mime, "body": {"data": b64(s)}}


def body(run, records, depth=payload.DEFAULT_DEPTH, **kw):
    texts = [r if r is None or isinstance(r, str) else json.dumps(r) for r in records]
    return run(
        lambda c: payload.join_text_parts(
            payload.text_parts(payload.read_payload(c, depth), c, depth), **kw), texts)


def test_payload_shapes(run):
    nested = {"mimeType": "multipart/mixed", "parts": [
        plain("a"),
        {"mimeType": "multipart/alternative", "parts": [plain("b"), plain("", "text/plain")]},
        plain("<i>c</i>", "text/html"),
    ]}
    records = [plain("x"), {"mimeType": "text/plain"}, nested, plain("up", "TEXT/PLAIN"),
               {}, None, "", plain("<p>1</p><p>2</p>", "text/html"),
               {"mimeType": "text/plain", "body": {"size": 0}, "parts": [plain("in")]},
               {**plain("own"), "parts": [plain("hidden")]}]
    assert body(run, records) == ["x", "", "a\nb\nc", "", "", "", "", "1 2", "in", "own"]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_payload_deeper_than_schema(run, depth):
    wide = {"mimeType": "m/m", "parts": [plain("p"), tree(9, plain("deep")), plain("q"), {"parts": []}]}
    got = body(run, [tree(d, plain(f"d{d}")) for d in range(9)] + [wide], depth)
    assert got == [f"d{d}" for d in range(9)] + ["p\ndeep\nq"]


def test_payload_prefer_plain(run):
    both = {"mimeType": "multipart/alternative", "parts": [plain("t"), plain("<b>h</b>", "text/html")]}
    assert body(run, [both]) == ["t\nh"]
    assert body(run, [both, plain("<b>h</b>", "text/html")], prefer_plain=True) == ["t", "h"]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_local_iso(spark, run, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        values = ["1773925200999", None, "", "0", "x", "-1"]
        got = run(lambda c: times.local_iso(times.epoch_millis(c)), values)
        assert got == ["2026-03-19T18:30:00+05:30", "", "", "1970-01-01T05:30:00+05:30", "",
                       "1970-01-01T05:29:59+05:30"]
        from datetime import datetime
        from zoneinfo import ZoneInfo

        zone = "America/New_York"
        moments = [1730611800000, 1730615400000, 1710054000000, 1720000000000, 1700000000000]
        want = [datetime.fromtimestamp(m / 1000, ZoneInfo(zone)).isoformat(timespec="seconds")
                for m in moments]
        assert run(lambda c: times.local_iso(c, zone), moments, "x long") == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_day_stamp(run):
    from datetime import date

    assert run(times.day_stamp, [date(2026, 3, 19)], "x date") == ["19Mar2026"]


def test_label_text(run):
    values = ["['INBOX', 'UNREAD']", "[\"it's\", 'A']", "[]", "", "junk", "5", None,
              repr(["a'\"b", "tab\t", "\x01", "caf\xe9", "\\x41"]), "{'a': 1}"]
    assert run(labels.parse_label_text, values) == [
        ["INBOX", "UNREAD"], ["it's", "A"], [], [], [], [], [],
        ["a'\"b", "tab\t", "\x01", "caf\xe9", "\\x41"], []]


def test_main_label(run):
    values = [["A", "A", "INBOX"], ["INBOX"], [], ["UNREAD", "B", "A"]]
    kind = "x array<string>"
    assert run(labels.tag_labels, values, kind) == [["A", "A"], [], [], ["B", "A"]]
    assert run(lambda c: labels.main_label(labels.tag_labels(c)), values, kind) == ["A", "", "", "B"]


def test_label_sets(run):
    values = [["a", "b"], ["a"], [], None]
    kind = "x array<string>"
    assert run(lambda c: labels.holds_all(c, ["a", "b"]), values, kind) == [True, False, False, False]
    assert run(lambda c: labels.holds_all(c, []), values, kind) == [True] * 4
    assert run(lambda c: labels.holds_any(c, ["b", "c"]), values, kind) == [True, False, False, False]
    assert run(lambda c: labels.holds_any(c, []), values, kind) == [False] * 4


def test_prompt(run):
    assert run(lambda c: prompts.prompt_text(c, F.lit("b")), ["s", None]) == [
        "Subject: s\nBody: b", "Subject: \nBody: b"]
    assert run(lambda c: prompts.prompt_text(c, F.lit("b"), F.lit("me")), ["s"]) == [
        "From: me\nSubject: s\nBody: b"]
    assert run(lambda c: prompts.cut_body(c, 3), ["é😀xyz", None, "ab"]) == ["é😀x", "", "ab"]
    assert run(lambda c: prompts.cut_body(c, None), ["long text"]) == ["long text"]
    got = run(lambda c: prompts.chat_messages(F.lit("do"), c), ["hi"])[0]
    assert [(m.role, m.content) for m in got] == [("system", "do"), ("user", "hi")]


def test_response(run):
    values = ['{"category": "ADS", "reason_short": "sale"}', '{"category": "NOPE", "reason_short": "x"}',
              '{"category": "ADS"}', "not json", json.dumps({"category": "ADS", "reason_short": "x" * 81}),
              json.dumps({"category": "ADS", "reason_short": "x" * 80}), '{"category": "ADS", "reason_short": 5}',
              None, "", "[1]", '{"category": "ADS", "reason_short": null}']
    got = [tuple(r) for r in run(prompts.parse_response, values)]
    no = (None, None)
    assert got == [("ADS", "sale"), no, no, no, no, ("ADS", "x" * 80), no, no, no, no, no]


def test_more_behind_a_value_is_no_value(run):
    good = '{"category":"ADS","reason_short":"x"}'
    values = [f" {good} ", f"{good} thanks", f"{good}, {good}", f"{good}],[{good}", good + ',"b":{}', good.replace('"', "'")]
    got = [tuple(r) for r in run(prompts.parse_response, values)]
    assert got == [("ADS", "x")] + [(None, None)] * 5
    values = ["['a','b']", "['a','b'] junk", "['a'],['b']", " ['a'] "]
    assert run(labels.parse_label_text, values) == [["a", "b"], [], [], ["a"]]


def test_html_left_open(run):
    cases = {
        "<p>a</p><ruby>K<rt>kan</ruby><p>rest</p>": "a K rest",
        "<ruby>K<rp>(<rt>kan<rp>)</ruby>b": "K b",
        "<ruby>K<rt>kan</rt></ruby>b": "K b",
        "<p>a</p><style-guide>shown</style-guide><p>rest</p>": "a shown rest",
        "<template-x>shown</template-x><p>rest</p>": "shown rest",
        "<style>x{}</style><p>rest</p>": "rest",
    }
    assert dict(zip(cases, run(html.html_to_text, list(cases)))) == cases


def test_long_and_deep_payloads(run):
    leaf = {"mimeType": "text/plain", "body": {"data": b64("found")}}
    deep = leaf
    for _ in range(400):
        deep = {"mimeType": "multipart/mixed", "parts": [deep]}
    texts = lambda c: payload.join_text_parts(payload.text_parts(payload.read_payload(c), c))
    assert run(texts, [json.dumps(deep)]) == ["found"]
    long = json.dumps({"mimeType": "text/plain", "body": {"data": b64("a" * 15_800_000)}})
    assert len(long) > 21_000_000
    sizes = lambda c: F.length(texts(c))
    assert run(sizes, [long]) == [15_800_000]


@pytest.mark.parametrize("text", [
    '{"a": [1, -2.5e3, true, null, {"b": "x\\"]}"}], "c": {}}', "[]", "[[], {}]", ' "s" ', "5", '{"a": "\\u00e9\\n"}', "[1, [2, [3]]]",
])
def test_json_read_token_by_token(text):
    assert payload.parse_json(text) == json.loads(text)


@pytest.mark.parametrize("text", [
    "", "{", "[1,]", "[,1]", '{"a"}', '{"a":}', '{"a":1,}', "[1 2]", "]", "{]", "[}", "nul", '{a: 1}', "[1]]", '{"a":1}{}', '"', "1,2", "[1", '{"a":1 "b":2}', ":",
])
def test_what_is_no_json_is_an_error(text):
    with pytest.raises(ValueError):
        json.loads(text)
    with pytest.raises(ValueError):
        payload.parse_json(text)


def deep_payload(levels, inner='{"mimeType":"text/plain","body":{"data":"aGk="}}'):
    return '{"headers":[{"name":"Subject","value":"s"}],"parts":[' + '{"parts":[' * levels + inner + "]}" * levels + "]}"


@pytest.mark.parametrize("levels, by_token", [(1000, False), (30_000, True)])
def test_deep_payloads_are_read_token_by_token_only_where_they_must(monkeypatch, levels, by_token):
    calls, plain = [], payload.parse_json
    monkeypatch.setattr(payload, "parse_json", lambda text: calls.append(1) or plain(text))
    text = '{"parts":[' * levels + '{"mimeType":"text/plain","body":{"data":"YQ"}}' + "]}" * levels
    assert payload.walk_payload(text)["leaves"] == [{"mime": "text/plain", "data": "YQ"}]
    assert bool(calls) == by_token
    assert payload.walk_payload(text[:-1])["error"] == payload.NOT_JSON


def test_payloads_of_any_depth_and_of_no_json(spark):
    cases = [(0, "hi", None), (5, "hi", None), (6, "hi", None), (7, "hi", None), (480, "hi", None), (600, "hi", None), (5000, "hi", None)]
    data = [(deep_payload(n), body, error) for n, body, error in cases]
    data += [
        (deep_payload(6, '{"mimeType":"image/png"}'), "", None), (deep_payload(6, "null"), "", None),
        ("{cut", "", payload.NOT_JSON), ("[1]", "", payload.NOT_OBJECT), ("7", "", payload.NOT_OBJECT), (None, "", None), ("", "", payload.NOT_JSON),
        ('{"parts":7,"headers":"x"}', "", None), ('{"mimeType":"text/plain","body":{"data":"aGk="},"parts":"x"}', "hi", None),
    ]
    df = spark.createDataFrame([(k, p) for k, (p, _, _) in enumerate(data)], "k int, payload string")
    read = df.withColumn("read", payload.read_payload(F.col("payload")))
    both = (F.col("read"), F.col("payload"))
    got = read.select("k", payload.join_text_parts(payload.text_parts(*both)).alias("body"), payload.payload_error(*both).alias("error"),
                      payload.headers_of(*both).alias("headers")).orderBy("k").collect()
    assert [(r.body or "", r.error) for r in got] == [(b, e) for _, b, e in data]
    assert all(r.headers[0].value == "s" for r in got[:9])
    # All three are read off one call of the function.
    plan = read.select(payload.text_parts(*both), payload.payload_error(*both), payload.headers_of(*both))
    assert plan._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("page", "shown"), [
    ("a<template>x<template>y</template>z</template>b", "a b"),
    ("a<template>x</template>b<template>y</template>c", "a b c"),
    ("a<TEMPLATE id='1'>x<template><template>y</template></template >z</template>b</template>c", "a b c"),
    ("a<template>x<template>y</template>z", "a"),
    ("<!-- <template> <template> -->a<p>b</p>", "a b"),
    ("<script>'<template><template>'</script>a", "a"),
    ("a<templates>b<templates>c", "a b c"),
    ("a < b <template><template></template></template> c", "a < b c"),
])
def test_templates_inside_templates(spark, page, shown):
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(html.html_to_text(F.col("html")).alias("t")).first().t == shown
