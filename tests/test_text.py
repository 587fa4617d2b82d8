"""Literal answer texts and their expected columns."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text as T

PARSE = [
    ('{"bbox_2d": [100, 200, 300, 400]}', "box", (200.0, 200.0, 600.0, 400.0)),
    ('```json\n{"bbox_2d": [100, 200, 300, 400]}\n```', "box", (200.0, 200.0, 600.0, 400.0)),
    ('{"bbox_2d": null}', "none", None),
    ("there is none here", "none", None),
    ("nonetheless", "invalid", None),
    ("I can't help with that", "refusal", None),
    ("at 1, 2, 3, 4 or 10, 20, 30, 40", "box", (20.0, 20.0, 60.0, 40.0)),
    ('{"bbox_2d": [1, 2, 3]}', "invalid", None),
    ('{"bbox_2d": [5, 5, 5, 9]}', "invalid", (10.0, 5.0, 10.0, 9.0)),
    ('{"bbox_2d": [300, 400, 100, 200]}', "box", (200.0, 200.0, 600.0, 400.0)),
    ('{"bbox_2d": [900, 900, 2000, 2000]}', "box", (1800.0, 900.0, 2000.0, 1000.0)),
    ("", "invalid", None),
    (None, "invalid", None),
]


def test_box_answers(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(PARSE)], "i int, t string")
    p = T.parse_box_answer(F.col("t"), F.lit(2000), F.lit(1000), none_patterns=T.NONE_PATTERNS)
    for r in df.select("i", p.alias("p")).collect():
        text, kind, box = PARSE[r.i]
        assert r.p.output_type == kind, text
        assert (None if r.p.box is None else tuple(r.p.box)) == box, text
        assert r.p.parse_ok == (kind != "invalid")


def test_unknown_convention_is_an_error(spark):
    df = spark.createDataFrame([('{"bbox_2d": [1, 2, 3, 4]}',)], "t string")
    with pytest.raises(Exception, match="unknown coordinate convention"):
        df.select(T.parse_box_answer(F.col("t"), F.lit(10), F.lit(10), F.lit("loc_tokens"))).collect()
    with pytest.raises(Exception, match="needs the size"):
        df.select(T.parse_box_answer(F.col("t"), F.lit(10), F.lit(10), F.lit("absolute_resized"))).collect()


def one(spark, expr, **cols):
    row = tuple(cols.values())
    df = spark.createDataFrame([row], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in cols.items()))
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize("text,expect", [("Yes.", "yes"), ("  NOPE", "no"), ("unclear to me", "unclear"), ("maybe", "unparsed"), (None, "unparsed"), ("42 no", "no")])
def test_first_word(spark, text, expect):
    assert one(spark, T.verdict_word(F.col("t")), t=text) == expect


def test_swap_noun_keeps_case_and_counts(spark):
    r = one(spark, T.swap_noun(F.col("t"), F.col("n"), F.col("r")), t="The car is a Car; cars, carpet", n="car", r="polar car")
    assert (r.text, r.hits) == ("The polar car is a Polar car; polar car, carpet", 3)
    r = one(spark, T.swap_noun(F.col("t"), F.col("n"), F.col("r")), t="a dog", n="cat", r="x")
    assert (r.text, r.hits) == ("a dog", 0)


def test_substitute_once(spark):
    f = T.substitute_once(F.col("t"), F.col("a"), F.col("b"))
    assert one(spark, f, t="a red cup, covered", a="red", b="$1 blue") == "a $1 blue cup, covered"
    assert one(spark, f, t="red and red", a="red", b="blue") is None
    assert one(spark, f, t="a red cup", a="red", b="RED") is None


def test_align_span_widens(spark):
    f = T.align_span(F.col("t"), F.col("c"), F.col("a"), F.col("b"))
    r = one(spark, f, t="the red cup with a red lid", c=["is a red cup", "has a red lid"], a="has a red lid", b="has a blue lid")
    assert tuple(r) == ("red lid", "blue lid")
    assert one(spark, f, t="the cup", c=["x"], a="red cup", b="red cup") is None
    assert one(spark, f, t="the red cup", c=["red cup"], a="red cup", b="red cup here") is None


def test_audit_and_named_values(spark):
    text = "<audit>\n1. [color] is red | seen: it is blue | mismatch\n2. has a lid | seen: not visible | mismatch\n3. is big | seen: is big | match\n</audit><verdict>mismatch on 1</verdict>"
    a = T.audit_lines(F.col("t"))
    r = one(spark, F.struct(a.alias("a"), T.named_mismatches(a["lines"]).alias("m")), t=text)
    assert r.a.format_ok and [x.verdict for x in r.a.lines] == ["mismatch", "mismatch", "match"] and r.a.lines[0].type == "color" and r.a.lines[1].type is None
    assert [x.idx for x in r.m] == [1]


def test_trace_text_and_derived_answer(spark):
    t = ('<conditions>\n1. is red\n2. has a lid\n</conditions>\n<candidates>\n<object id="1" bbox="[0, 0, 500, 500]">1: yes; 2: no — it is open, not closed -> excluded</object>\n'
         '<object id="2" bbox="[500, 500, 1000, 1000]">1: yes; 2: yes -> fits</object>\n</candidates>\n<answer>{"bbox_2d": [500, 500, 1000, 1000]}</answer>')
    r = one(spark, T.trace_table(F.col("t"), F.lit(100), F.lit(100)), t=t)
    assert r.format_ok and r.derived_type == "box" and r.derived_id == 2 and tuple(r.derived_box) == (50.0, 50.0, 100.0, 100.0)
    assert r.candidates[0].verdicts == {1: "yes", 2: "no"} and r.candidates[0].seen == {2: "it is open, not closed"}


def test_prompt_parts(spark):
    text = "# stray\n# status: VERIFIED\n# todo: one\n#  two\n\nSay {expr} {{x}}\n# body hash\n"
    p = T.prompt_parts(F.col("t"))
    r = one(spark, F.struct(p.alias("p"), T.render_prompt(p["body"], {"expr": F.lit("{expr}!")}).alias("r")), t=text)
    assert r.p.meta == {"status": "VERIFIED", "todo": "one two"} and r.r == "Say {expr}! {x}\n# body hash"
    with pytest.raises(Exception, match="prompt needs field"):
        one(spark, T.render_prompt(F.col("t"), {}), t="Say {expr}")


def test_word_flip_rules(spark):
    def flip(t, caps):
        return one(spark, T.word_flip(F.col("t"), F.col("c"), "0", F.lit("k")), t=t, c=caps)

    assert flip("the Red cup", ["the red cup"]).text == "the Blue cup"
    assert flip("the red cup", ["a blue cup"]) is None
    assert flip("left hand", ["x"]) is None
    assert flip("plain", ["x"]) is None


def test_audit_text_is_searched_once(spark):
    text = "<audit>\n 1. [Color] is $1 red | seen:  it is\\blue | Mismatch\njunk 2. no | seen: x\n\n12. has | a lid | seen: | matches\n3. | seen: a | b |\n unsure\n</audit>"
    d = spark.createDataFrame([(text,), ("4. plain | seen: v | match",), (None,)], "t string").select(T.audit_lines(F.col("t")).alias("a"))
    a, b, c = (r.a for r in d.collect())
    assert [tuple(x) for x in a.lines] == [(1, "color", "is $1 red", "it is\\blue", "mismatch"), (3, None, "", "a | b", "unsure")] and a.format_ok
    assert [tuple(x) for x in b.lines] == [(4, None, "plain", "v", "match")] and not b.format_ok and c.lines == []
    assert d._jdf.queryExecution().analyzed().toString().lower().count("regexp_extract_all(") == 1


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tagged_lines_are_searched_once(spark):
    """ends are trimmed without a search, a text is cut into lines once, and its tags are found in one search."""
    d = spark.createDataFrame([("x",)], "t string")
    assert "regexp_replace" not in plan_of(d.select(T.strip(F.col("t")).alias("x")))
    for f, word, n in ((T.decomposition, "split(", 1), (T.flip_answer, "split(", 1), (T.old_new_spans, "regexp_extract_all(", 1)):
        assert plan_of(d.select(f(F.col("t")).alias("x"))).count(word) == n


def test_tagged_lines_with_odd_white_space(spark):
    assert one(spark, T.strip(F.col("t")), t="\u3000\u2028 a\u00a0b \u0085\r\n") == "a\u00a0b"
    d = one(spark, T.decomposition(F.col("t")), t='head: "the cup" \r\nHEAD:\u00a0a lid\r\n\r\nclause: has x..\u2028CLAUSE: "  "\nClause:"y."')
    assert (d.head, d.clauses) == ("a lid", ["has x", "  ", "y"])
    f = one(spark, T.flip_answer(F.col("t")), t=' \n"a red cup"\nnoise\nchanged:  red -> "blue" \nCHANGED: x -> y')
    assert (f.expr, f.old, f.new) == ("a red cup", "red", "blue")
    o = one(spark, T.old_new_spans(F.col("t")), t='old: a: b \nNEW1:\n "c" \nnew2:  \n\nNEW3: \u00a0\nOLD: "d"')
    assert (o.old, o.news) == ("d", ["c", "NEW3:"])
    assert one(spark, T.clean_line(F.col("t")), t="\n “ a ” \r\nb") == "a"
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\rc\n\nd\u2028e") == ["a", "b", "c", "", "d", "e"]


def test_aligned_spans_are_found_once(spark):
    """a flip uses the span that is at hand, and gives the same with and without it."""
    d = spark.createDataFrame([("the red cup on the red table", "is a red cup", "is on the red table", "is on the red table.", "is on the blue table")], "e string, a string, b string, o string, n string")
    args = [F.col("e"), F.array("a", "b"), F.col("o"), F.col("n")]
    d = d.withColumn("s", T.align_span(*args)).withColumn("f", T.flip_candidate(*args)).withColumn("g", T.flip_candidate(*args, F.col("s")))
    r = d.first()
    assert tuple(r.s) == ("red table", "blue table") and r.f == r.g and r.f.expr_neg == "the red cup on the blue table"
    d = spark.createDataFrame([("a", None)], "e string, s struct<old:string,new:string>")
    f = T.flip_candidate(F.col("e"), F.array("e"), F.col("e"), F.col("e"), F.col("s"))
    assert "aggregate(" not in plan_of(d.select(f.alias("x")))
