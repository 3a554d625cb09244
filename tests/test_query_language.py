import json
import random

import pytest
from pyspark.sql import functions as F

from tarnweave.operators.matching import match_counts, matches, with_snippets
from tarnweave.operators.snippets import clean, lookup, snippet
from tarnweave.plans.ast import AnyOf, Query, QueryError, Regexp, Text, both, either, expression, query, query_set
from tarnweave.plans.compile import predicate
from tarnweave.plans.regex import PatternError, to_java


def test_json_round_trip():
    root = both(either(Text("a"), AnyOf(("b", "c"))), Regexp(r"\d+"))
    q = Query("n", root, "a" * 24)
    again = query(json.loads(q.to_json()))
    assert again == q
    assert str(q) == '(("a" OR List[2]) AND (?i)\\d+)'


@pytest.mark.parametrize(
    "raw",
    [{}, {"name": "x"}, {"name": "x", "root": {}}, {"name": "x", "root": {"type": "no"}}, {"name": "x", "root": {"type": "regexp", "regexp": ""}}, {"name": "x", "root": {"type": "text", "text": "a"}, "_id": "zz"}, {"name": "x", "root": {"type": "operator", "operator": "XOR", "first": {"type": "text"}, "last": {"type": "text"}}}, {"name": "x", "root": {"type": "operator", "operator": "AND", "first": {"type": "text"}}}],
)
def test_bad_queries(raw):
    with pytest.raises(QueryError):
        query(raw)


def test_query_set_and_optional_fields():
    (q,) = query_set('[{"name": "a", "createdOn": "2020-01-02T03:04:05+00:00", "root": {"type": "list", "list": ["x"]}}]')
    assert q.id is None and q.created_on.year == 2020 and q.root == AnyOf(("x",))
    assert expression({"type": "list"}) == AnyOf(())


def test_patterns():
    assert to_java("a$") == r"(?iud)a\z"
    assert to_java("(?m)a$") == "(?iud)(?m)a$"
    assert to_java(r"(?P<n>\s)") == r"(?iud)(?<n>[\t\n\f\r ])"
    for bad in ("(?=x)", "(?<!x)", r"(a)\1", "a++", "(?>a)", "(", ")", "[a", "a{2,1}", r"\Z", "*a", "(?U)a+"):
        with pytest.raises(PatternError):
            to_java(bad)


def naive_word(text: bytes, needle: bytes) -> bool:
    edge = set(b"\t\n\x0b\x0c\r 0\x85\xa0")
    return any(text[i : i + len(needle)] == needle and (i == 0 or text[i - 1] in edge) and (i + len(needle) == len(text) or text[i + len(needle)] in edge) for i in range(len(text) - len(needle) + 1)) if needle else False


def test_whole_words_against_a_model(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(["a", "b", " ", "0", "\0", "\n", "à", ".", "\u0085", "é"]) for _ in range(rnd.randrange(0, 14))) for _ in range(600)] + ["10ab0", "\0ab b", "àab", "(ab)", "ab."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for needle in ("ab", "b", "aà", "."):
        got = {r.i: r.m for r in df.select("i", predicate(F.col("t"), Text(needle)).alias("m")).collect()}
        for i, t in enumerate(texts):
            assert got[i] == naive_word(t.encode(), needle.encode()) == (lookup(t.encode(), needle.encode()) is not None), (t, needle)


def test_strict_boundaries(spark):
    df = spark.createDataFrame([("\0ab c",), ("10ab0",), ("àab",)], "t string")
    assert [r.m for r in df.select(predicate(F.col("t"), Text("ab"), strict=True).alias("m")).collect()] == [True, False, False]


def test_lookup_takes_the_smallest_suffix():
    assert lookup(b"foo z foo a", b"foo") == (6, 9)
    assert lookup(b"foo foo", b"foo") == (4, 7)
    assert lookup(b"xfoo", b"foo") is None and lookup(b"abc", b"") is None


def test_snippets():
    assert snippet(b"hello world foo", [(6, 11)]) == "hello world foo"
    long = b"word " * 100
    got = snippet(long, [(250, 254)])
    assert got.startswith("...word") and got.endswith("... ")
    assert snippet(b"a\nb c", [(2, 3)]) == "b c"
    assert snippet(b"", []) is None
    two = snippet(b"aa bb cc dd", [(0, 2), (9, 11)])
    assert two == "aa bb cc dd... aa bb cc dd"
    assert snippet(b"x" * 300, [(0, 300)]) == "x" * 160 + "... "


def test_clean():
    assert clean("  a\n b  \t c ") == "a b c "
    assert clean("a\nb") == "ab"


def test_matches_counts_and_results(spark):
    rows = [(1, "The cat sat", "en"), (2, "la maison 1234", "fr"), (3, None, "fr"), (4, "", "en")]
    df = spark.createDataFrame(rows, "id int, text string, lang string")
    qs = [Query("t", Text("the")), Query("d", Regexp(r"\d{4}")), Query("b", both(Text("la"), Regexp("m.ison"))), Query("o", either(Text("cat"), AnyOf(("zz", "maison"))))]
    assert sorted((r.id, r.query_id) for r in matches(df, qs).collect()) == [(1, "o"), (1, "t"), (2, "b"), (2, "d"), (2, "o")]
    assert matches(df, []).count() == 0
    assert {(r.query_id, r.lang): r.n_matches for r in match_counts(df, qs, ["lang"]).collect()}[("o", "fr")] == 1
    got = {(r.id, r.query_id): r for r in with_snippets(df, qs).collect()}
    assert [tuple(s) for s in got[2, "b"].spans] == [(0, 2), (3, 9)]
    assert got[1, "t"].snippet == "the cat sat"
