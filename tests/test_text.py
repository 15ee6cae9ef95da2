import random
import re

import pytest
from pyspark.sql import functions as F

from roleweave.functions import text as T

c = F.col("x")


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, ""),
        ("", ""),
        ("  a\t\n b  c  ", "a b c"),
        ("\x1cx\x85y　", "x y"),
        ("plain", "plain"),
    ],
)
def test_normalize(one, given, want):
    assert one(T.normalize(c), x=given) == want


def test_normalize_equals_python_blanks(one):
    text = "".join(f"a{chr(i)}b" for i in range(1, 0x3001) if not 0xD800 <= i < 0xE000)
    assert one(T.normalize(c), x=text) == re.sub(r"\s+", " ", text).strip()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("R&D / QA (x): [y] {z}|w", "r and d / qa x y z w"),
        ("CI/CD", "ci / cd"),
        (None, ""),
        ("(&)", "and"),
    ],
)
def test_match_text(one, given, want):
    assert one(T.match_text(c), x=given) == want


def test_join_match_equals_match_of_joined_fields(one):
    parts = [" A/", "", "(b) &", ":c "]
    columns = [F.col(k) for k in "pqrs"]
    fields = dict(zip("pqrs", parts, strict=True))
    joined = one(T.join_match(*[T.match_text(k) for k in columns]), **fields)
    assert joined == one(T.match_text(T.join_fields(" ", *columns)), **fields)


def test_lists(one):
    assert one(T.split_items(c), x=" SQL, ,Go ,sql,") == ["sql", "go", "sql"]
    assert one(T.split_typed(c), x="a;B|c, ;") == ["a", "b", "c"]
    assert one(T.join_list(F.col("x")), x=["a", "b"]) == "a, b"


def test_fields_keep_null_as_empty(one):
    assert one(T.join_fields(" | ", c, F.lit(None), F.lit("z")), x=None) == " |  | z"
    assert one(T.blank_to_null(c), x="") is None


def test_parsing(one):
    assert one(T.parse_date(c), x="not a date") is None
    assert one(T.parse_date(c), x="2024-02-03").isoformat() == "2024-02-03T00:00:00"
    assert one(T.parse_number(c), x="12.5") == 12.5
    assert one(T.parse_number(c), x="NaN") is None
    assert one(T.parse_number(c), x="x") is None


@pytest.mark.parametrize(
    ("link", "want"),
    [
        ("https://www.Example.com:8080/a?b#c", "example.com:8080"),
        ("https://WWW.example.com", "www.example.com"),
        ("//user@host.example/x", "user@host.example"),
        ("host.example/x", ""),
        ("http://bad host/x", "bad host"),
        ("", ""),
        ("https://a.www.b.example", "a.b.example"),
    ],
)
def test_link_authority(one, link, want):
    assert one(T.link_authority(c), x=link) == want


@pytest.mark.parametrize(
    ("term", "want"),
    [(" SQL ", "Structured"), ("a/b testing", "A/B Testing"), ("excel", "Excel"), ("c++", "c++"), ("ßa ßb", "Ssa Ssb"), (None, "")],
)
def test_display_name(one, term, want):
    from roleweave.vocabulary import map_literal

    assert one(T.display_name(c, map_literal({"sql": "Structured"})), x=term) == want


def test_prefix(one):
    assert one(T.prefix(c, 3), x="abcdef") == "abc"


def test_first_words_are_those_of_the_normalized_text(spark):
    texts = [None, "", " ", "a", "  a", "a b c", "  a \tb\nc", "a\u00a0b c", "\x1c\x1dq", "ab  ", "\U0001f600 x y"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select(T.first_words(F.col("t"), 2)).collect()
    assert [r[0] for r in rows] == ["", "", "", "a", "a", "a b", "a b", "a b", "q", "ab", "\U0001f600 x"]


def test_runs_are_those_of_the_plain_classes(spark):
    draw = random.Random(5)
    signs = "a1é \t\n\x0b\x85\xa0\u1680\u2003\u2028\u3000|()[]{}:" + 12 * " "
    texts = [("".join(draw.choices(signs, k=draw.randrange(12))),) for _ in range(3000)]
    norm = F.trim(F.regexp_replace("x", f"{T.BLANK}+", " "))
    match = F.trim(F.regexp_replace(F.lower("x"), rf"[{T._BLANKS}|()\[\]{{}}:]+", " "))
    same = (T.normalize(c) == norm) & (T.match_text(c) == match)
    assert spark.createDataFrame(texts, "x string").where(~same).count() == 0


def test_single_spaces_are_not_replaced(one):
    """They are most blanks of a text; replacing them copied it word by word."""
    for runs in (T._BLANK_RUNS, T._MATCH_RUNS):
        assert one(F.regexp_count(F.col("x"), F.lit(runs)), x="a b c d") == 0
        assert one(F.regexp_count(F.col("x"), F.lit(runs)), x="a  b\tc d \n") == 3
