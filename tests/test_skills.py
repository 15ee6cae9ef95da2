import itertools
import re

import pytest
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators import skills as K
from roleweave.vocabulary import Vocabulary

TERMS = {
    "dictionary": ["sql", "data analysis", "analysis", "c++", "c#", "node.js", "r", "ci/cd", "mysql", "etl", ".net", "javascript", "java script"],
    "approved": ["node.js", "a/b testing", "on call"],
    "acronym": ["sql", "etl", "ci/cd", "sso"],
    "single_letter": ["r", "c"],
}
ALIASES = {"mysql": "sql", "js": "javascript", "c programming": "c", "ab tests": "a/b testing", "data platforms": "database"}
STOPS = [("tools", "generic"), ("etl tools", "generic"), ("college", "institution"), ("paris", "location")]


@pytest.fixture(scope="module")
def words(spark):
    every = sorted({t for ts in TERMS.values() for t in ts})
    rows = [(t, *[t in TERMS[k] for k in TERMS]) for t in every]
    return Vocabulary.from_tables(
        {
            "skill": spark.createDataFrame(rows, "term string, dictionary boolean, approved boolean, acronym boolean, single_letter boolean"),
            "alias": spark.createDataFrame(list(ALIASES.items()), "variant string, canonical string"),
            "stop": spark.createDataFrame(STOPS, "term string, kind string"),
        }
    )


@pytest.fixture(scope="module")
def extractor(spark, words):
    return K.SkillExtractor(spark, words)


@pytest.fixture
def posting(one, extractor):
    return lambda text, title="": one(extractor.posting_skills(F.lit(title), F.col("x")), x=text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SQL and Data   Analysis", ["analysis", "data analysis", "sql"]),
        ("data, analysis", ["analysis"]),
        ("ésql sqlé sql_x", []),
        ("C++, C# and .NET", [".net", "c#", "c++"]),
        ("c++x xc++ x.net", []),
        ("Node.js", ["javascript", "node.js"]),
        ("CI/CD here", ["ci/cd"]),
        ("MySQL", ["sql"]),
        ("ab tests", ["a/b testing"]),
        ("data platforms and c programming", []),
        ("python, r, sql", ["r", "sql"]),
        ("uses r.", ["r"]),
        ("we know r. And more", ["r"]),
        ("x. r.", ["r"]),
        ("hello there. xx r. more text", ["r"]),
        ("hello there. xxx r. more text", ["r"]),
        ("good with r. then x", ["r"]),
        ("R&D", ["r"]),
        ("java/script", []),
        ("java (x) script", []),
        ("experience with java (x) script", ["java script"]),
        ("on call", []),
        ("experience with on call, sql", ["on call", "sql"]),
        ("  ", []),
        (None, []),
    ],
)
def test_posting_skills(posting, text, want):
    assert posting(text) == want


def test_title_counts_only_with_text(posting):
    assert posting("x", "SQL") == ["sql"]
    assert posting(" ", "SQL") == []
    assert posting("analysis", "data") == ["analysis", "data analysis"]


def test_resume_skills(one, extractor):
    text = "see https://x.example/sql www.etl.example\nStack: MySQL/js, on call; etl college | a/b testing (sql)\nplain etl"
    got = one(extractor.resume_skills(F.col("x")), x=text)
    assert got == ["a/b testing", "etl", "javascript", "on call", "sql"]
    assert one(extractor.resume_skills(F.col("x")), x="https://x.example/sql") == []


@pytest.mark.parametrize(
    ("term", "want"),
    [
        ("r", True), ("c", True), ("x", False), ("", False), ("tools", False), ("etl tools", False), ("12345 x", False), ("a&b", False),
        ("httpd", False), ("a@b", False), ("paris", False), ("old college", False), ("éé", False), ("2024", False), ("node.js", True),
        ("data analysis", True), ("two words", False), ("kotlin", True), ("us-citizen", False), ("x" * 41, False), (" SQL ", True),
    ],
)
def test_valid_skill(one, words, term, want):
    assert one(K.valid_skill(F.col("x"), words), x=term) is want


def test_known_and_slashes_and_canonical(one, words):
    assert one(K.known_skill(F.col("x"), words), x=" MySQL ") is True
    assert one(K.known_skill(F.col("x"), words), x="ruby") is False
    assert one(K.split_slashes(F.col("x"), words), x=["HTML/css", "a/b testing", "ci/cd", " "]) == ["html", "css", "a/b testing", "ci/cd"]
    got = one(K.canonicalize(F.col("x"), words), x=["js/SQL", "mysql", "two words", "ruby", "c programming", "tools"])
    assert got == ["c", "javascript", "ruby", "sql"]
    again = one(K.canonicalize(F.col("x"), words), x=got)
    assert again == got


def _brute(text, surfaces):
    m = re.sub(r"\s+", " ", re.sub(r"[|()\[\]{}:]", " ", text.lower().replace("&", " and ").replace("/", " / "))).strip()
    return sorted({c for s, cs in surfaces.items() if re.search(rf"(?<!\w){re.escape(s)}(?!\w)", m) for c in cs})


def test_scan_equals_brute_force_and_join_plan(spark, words):
    pieces = ["data", "analysis", "sql", "c++", "c#", ".net", "node.js", "js", ",", ".", "++", " ", "  ", "é", "x", "_", "/", "&"]
    texts = [(i, "".join(pieces[(i * 7 + j * j * 3 + j) % len(pieces)] + (" " if (i + j) % 3 else "") for j in range(25))) for i in range(300)]
    surfaces = K.scan_surfaces(words, K.valid_known_terms(spark, words))
    df = spark.createDataFrame(texts, "id int, text string").withColumn("m", T.match_text(F.col("text")))
    local = {r["id"]: sorted(set(r["s"])) for r in df.select("id", K.TextMatcher(surfaces).in_text(F.col("m")).alias("s")).collect()}
    assert local == {i: _brute(t, surfaces) for i, t in texts}
    table = spark.createDataFrame([(s, c) for s, cs in surfaces.items() for c in cs], "surface string, canonical string")
    joined: dict[int, set] = {}
    for r in K.scan_terms_by_join(df, "id", "m", table).collect():
        joined.setdefault(r["id"], set()).add(r["skill"])
    assert {i: sorted(joined.get(i, ())) for i, _ in texts} == local


def test_extraction_quality(spark):
    want = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "name string, skill string")
    got = spark.createDataFrame([("a", "x"), ("a", "w"), ("a", "x")], "name string, skill string")
    quality = {r["name"]: r for r in K.extraction_quality(want, got).collect()}
    assert (quality["a"]["found"], quality["a"]["missed"], quality["a"]["unexpected"], quality["a"]["coverage"]) == (1, 1, 1, 50.0)
    assert quality["b"]["coverage"] == 0.0
    verdict = K.quality_verdict(K.extraction_quality(want, got)).first()
    assert (verdict["found"], verdict["expected"], verdict["verdict"]) == (1, 3, "FAIL")
    assert sorted(r["skill"] for r in K.missed_skills(want, got).collect()) == ["y", "z"]


def test_seed_vocabulary_extracts(one, spark, vocab):
    seeded = K.SkillExtractor(spark, vocab)
    text = "Build pipelines with PySpark and Kafka on K8s. Must know Python, R, SQL; CI/CD a plus."
    assert one(seeded.posting_skills(F.lit("Data engineer"), F.col("x")), x=text) == [
        "ci/cd", "kafka", "kubernetes", "python", "r", "spark", "sql",
    ]


def test_settings_tables_are_bounded(spark):
    big = spark.range(10).selectExpr("cast(id as string) as word")
    from roleweave.vocabulary import bounded_rows

    with pytest.raises(ValueError, match="more than 9 rows"):
        bounded_rows(big, max_rows=9)


def test_plain_words_are_their_own_canonical_form(spark, vocab):
    terms = ["python", "plain", "plain\n", " plain", "Plain", "a", "x" * 40, "x" * 41, "https", "a/b", "citizen", "clearance", "éa", "aé",
             "c++", "12345", "", None, "und", *vocab.aliases, *vocab.stop("generic"), *vocab.stop("location"), *vocab.stop("institution")]
    df = spark.createDataFrame([(t,) for t in terms], "t string")
    rows = df.select("t", K.plain_word(F.col("t"), vocab).alias("plain"), K.canonicalize(F.array("t"), vocab).alias("c")).collect()
    assert all(r["c"] == [r["t"]] for r in rows if r["plain"])
    assert {"python", "plain", "aé", "und"} <= {r["t"] for r in rows if r["plain"]}
    assert not {"citizen", "plain\n", "https", "x" * 41} & {r["t"] for r in rows if r["plain"]}


def _letter_by_rule(letter: str, text: str) -> bool:
    """The rule as stated: between separators in the text or in one of its trimmed chunks."""
    strict = rf"(?:^|[,;:\s/(\[]){letter}(?:$|[,;:\s/)\]])"
    return any(re.search(strict, s) for s in [text, *(c.strip(" ") for c in re.split("[.;•●○–—]", text))])


def test_one_letter_skills_by_rule(spark):
    parts = ["r", "R", " ", ",", ".", "(", "-", "–", "x"]
    texts = ["".join(p) for n in range(1, 5) for p in itertools.product(parts, repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for words in (None, K.distinct_words(t)):
        got = {r["t"]: r["s"] for r in rows.select("t", K.single_letter_hits(t, {"r": ["r"]}, words).alias("s")).collect()}
        assert got == {x: ["r"] if _letter_by_rule("r", x) else [] for x in texts}


def test_forms_of_several_words_between_edges(spark):
    surfaces = {s: [s] for s in ("a b", "a.b", "b a b", "b", "ab a", "é a")}
    texts = ["".join(p) for n in range(1, 6) for p in itertools.product(["a", "b", " ", ".", "é"], repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    matcher, t = K.TextMatcher(surfaces), F.col("t")
    want = {x: sorted(s for s in surfaces if re.search(rf"(?<!\w){re.escape(s)}(?!\w)", x)) for x in texts}
    for hits in (matcher.in_text(t), matcher.in_text(t, K.distinct_words(t))):  # the second: words made once for several matchers
        assert {r["t"]: sorted(r["s"]) for r in rows.select("t", hits.alias("s")).collect()} == want


def test_no_text_has_no_hits(one):
    """A null is a text without hits, not a null."""
    assert one(K.TextMatcher({"a": ["a"], "a b": ["a b"]}).in_text(F.col("x")), x=None) == []
