"""Views over the driver tables, stated once for Spark and once for DuckDB.

The tables hold invented words, so the small vocabulary here is made of words and phrases that
occur in them.  It is our own list, used only to exercise the operators at volume.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.operators.joins import spread
from roleweave.vocabulary import Vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with its DuckDB statement if it has one."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf}/{name}.parquet"))


# --- vocabulary -----------------------------------------------------------------------------

DICTIONARY = [
    "the", "with", "that", "of the", "in the", "data", "license", "der", "die", "von der", "que",
    "de la", "les", "est", "pour", "para", "nicht", "from the", "this is", "to be", "a", "y",
    "de%%%", "la***", "und", "thre", "erth", "sich", "tion", "los", "ha", "ist die",
]
APPROVED = ["by the", "on the", "de la", "of the", "avec la", "and the"]
SINGLE_LETTERS = ["a", "y", "e"]
ACRONYMS = ["est", "th", "ing", "los", "au", "ha", "zu"]
ALIASES = {
    "for the": "with", "at the": "in the", "ou": "zzyzx", "les": "la plus", "das": "der",
    "auf": "on the", "th": "thre", "von der": "der", "del": "de la", "mit": "sich", "ing": "a",
}
STOPS = {
    "generic": ["tion", "is", "was", "re", "er", "it"],
    "institution": ["ed", "ist", "est", "nd"],
    "location": ["thre", "en", "ea", "un"],
}
DISPLAYS = {"the": "THE", "de la": "De La", "with": "WITH", "der": "DER", "that": "That"}
CUES = (r"(?:with|for|und|que) ([a-z0-9+#/, -]{3,120})", r"(?:the|les)[: ]+([a-z ,]{3,60})")
ROLE_KEYWORDS = {
    "of the": ["the", "with", "this", "that", "from the", "data", "ing"],
    "les avec": ["pour", "les", "que", "dans", "avec", "sur"],
    "data": ["data", "license", "token"],
}
INDUSTRY_RULES = {
    "Latin": ["avec", "pour", "para", "los "],
    "Germanic": ["nicht", "und ", "sich"],
    "Licensed": ["license", "copyright"],
    "Numeric": ["0", "1", "2"],
    "Plain": ["the "],
}
QUALITY_RULES = {
    "domain": ["src13.", "src7.example"],
    "text": ["license", "pathetic", "password"],
    "title": ["nicht", "token", "the and"],
}
STOPWORDS = [
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "with", "be", "as", "by",
    "this", "are", "at", "from", "an", "de", "la", "der", "die", "en", "que", "le", "des", "und",
    "et", "les", "un", "el", "er", "re", "es",
]


def values(rows, columns: str) -> str:
    """``SELECT`` over inline VALUES; the text is valid in Spark SQL and in DuckDB."""

    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


_TERMS = sorted({*DICTIONARY, *APPROVED, *ACRONYMS, *SINGLE_LETTERS})
VOCAB_SQL = {
    "skill": values(
        [(t, t in DICTIONARY, t in APPROVED, t in ACRONYMS, t in SINGLE_LETTERS) for t in _TERMS],
        "term, dictionary, approved, acronym, single_letter",
    ),
    "alias": values(ALIASES.items(), "variant, canonical"),
    "stop": values([(t, k) for k, ts in STOPS.items() for t in ts], "term, kind"),
    "display": values(DISPLAYS.items(), "term, display_name"),
    "role_kw": values(
        [(r, i, k) for r, ks in ROLE_KEYWORDS.items() for i, k in enumerate(ks)], "role, pos, keyword"
    ),
    "industry_rule": values(
        [(ind, i, k) for i, (ind, ks) in enumerate(INDUSTRY_RULES.items()) for k in ks],
        "label, priority, keyword",
    ),
    "quality_rule": values(
        [(k, p) for k, ps in QUALITY_RULES.items() for p in ps], "kind, pattern"
    ),
    "keyword_rule": values(
        [(1, "include", "data"), (1, "include", "c++"), (1, "include", "licen"), (1, "include", "zu"),
         (1, "exclude", "the"), (1, "exclude", "der"), (2, "include", "pour"), (2, "include", "with "),
         (2, "exclude", "et "), (2, "exclude", "and")],
        "set_id, kind, pattern",
    ),
    "stopword": values([(w,) for w in STOPWORDS], "word"),
}


def vocabulary(spark: SparkSession) -> Vocabulary:
    return Vocabulary.from_tables({name: spark.sql(sql) for name, sql in VOCAB_SQL.items()})


# --- views: Spark ---------------------------------------------------------------------------


def postings(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").alias("posting_id"),
        F.col("doc_id").alias("arrival_seq"),
        T.first_words(F.col("text"), 2).alias("job_title"),
        F.col("source").alias("company"),
        F.col("lang").alias("job_location"),
        F.col("text").alias("job_description"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), F.md5("text")).alias("job_link"),
        F.when(F.col("lang") == "fr", "contract").otherwise("").alias("contract_type"),
        F.when(F.col("lang") == "de", "full_time").when(F.col("lang") == "es", "part_time")
        .otherwise("").alias("contract_time"),
        F.when(F.col("lang") == "en", "United States").when(F.col("lang") == "fr", "Australia")
        .when(F.col("lang") == "de", "Germany").alias("search_country"),
        F.when(F.col("doc_id") % 5 != 0, F.col("n_chars") * F.lit(10.0)).alias("salary_min"),
        F.when(F.col("doc_id") % 7 != 0, F.col("n_chars") * F.lit(20.0)).alias("salary_max"),
    )


# --- views: DuckDB --------------------------------------------------------------------------

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{S}+', ' ', 'g'))"


def sql_match(x: str) -> str:
    spelled = f"replace(replace(lower({sql_norm(x)}), '&', ' and '), '/', ' / ')"
    return f"trim(regexp_replace(regexp_replace({spelled}, '[|()\\[\\]{{}}:]', ' ', 'g'), '{S}+', ' ', 'g'))"


def sql_key(x: str) -> str:
    return f"lower({sql_norm(x)})"


def sql_occurs(text: str, term: str) -> str:
    """Bounded occurrence without look-around: an edge or a non-word character on both sides."""
    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    return f"regexp_matches({text}, '(^|{NW}){quoted}($|{NW})')"


POSTINGS_SQL = f"""SELECT doc_id AS posting_id, doc_id AS arrival_seq,
  array_to_string(list_slice(string_split({sql_norm('text')}, ' '), 1, 2), ' ') AS job_title,
  source AS company, lang AS job_location, text AS job_description,
  concat('https://www.', source, '.example.com/', md5(text)) AS job_link,
  CASE lang WHEN 'fr' THEN 'contract' ELSE '' END AS contract_type,
  CASE lang WHEN 'de' THEN 'full_time' WHEN 'es' THEN 'part_time' ELSE '' END AS contract_time,
  CASE lang WHEN 'en' THEN 'United States' WHEN 'fr' THEN 'Australia' WHEN 'de' THEN 'Germany' END AS search_country,
  CASE WHEN doc_id % 5 <> 0 THEN n_chars * 10.0::DOUBLE END AS salary_min,
  CASE WHEN doc_id % 7 <> 0 THEN n_chars * 20.0::DOUBLE END AS salary_max
FROM documents"""

VOCAB_CTE = ",\n".join(f"{name} AS ({sql})" for name, sql in VOCAB_SQL.items())
P_CTE = f"postings AS ({POSTINGS_SQL})"
