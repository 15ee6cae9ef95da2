"""Skill extraction over documents, conversations and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.functions.arrays import explode_items, sorted_distinct
from roleweave.operators import dictionary as D
from roleweave.operators import skills as K
from roleweave.staging import staged
from roleweave.vocabulary import Vocabulary
from workload.common import (
    ACRONYMS, ALIASES, CUES, DICTIONARY, NW, P_CTE, S, SINGLE_LETTERS, VOCAB_CTE, VOCAB_SQL, postings, query, sql_match, sql_norm, sql_occurs, table, values, vocabulary,
)

_KNOWN = "known AS (SELECT DISTINCT term FROM skill WHERE dictionary OR approved)"


def sql_valid(s: str) -> str:
    def kind(k):
        return f"(SELECT term FROM stop WHERE kind = '{k}')"

    return f"""CASE WHEN {s} IN (SELECT term FROM skill WHERE single_letter) THEN true
      WHEN length({s}) NOT BETWEEN 2 AND 40 OR {s} IN {kind('generic')}
        OR regexp_matches({s}, '^\\p{{Nd}}{{5}}') OR contains({s}, '&') OR contains({s}, 'http')
        OR contains({s}, 'www.') OR contains({s}, '@') OR {s} IN {kind('location')}
        OR list_has_any(regexp_split_to_array({s}, '{S}+'), (SELECT list(term) FROM stop WHERE kind = 'institution'))
        OR NOT regexp_matches({s}, '[a-z0-9+#]') OR regexp_matches({s}, '^\\p{{Nd}}+$') THEN false
      WHEN {s} IN (SELECT term FROM known) THEN true
      WHEN regexp_matches({s}, '{S}') THEN false
      ELSE NOT regexp_matches({s}, '(^|{NW})(citizen|citizenship|clearance)($|{NW})') END"""


def sql_gate(found: str, out: str) -> str:
    """CTE text: one alias step, membership, validity."""
    return f"""{out}_named AS (SELECT DISTINCT id, coalesce(a.canonical, f.found) AS skill
      FROM {found} f LEFT JOIN alias a ON a.variant = f.found),
    {out} AS (SELECT id, skill FROM {out}_named WHERE skill IN (SELECT term FROM known) AND {sql_valid('skill')})"""


def sql_scan(texts: str, out: str) -> str:
    """CTE text: dictionary and alias occurrences in ``texts(id, matching)``."""
    forms = [(t, t) for t in DICTIONARY if not (len(t) == 1 and t in SINGLE_LETTERS)]
    return out + " AS (" + " UNION ".join(
        f"SELECT id, '{found}' AS found FROM {texts} WHERE {sql_occurs('matching', form)}"
        for form, found in forms + list(ALIASES.items())
    ) + ")"


def sql_letters(texts: str, out: str) -> str:
    left, right = "(?:^|[,;:\\s/(\\[])", "(?:$|[,;:\\s/)\\]])"
    hits = " UNION ".join(
        f"SELECT id, '{t}' AS found FROM {out}_pieces WHERE regexp_matches(piece, '{left}{t}{right}')"
        for t in DICTIONARY if t in SINGLE_LETTERS
    )
    return f"""{out}_pieces AS MATERIALIZED (SELECT id, matching AS piece FROM {texts} UNION ALL
      SELECT id, piece FROM (SELECT id, trim(unnest(regexp_split_to_array(matching, '[.;•●○–—]'))) AS piece FROM {texts})
      WHERE length(piece) >= 1),
    {out} AS ({hits})"""


def sql_acronyms(texts: str, out: str) -> str:
    hits = " UNION ".join(
        f"SELECT id, '{t}' AS term FROM {texts} WHERE {sql_occurs('lower(raw)', t)}" for t in ACRONYMS
    )
    return f"""{out} AS (SELECT id, found FROM (SELECT t.id, coalesce(a.canonical, t.term) AS found
      FROM ({hits}) t LEFT JOIN alias a ON a.variant = t.term) WHERE found IN (SELECT term FROM known))"""


def sql_tokens_known(tokens: str, out: str) -> str:
    """CTE text: ``tokens(id, token)`` -> known, valid terms after one alias step."""
    return f"""{out} AS (SELECT id, found FROM (SELECT t.id, coalesce(a.canonical, t.token) AS found
      FROM {tokens} t LEFT JOIN alias a ON a.variant = t.token)
      WHERE found IN (SELECT term FROM known) AND {sql_valid('found')})"""


def _trimmed(x: str) -> str:
    return f"lower(regexp_replace({x}, '^[ .:-]+|[ .:-]+$', '', 'g'))"


def sql_requirements(texts: str, out: str) -> str:
    body = sql_match("regexp_replace(raw, '\\([^\\n]*?\\)', ' ', 'g')")
    lists = " UNION ALL ".join(
        f"SELECT id, unnest(regexp_extract_all(body, '{cue}', 1)) AS m FROM {out}_body" for cue in CUES
    )
    return f"""{out}_body AS (SELECT id, {body} AS body FROM {texts}),
    {out}_lists AS ({lists}),
    {out}_parts AS (SELECT id, {_trimmed('p')} AS token FROM
      (SELECT id, unnest(regexp_split_to_array(m, ',|;|/|\\band\\b|\\bor\\b')) AS p FROM {out}_lists)),
    {sql_tokens_known(out + '_parts', out)}"""


def sql_colons(texts: str, out: str) -> str:
    return f"""{out}_lines AS (SELECT id, unnest(regexp_split_to_array(raw, '\\r\\n|[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS line FROM {texts}),
    {out}_right AS (SELECT id, regexp_replace(substring(line, strpos(line, ':') + 1), '\\(.*?\\)', '', 'g') AS r
      FROM {out}_lines WHERE contains(line, ':')),
    {out}_whole AS (SELECT id, {_trimmed('p')} AS token FROM
      (SELECT id, unnest(regexp_split_to_array(r, '[,;|]')) AS p FROM {out}_right)),
    {out}_parts AS (SELECT id, token FROM {out}_whole WHERE token IN (SELECT term FROM known)
        OR token IN (SELECT variant FROM alias) OR NOT contains(token, '/')
      UNION ALL SELECT id, trim(unnest(string_split(token, '/'))) FROM {out}_whole
        WHERE token NOT IN (SELECT term FROM known) AND token NOT IN (SELECT variant FROM alias) AND contains(token, '/')),
    {out}_kept AS (SELECT id, token FROM {out}_parts WHERE token <> '' AND NOT regexp_matches(token, '^(https?://|www\\.)')
      AND NOT list_has_any(regexp_split_to_array(token, '{S}+'), (SELECT list(term) FROM stop WHERE kind = 'institution'))),
    {sql_tokens_known(out + '_kept', out)}"""


def sql_listed(ids: str, gated: str) -> str:
    return f"""SELECT i.id AS doc_id, coalesce(string_agg(g.skill, '|' ORDER BY g.skill), '') AS skills
      FROM {ids} i LEFT JOIN {gated} g ON g.id = i.id GROUP BY i.id"""


_DOCS = f"texts AS MATERIALIZED (SELECT doc_id AS id, text AS raw, {sql_match('text')} AS matching FROM documents)"
_BASE = f"WITH {VOCAB_CTE}, {_KNOWN}"


def _joined(col):
    return T.join_list(sorted_distinct(col), "|")


def _extractor(spark):
    return K.SkillExtractor(spark, vocabulary(spark), CUES)


def _surfaces(spark, kind):
    vocab = vocabulary(spark)
    return kind(vocab, K.valid_known_terms(spark, vocab))


@query(
    "e3_dictionary_scan",
    f"{_BASE}, {_DOCS}, {sql_scan('texts', 'scan')}, {sql_gate('scan', 'gated')} {sql_listed('texts', 'gated')}",
)
def e3(spark, sf):
    matcher = K.TextMatcher(_surfaces(spark, K.scan_surfaces))
    return table(spark, sf, "documents").select(
        "doc_id", _joined(matcher.in_text(T.match_text(F.col("text")))).alias("skills")
    )


@query(
    "e3_scan_by_join",
    f"{_BASE}, {_DOCS}, {sql_scan('texts', 'scan')}, {sql_gate('scan', 'gated')} SELECT id AS doc_id, skill FROM gated",
)
def e3_join(spark, sf):
    surfaces = _surfaces(spark, K.scan_surfaces)
    rows = spark.sql(values([(s, c) for s, cs in surfaces.items() for c in cs], "surface, canonical"))
    docs = table(spark, sf, "documents").select("doc_id", T.match_text(F.col("text")).alias("matching"))
    return K.scan_terms_by_join(docs, "doc_id", "matching", rows)


@query(
    "e3d_acronyms",
    f"{_BASE}, {_DOCS}, {sql_acronyms('texts', 'acr')}, {sql_gate('acr', 'gated')} {sql_listed('texts', 'gated')}",
)
def e3d(spark, sf):
    matcher = K.TextMatcher(_surfaces(spark, K.acronym_surfaces))
    return table(spark, sf, "documents").select(
        "doc_id", _joined(matcher.in_text(F.lower("text"))).alias("skills")
    )


@query(
    "e3b_e6_single_letters",
    f"{_BASE}, {_DOCS}, {sql_letters('texts', 'letters')}, {sql_gate('letters', 'gated')} {sql_listed('texts', 'gated')}",
)
def e6(spark, sf):
    letters = _surfaces(spark, K.letter_surfaces)
    return table(spark, sf, "documents").select(
        "doc_id", _joined(K.single_letter_hits(T.match_text(F.col("text")), letters)).alias("skills")
    )


@query(
    "e5_requirement_phrases",
    f"{_BASE}, {_DOCS}, {sql_requirements('texts', 'req')}, {sql_gate('req', 'gated')} {sql_listed('texts', 'gated')}",
)
def e5(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", _joined(_extractor(spark).requirement_hits(F.col("text"), T.match_text(F.col("text")))).alias("skills")
    )


_TURNS = (
    "texts AS MATERIALIZED (SELECT conv_id * 1000 + turn AS id, raw, {m} AS matching FROM (SELECT conv_id, turn, "
    "text || chr(10) || 'at https://the.example/with www.der.example/die' || chr(10) || role || ': ' || "
    "replace(replace(text, ' ', ', '), 'le', 'der/le') AS raw FROM conversations))"
)


def _turns(spark, sf):
    listed = F.replace(F.replace("text", F.lit(" "), F.lit(", ")), F.lit("le"), F.lit("der/le"))
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.concat(
            "text", F.lit("\nat https://the.example/with www.der.example/die\n"), "role", F.lit(": "), listed
        ).alias("raw"),
    )


@query(
    "e4_colon_lines",
    f"{_BASE}, {_TURNS.format(m='NULL')}, {sql_colons('texts', 'col')}, {sql_gate('col', 'gated')} {sql_listed('texts', 'gated')}",
)
def e4(spark, sf):
    return _turns(spark, sf).select(
        "doc_id", _joined(_extractor(spark).colon_hits(F.col("raw"))).alias("skills")
    )


def sql_posting_skills(texts: str, p: str = "") -> str:
    """CTE chain ending in ``gated(id, skill)`` for ``texts(id, raw, matching)``; ``p`` prefixes names."""
    return f"""{sql_scan(texts, p + 'scan')}, {sql_acronyms(texts, p + 'acr')}, {sql_letters(texts, p + 'letters')},
      {sql_requirements(texts, p + 'req')},
      {p}every AS (SELECT * FROM {p}scan UNION SELECT * FROM {p}acr UNION SELECT * FROM {p}letters UNION SELECT * FROM {p}req),
      {sql_gate(p + 'every', p + 'gated')}"""


POSTING_TEXTS = f"""texts AS MATERIALIZED (SELECT posting_id AS id, raw, {sql_match('raw')} AS matching FROM
  (SELECT posting_id, job_title || chr(10) || job_description AS raw FROM postings))"""


@query(
    "e1_posting_skills",
    f"{_BASE}, {P_CTE}, {POSTING_TEXTS}, {sql_posting_skills('texts')} {sql_listed('texts', 'gated')}",
)
def e1(spark, sf):
    found = _extractor(spark).posting_skills(F.col("job_title"), F.col("job_description"))
    return postings(spark, sf).select(F.col("posting_id").alias("doc_id"), T.join_list(found, "|").alias("skills"))


_CLEAN_TURNS = (
    _TURNS.format(m="NULL").replace("texts AS MATERIALIZED", "given AS")
    + f""", texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM (SELECT id,
      regexp_replace(regexp_replace(raw, 'https?://[^{S[1:-1]}]+', ' ', 'g'), 'www\\.[^{S[1:-1]}]+', ' ', 'g') AS raw FROM given))"""
)


@query(
    "e2_resume_skills",
    f"""{_BASE}, {_CLEAN_TURNS}, {sql_scan('texts', 'scan')}, {sql_acronyms('texts', 'acr')},
      {sql_letters('texts', 'letters')}, {sql_requirements('texts', 'req')}, {sql_colons('texts', 'col')},
      every AS (SELECT * FROM scan UNION SELECT * FROM acr UNION SELECT * FROM letters UNION SELECT * FROM req
        UNION SELECT * FROM col), {sql_gate('every', 'gated')} {sql_listed('texts', 'gated')}""",
)
def e2(spark, sf):
    return _turns(spark, sf).select(
        "doc_id", T.join_list(_extractor(spark).resume_skills(F.col("raw")), "|").alias("skills")
    )


_WORDS = f"words AS (SELECT DISTINCT unnest(string_split(lower({sql_norm('text')}), ' ')) AS word FROM documents)"


def _words(spark, sf):
    words = F.array_distinct(F.split(F.lower(T.normalize(F.col("text"))), " "))
    return explode_items(table(spark, sf, "documents"), [], words, "word").distinct()


@query("e7_valid_skill", f"{_BASE}, {_WORDS} SELECT word, {sql_valid('word')} AS valid FROM words")
def e7(spark, sf):
    return _words(spark, sf).select("word", K.valid_skill(F.col("word"), vocabulary(spark)).alias("valid"))


@query(
    "e8_gate",
    f"""{_BASE}, {_WORDS}, tokens AS (SELECT word AS id, word AS token FROM words),
      {sql_tokens_known('tokens', 'named')}, {sql_gate('named', 'gated')} SELECT id AS word, skill FROM gated""",
)
def e8(spark, sf):
    matcher = K.TokenMatcher(_surfaces(spark, K.token_surfaces))
    return explode_items(_words(spark, sf), ["word"], matcher.in_tokens(F.array("word")), "skill")


@query(
    "e9_known_skill",
    f"""{_BASE}, {_WORDS} SELECT word, word <> '' AND coalesce(a.canonical, word) IN (SELECT term FROM known) AS known
      FROM words LEFT JOIN alias a ON a.variant = word""",
)
def e9(spark, sf):
    return _words(spark, sf).select("word", K.known_skill(F.col("word"), vocabulary(spark)).alias("known"))


_SLASHED = """items AS (SELECT p_partkey AS id, unnest([replace(p_name, ' ', '/'), ' /' || lower(p_type) || '/ the',
  'von der', 'Von Der/' || p_brand]) AS raw FROM part),
  tokens AS (SELECT id, lower(trim(raw)) AS token FROM items),
  parts AS (SELECT id, token AS part FROM tokens WHERE token IN (SELECT term FROM known)
      OR token IN (SELECT variant FROM alias) OR NOT contains(token, '/')
    UNION ALL SELECT id, trim(unnest(string_split(token, '/'))) FROM tokens WHERE NOT (token IN (SELECT term FROM known)
      OR token IN (SELECT variant FROM alias) OR NOT contains(token, '/')))"""


def _slashed(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array(
            F.replace("p_name", F.lit(" "), F.lit("/")),
            F.concat(F.lit(" /"), F.lower("p_type"), F.lit("/ the")),
            F.lit("von der"),
            F.concat(F.lit("Von Der/"), "p_brand"),
        ).alias("items"),
    )


@query(
    "e10_split_slashes",
    f"""{_BASE}, {_SLASHED} SELECT id AS p_partkey, string_agg(part, '|' ORDER BY part) AS parts
      FROM parts WHERE part <> '' GROUP BY id""",
)
def e10(spark, sf):
    parts = F.sort_array(K.split_slashes(F.col("items"), vocabulary(spark)))
    return _slashed(spark, sf).select("p_partkey", T.join_list(parts, "|").alias("parts"))


@query(
    "e11_canonicalize",
    f"""{_BASE}, {_SLASHED}, named AS (SELECT DISTINCT id, coalesce(a.canonical, part) AS skill FROM parts
      LEFT JOIN alias a ON a.variant = part WHERE part <> '')
      SELECT id AS p_partkey, string_agg(skill, '|' ORDER BY skill) AS skills FROM named
      WHERE {sql_valid('skill')} GROUP BY id""",
)
def e11(spark, sf):
    skills = K.canonicalize(F.col("items"), vocabulary(spark))
    return _slashed(spark, sf).select("p_partkey", T.join_list(skills, "|").alias("skills"))


@query(
    "e11_canonicalize_rows",
    f"""{_BASE}, tokens AS (SELECT DISTINCT doc_id AS id, unnest(string_split(lower({sql_norm('text')}), ' ')) AS token FROM documents),
      parts AS (SELECT id, token AS part FROM tokens WHERE NOT contains(token, '/') OR token IN (SELECT term FROM known)
          OR token IN (SELECT variant FROM alias)
        UNION ALL SELECT id, unnest(string_split(token, '/')) FROM tokens WHERE contains(token, '/')
          AND token NOT IN (SELECT term FROM known) AND token NOT IN (SELECT variant FROM alias)),
      named AS (SELECT DISTINCT id, coalesce(a.canonical, part) AS skill FROM parts
        LEFT JOIN alias a ON a.variant = part WHERE part <> '')
      SELECT id AS doc_id, count(*) AS n_skills FROM named WHERE {sql_valid('skill')} GROUP BY id""",
)
def e11_rows(spark, sf):
    words = F.array_distinct(F.split(F.lower(T.normalize(F.col("text"))), " "))
    long = explode_items(table(spark, sf, "documents"), ["doc_id"], words, "word")
    return (
        K.canonicalize_rows(long, vocabulary(spark), "doc_id", "word")
        .groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_skills"))
    )


_QUALITY = f"""{_BASE}, {P_CTE}, {POSTING_TEXTS}, {sql_posting_skills('texts')},
  expected AS (SELECT DISTINCT id, token AS skill FROM (SELECT posting_id AS id,
    unnest(string_split(lower({sql_norm('job_description')}), ' ')) AS token FROM postings) WHERE token IN (SELECT term FROM known)),
  quality AS (SELECT coalesce(e.id, g.id) AS id, count(*) FILTER (e.id IS NOT NULL AND g.id IS NOT NULL) AS found,
    count(*) FILTER (g.id IS NULL) AS missed, count(*) FILTER (e.id IS NULL) AS unexpected
    FROM expected e FULL JOIN gated g ON g.id = e.id AND g.skill = e.skill GROUP BY 1)"""


def _quality_inputs(spark, sf):
    vocab = vocabulary(spark)
    p = postings(spark, sf)
    words = F.array_intersect(
        F.split(F.lower(T.normalize(F.col("job_description"))), " "), K.array_literal(vocab.known)
    )
    name = F.col("posting_id").alias("name")
    expected = explode_items(p, [name], words, "skill")
    found = _extractor(spark).posting_skills(F.col("job_title"), F.col("job_description"))
    extracted = explode_items(p, [name], found, "skill")
    return expected, extracted


@query(
    "e12_extraction_quality",
    f"""{_QUALITY} SELECT id AS name, found, missed, unexpected,
      round(found * 100.0::DOUBLE / greatest(found + missed, 1), 6) AS coverage FROM quality""",
)
def e12(spark, sf):
    return K.extraction_quality(*_quality_inputs(spark, sf)).withColumn("coverage", F.round("coverage", 6))


@query(
    "e12_a11_verdict",
    f"""{_QUALITY}, total AS (SELECT CAST(sum(found) AS BIGINT) AS found, CAST(sum(found + missed) AS BIGINT) AS expected FROM quality)
      SELECT found, expected, round(found * 100.0::DOUBLE / greatest(expected, 1), 6) AS coverage,
      CASE WHEN found * 100.0 / greatest(expected, 1) >= 90 THEN 'PASS'
        WHEN found * 100.0 / greatest(expected, 1) >= 75 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM total""",
)
def e12_verdict(spark, sf):
    quality = K.extraction_quality(*_quality_inputs(spark, sf))
    return K.quality_verdict(quality).withColumn("coverage", F.round("coverage", 6))


@query(
    "a12_missed_skills",
    f"""{_QUALITY} SELECT DISTINCT e.skill FROM expected e LEFT JOIN gated g ON g.id = e.id AND g.skill = e.skill
      WHERE g.id IS NULL""",
)
def a12(spark, sf):
    return K.missed_skills(*_quality_inputs(spark, sf))


# --- dictionaries of any size: terms and aliases taken from the corpus ------------------------

_CORPUS_TERMS = r"""corpus_terms AS MATERIALIZED (SELECT DISTINCT term FROM (
    SELECT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents UNION ALL
    SELECT regexp_extract(lower(text), '^[a-z]+ [a-z]+') FROM documents) WHERE term <> ''),
  skill AS MATERIALIZED (SELECT term, true AS dictionary, false AS approved, false AS acronym, false AS single_letter FROM corpus_terms),
  alias AS MATERIALIZED (SELECT term AS variant, substring(term, 1, 6) AS canonical FROM corpus_terms WHERE length(term) = 8 AND NOT contains(term, ' '))"""
_ANY = "WITH " + ",\n".join(f"{name} AS ({sql})" for name, sql in VOCAB_SQL.items() if name not in ("skill", "alias")) + f", {_CORPUS_TERMS}, {_KNOWN}"
_ANY_SCAN = """pieces AS (SELECT id, u.tok, u.i FROM texts, unnest(regexp_extract_all(matching, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')) WITH ORDINALITY AS u(tok, i)),
  forms AS (SELECT DISTINCT id, form FROM (SELECT id, tok AS form FROM pieces UNION ALL SELECT id, tok || l1 || l2 FROM
    (SELECT id, tok, lead(tok) OVER w AS l1, lead(tok, 2) OVER w AS l2 FROM pieces WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE l1 = ' ')),
  scan AS (SELECT id, found FROM forms JOIN (SELECT term AS form, term AS found FROM skill UNION SELECT variant, canonical FROM alias) USING (form))"""


def _corpus_dictionary(spark, sf):
    low = F.lower("text")
    docs = table(spark, sf, "documents")
    words = docs.select(F.explode(F.regexp_extract_all(low, F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    pairs = docs.select(F.regexp_extract(low, "^[a-z]+ [a-z]+", 0).alias("term"))
    terms = staged(words.union(pairs).where("term <> ''").distinct(), "corpus")
    flags = [F.lit(n == "dictionary").alias(n) for n in ("dictionary", "approved", "acronym", "single_letter")]
    alias = terms.where("length(term) = 8 AND NOT contains(term, ' ')").select(F.col("term").alias("variant"), F.substring("term", 1, 6).alias("canonical"))
    return D.build(terms.select("term", *flags), alias, Vocabulary(stops=vocabulary(spark).stops))


@query(
    "e1_dictionary_of_any_size",
    f"""{_ANY}, {P_CTE}, texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM
      (SELECT posting_id AS id, job_title || chr(10) || job_description AS raw FROM postings)), {_ANY_SCAN}, {sql_requirements('texts', 'req')},
      every AS (SELECT * FROM scan UNION SELECT * FROM req), {sql_gate('every', 'gated')} {sql_listed('texts', 'gated')}""",
)
def e1_any(spark, sf):
    """Every word of six letters and every first pair of words of the corpus is a term, every one of eight an alias."""
    found = D.posting_skills(postings(spark, sf), "posting_id", F.col("job_title"), F.col("job_description"), _corpus_dictionary(spark, sf), CUES)
    return found.select(F.col("posting_id").alias("doc_id"), T.join_list(F.col("skills"), "|").alias("skills"))


_CLEAN = f"regexp_replace(regexp_replace(text, 'https?://[^{S[1:-1]}]+', ' ', 'g'), 'www\\.[^{S[1:-1]}]+', ' ', 'g')"


@query(
    "e2_dictionary_of_any_size",
    f"""{_ANY}, texts AS MATERIALIZED (SELECT id, raw, {sql_match('raw')} AS matching FROM (SELECT doc_id AS id, {_CLEAN} AS raw FROM documents)),
      {_ANY_SCAN}, {sql_requirements('texts', 'req')}, {sql_colons('texts', 'col')},
      every AS (SELECT * FROM scan UNION SELECT * FROM req UNION SELECT * FROM col), {sql_gate('every', 'gated')} {sql_listed('texts', 'gated')}""",
)
def e2_any(spark, sf):
    found = D.resume_skills(table(spark, sf, "documents"), "doc_id", F.col("text"), _corpus_dictionary(spark, sf), CUES)
    return found.select("doc_id", T.join_list(F.col("skills"), "|").alias("skills"))
