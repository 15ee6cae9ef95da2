"""Page main-text extraction over the pages table."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from roleweave.functions import html as H
from roleweave.functions.arrays import let
from roleweave.operators.pages import extract_pages, extraction_report
from workload.common import S, query, sql_norm, table

_BLOCK = H._BLOCK
_RAW = r"(?is)<!--.*?(?:-->|$)|<script\b.*?(?:</script\s*>|$)|<style\b.*?(?:</style\s*>|$)"
_STRUCTURAL = "('script','style','nav','header','footer','aside','form','noscript','iframe')"
_VOID = "('area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr')"


def _strip(x):
    """Decode the references that occur in the data, then trim."""
    decoded = x
    for name, char in (("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        decoded = f"replace({decoded}, '&{name};', '{char}')"
    return f"regexp_replace({decoded}, '^{S}+|{S}+$', '', 'g')"


def sql_tokens(noise: str) -> str:
    """CTE text: kept tokens of each page, one row per token, by relational tag matching."""
    return f"""tok AS MATERIALIZED (SELECT page_id, u.i, u.t, lower(regexp_extract(u.t, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name FROM pages,
      unnest(regexp_extract_all(regexp_replace(html, '{_RAW}', '<!>', 'g'), '(?s)<[a-zA-Z/!][^>]*>|[^<]+|<')) WITH ORDINALITY AS u(t, i)),
    tags AS MATERIALIZED (SELECT *, sum(kind) OVER (PARTITION BY page_id, name ORDER BY i) AS depth FROM (SELECT *,
      CASE WHEN starts_with(t, '</') THEN -1 WHEN name IN {_VOID} OR ends_with(t, '/>') THEN 0 ELSE 1 END AS kind FROM tok WHERE name <> '')),
    noise AS (SELECT o.page_id, o.i AS s, coalesce(min(c.i), 2147483647) AS e FROM tags o LEFT JOIN tags c
      ON c.page_id = o.page_id AND c.name = o.name AND c.i > o.i AND c.depth = o.depth - 1
      WHERE o.kind = 1 AND (o.name IN {_STRUCTURAL}
        OR regexp_matches(regexp_extract(o.t, '(?i)\\sclass\\s*=\\s*"([^"]*)"', 1), '(?i){noise}')) GROUP BY o.page_id, o.i),
    kept AS MATERIALIZED (SELECT t.* FROM tok t WHERE NOT EXISTS
      (SELECT 1 FROM noise n WHERE n.page_id = t.page_id AND t.i BETWEEN n.s AND n.e))"""


_RULES = H.PageRules()
_AD = replace(_RULES, noise="^ad$")
_AD_BOX = replace(_RULES, container="^ad$")


@query(
    "x1_x2_without_noise",
    f"WITH {sql_tokens('^ad$')} SELECT page_id, count(*) AS n_tokens, string_agg(t, '' ORDER BY i) AS kept FROM kept GROUP BY page_id",
)
def x1(spark, sf):
    kept = H.without_noise(H.tokenize(F.col("html")), _AD)
    return table(spark, sf, "pages").withColumn("k", kept).select(
        "page_id", F.size("k").cast("long").alias("n_tokens"), F.array_join("k", "").alias("kept")
    )


@query(
    "x3_container_text",
    f"""WITH {sql_tokens(_RULES.noise)}, opening AS (SELECT page_id, min(i) AS s FROM kept WHERE regexp_matches(t, '(?i)\\sclass\\s*=\\s*"ad"') GROUP BY page_id),
      box AS (SELECT o.page_id, o.s, min(c.i) AS e FROM opening o JOIN kept k ON k.page_id = o.page_id AND k.i = o.s
        LEFT JOIN tags c ON c.page_id = o.page_id AND c.i > o.s AND c.name = k.name AND c.kind = -1 GROUP BY o.page_id, o.s)
      SELECT p.page_id, coalesce((SELECT string_agg({_strip('k.t')}, chr(10) ORDER BY k.i) FROM kept k, box b WHERE b.page_id = p.page_id
        AND k.page_id = p.page_id AND k.i > b.s AND k.i < b.e AND k.name = '' AND k.t <> '<!>' AND {_strip('k.t')} <> ''), '') AS box FROM pages p""",
)
def x3(spark, sf):
    tokens = H.decoded(H.without_noise(H.tokenize(F.col("html")), _AD_BOX))
    box = let(tokens, lambda tok: let(H.tag_events(tok), lambda ev: H.container_text(tok, ev, _AD_BOX)))
    return table(spark, sf, "pages").select("page_id", box.alias("box"))


SQL_BLOCKS = f"""starts AS (SELECT page_id, i AS s, name FROM kept WHERE regexp_matches(t, '(?i)^<(p|li)(\\s[^>]*)?>$')),
  spans AS (SELECT st.page_id, st.s, coalesce(min(k.i), 2147483647) AS e FROM starts st LEFT JOIN kept k ON k.page_id = st.page_id AND k.i > st.s
    AND CASE st.name WHEN 'p' THEN regexp_matches(k.t, '(?i)^</?({_BLOCK})[\\s/>]') ELSE regexp_matches(k.t, '(?i)^(</?li[\\s/>]|</(ul|ol|menu|body|html)[\\s>])') END
    GROUP BY st.page_id, st.s),
  texts AS (SELECT s.page_id, s.s, string_agg({_strip('k.t')}, ' ' ORDER BY k.i) AS block FROM spans s JOIN kept k
    ON k.page_id = s.page_id AND k.i > s.s AND k.i < s.e AND k.name = '' AND k.t <> '<!>' AND {_strip('k.t')} <> '' GROUP BY s.page_id, s.s),
  blocks AS (SELECT * FROM texts QUALIFY row_number() OVER (PARTITION BY page_id, block ORDER BY s) = 1)"""


@query(
    "x6_blocks",
    f"""WITH {sql_tokens(_RULES.noise)}, {SQL_BLOCKS} SELECT p.page_id, coalesce(b.n, 0) AS n_blocks, coalesce(b.body, '') AS body FROM pages p LEFT JOIN
      (SELECT page_id, count(*) AS n, string_agg(block, chr(10) ORDER BY s) AS body FROM blocks GROUP BY page_id) b ON b.page_id = p.page_id""",
)
def x6(spark, sf):
    tokens = H.decoded(H.without_noise(H.tokenize(F.col("html")), _RULES))
    kept = let(tokens, lambda tok: H.keep_first_by_prefix(H.blocks(tok, _RULES), _RULES.block_prefix))
    return table(spark, sf, "pages").withColumn("b", kept).select(
        "page_id", F.size("b").cast("long").alias("n_blocks"), F.array_join("b", "\n").alias("body")
    )


# No class or id of the data matches a container and no heading a section, so blocks and body decide.
SQL_MAIN = f"""WITH {sql_tokens(_RULES.noise)}, {SQL_BLOCKS},
  b6 AS (SELECT page_id, string_agg(block, chr(10) ORDER BY s) AS body FROM blocks GROUP BY page_id),
  edge AS (SELECT page_id, min(i) FILTER (name = 'body' AND NOT starts_with(t, '</')) AS s,
    coalesce(min(i) FILTER (name = 'body' AND starts_with(t, '</')), 2147483647) AS e FROM kept GROUP BY page_id),
  b7 AS (SELECT k.page_id, string_agg({_strip('k.t')}, chr(10) ORDER BY k.i) AS body FROM kept k JOIN edge e ON e.page_id = k.page_id
    WHERE k.i > e.s AND k.i < e.e AND k.name = '' AND k.t <> '<!>' AND {_strip('k.t')} <> '' GROUP BY k.page_id),
  picked AS (SELECT p.page_id, p.url, CASE WHEN length(coalesce(b6.body, '')) < 100 AND length(coalesce(b7.body, '')) > CASE coalesce(b6.body, '') WHEN '' THEN 0 ELSE 300 END THEN 'body'
      WHEN coalesce(b6.body, '') <> '' THEN 'blocks' ELSE 'none' END AS step, b6.body AS t6, b7.body AS t7
    FROM pages p LEFT JOIN b6 ON b6.page_id = p.page_id LEFT JOIN b7 ON b7.page_id = p.page_id),
  main AS (SELECT page_id, url, step, {sql_norm("CASE step WHEN 'body' THEN t7 WHEN 'blocks' THEN t6 ELSE '' END")} AS text FROM picked)"""


@query("x7_x8_main_text", f"{SQL_MAIN} SELECT page_id, url, step, text, length(text) AS n_chars FROM main")
def x8(spark, sf):
    return extract_pages(table(spark, sf, "pages")).withColumn("n_chars", F.col("n_chars").cast("long"))


@query(
    "x9_extraction_report",
    f"""{SQL_MAIN} SELECT step, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, min(length(text)) AS shortest,
      max(length(text)) AS longest FROM main GROUP BY step""",
)
def x9(spark, sf):
    return extraction_report(extract_pages(table(spark, sf, "pages")))


SQL_BOX = f"""opening AS (SELECT page_id, min(i) AS s FROM kept WHERE regexp_matches(t, '(?i)\\sclass\\s*=\\s*"ad"') GROUP BY page_id),
  box AS (SELECT o.page_id, o.s, min(c.i) AS e FROM opening o JOIN kept k ON k.page_id = o.page_id AND k.i = o.s
    LEFT JOIN tags c ON c.page_id = o.page_id AND c.i > o.s AND c.name = k.name AND c.kind = -1 GROUP BY o.page_id, o.s),
  b4 AS (SELECT b.page_id, string_agg({_strip('k.t')}, chr(10) ORDER BY k.i) AS body FROM box b JOIN kept k ON k.page_id = b.page_id
    WHERE k.i > b.s AND k.i < b.e AND k.name = '' AND k.t <> '<!>' AND {_strip('k.t')} <> '' GROUP BY b.page_id)"""


@query(
    "x4_vendor_text",
    f"""{SQL_MAIN}, {SQL_BOX}, v AS (SELECT p.*, CASE WHEN length(b4.body) > 50 THEN b4.body END AS t4 FROM picked p LEFT JOIN b4 USING (page_id)),
      w AS (SELECT *, CASE WHEN length(coalesce(t4, t6, '')) < 100 AND length(coalesce(t7, '')) > CASE coalesce(t4, t6, '') WHEN '' THEN 0 ELSE 300 END THEN 'body' WHEN t4 IS NOT NULL THEN 'vendor'
        WHEN coalesce(t6, '') <> '' THEN 'blocks' ELSE 'none' END AS step4 FROM v),
      x AS (SELECT page_id, url, step4 AS step, {sql_norm("CASE step4 WHEN 'body' THEN t7 WHEN 'vendor' THEN t4 WHEN 'blocks' THEN t6 ELSE '' END")} AS text FROM w)
      SELECT page_id, url, step, text, length(text) AS n_chars FROM x""",
)
def x4(spark, sf):
    """Vendor containers; the class of the data's one marked box stands in for a vendor's."""
    rules = replace(_RULES, container="^none$", vendor=("absent", "^ad$"))
    found = extract_pages(table(spark, sf, "pages"), rules=rules)
    return found.withColumn("n_chars", F.col("n_chars").cast("long"))


_SECTION = r"(?:^|[^a-zA-Z0-9_])(?:the|la|der|de)(?:[^a-zA-Z0-9_]|$)"
# The data's headings stand in an article of paragraphs; unclosed <b> elements end with the article, so nothing follows them.
SQL_SECTIONS = f"""heads AS (SELECT o.page_id, o.i AS s, min(c.i) AS e FROM kept o JOIN kept c ON c.page_id = o.page_id AND c.i > o.i
    AND c.name = o.name AND starts_with(c.t, '</') WHERE regexp_matches(o.name, '^h[1-6]$') AND NOT starts_with(o.t, '</') GROUP BY o.page_id, o.i),
  sections AS (SELECT h.page_id, h.e FROM heads h JOIN kept k ON k.page_id = h.page_id AND k.i > h.s AND k.i < h.e AND k.name = '' AND k.t <> '<!>'
    AND {_strip('k.t')} <> '' GROUP BY h.page_id, h.s, h.e HAVING regexp_matches(string_agg({_strip('k.t')}, ' ' ORDER BY k.i), '(?i){_SECTION}')),
  reach AS (SELECT x.page_id, x.e AS s, coalesce(min(k.i), 2147483647) AS e FROM sections x LEFT JOIN kept k ON k.page_id = x.page_id AND k.i > x.e
    AND (regexp_matches(k.t, '(?i)^<h[1-6][\\s>]') OR k.name IN ('article', 'body', 'html') AND starts_with(k.t, '</')) GROUP BY x.page_id, x.e),
  siblings AS (SELECT r.page_id, r.s AS h, o.i AS s, least(r.e, coalesce(min(c.i), 2147483647)) AS e FROM reach r
    JOIN kept o ON o.page_id = r.page_id AND o.i > r.s AND o.i < r.e AND o.name = 'p' AND NOT starts_with(o.t, '</')
    LEFT JOIN kept c ON c.page_id = o.page_id AND c.i > o.i AND c.name = 'p' GROUP BY r.page_id, r.s, r.e, o.i),
  chunks AS (SELECT b.page_id, b.h, b.s, string_agg({_strip('k.t')}, ' ' ORDER BY k.i) AS chunk FROM siblings b JOIN kept k
    ON k.page_id = b.page_id AND k.i > b.s AND k.i < b.e AND k.name = '' AND k.t <> '<!>' AND {_strip('k.t')} <> '' GROUP BY b.page_id, b.h, b.s),
  b5 AS (SELECT page_id, string_agg(chunk, chr(10) ORDER BY h, s) AS body FROM chunks GROUP BY page_id)"""


@query(
    "x5_heading_text",
    f"""{SQL_MAIN}, {SQL_SECTIONS}, v AS (SELECT p.*, b5.body AS t5 FROM picked p LEFT JOIN b5 USING (page_id)),
      w AS (SELECT *, CASE WHEN length(coalesce(t5, t6, '')) < 100 AND length(coalesce(t7, '')) > CASE coalesce(t5, t6, '') WHEN '' THEN 0 ELSE 300 END THEN 'body' WHEN t5 IS NOT NULL THEN 'headings'
        WHEN coalesce(t6, '') <> '' THEN 'blocks' ELSE 'none' END AS step5 FROM v),
      x AS (SELECT page_id, url, step5 AS step, {sql_norm("CASE step5 WHEN 'body' THEN t7 WHEN 'headings' THEN t5 WHEN 'blocks' THEN t6 ELSE '' END")} AS text FROM w)
      SELECT page_id, url, step, text, length(text) AS n_chars FROM x""",
)
def x5(spark, sf):
    """Texts that follow headings which contain one of the data's frequent words."""
    rules = replace(_RULES, section=_SECTION)
    found = extract_pages(table(spark, sf, "pages"), rules=rules)
    return found.withColumn("n_chars", F.col("n_chars").cast("long"))
