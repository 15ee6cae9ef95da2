"""Text functions over documents, conversations, pages, customer, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from roleweave.functions import text as T
from roleweave.vocabulary import map_literal
from workload.common import P_CTE, VOCAB_CTE, postings, query, sql_match, sql_norm, table, vocabulary


@query("t1_normalize", f"SELECT doc_id, {sql_norm('text')} AS clean FROM documents")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize(F.col("text")).alias("clean"))


@query(
    "t2_clean_text",
    f"SELECT conv_id, turn, {sql_norm('text')} AS clean, length({sql_norm('text')}) AS n FROM conversations",
)
def t2(spark, sf):
    clean = T.normalize(F.col("text"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", clean.alias("clean"), F.length(clean).cast("long").alias("n")
    )


@query("t3_match_text", f"SELECT doc_id, {sql_match('text')} AS matching FROM documents")
def t3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.match_text(F.col("text")).alias("matching"))


_NAMES = (
    "SELECT {fields} FROM (SELECT p_partkey, replace(p_name, ' ', CASE WHEN p_size % 3 = 0 THEN ' , ' "
    "WHEN p_size % 3 = 1 THEN ';' ELSE '|' END) || CASE WHEN p_size % 4 = 0 THEN ',' ELSE ', RED ' END AS listed, "
    "CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS kind FROM part)"
)


def _listed(spark, sf):
    sep = (
        F.when(F.col("p_size") % 3 == 0, F.lit(" , ")).when(F.col("p_size") % 3 == 1, F.lit(";"))
        .otherwise(F.lit("|"))
    )
    tail = F.when(F.col("p_size") % 4 == 0, F.lit(",")).otherwise(F.lit(", RED "))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(F.replace("p_name", F.lit(" "), sep), tail).alias("listed"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("kind"),
    )


@query("t4_blank_to_null", _NAMES.format(fields="p_partkey, nullif(kind, '') AS kind"))
def t4(spark, sf):
    return _listed(spark, sf).select("p_partkey", T.blank_to_null(F.col("kind")).alias("kind"))


@query("t5_rename", "SELECT conv_id, turn, text AS job_description FROM conversations")
def t5(spark, sf):
    return (
        table(spark, sf, "conversations").withColumnRenamed("text", "job_description")
        .select("conv_id", "turn", "job_description")
    )


def _sql_items(pattern):
    return (
        "array_to_string(list_filter(list_transform(regexp_split_to_array(listed, "
        f"'{pattern}'), lambda x: lower(trim(x))), lambda x: x <> ''), '~') AS items"
    )


@query("t6_split_items", _NAMES.format(fields="p_partkey, " + _sql_items(",")))
def t6(spark, sf):
    return _listed(spark, sf).select(
        "p_partkey", T.join_list(T.split_items(F.col("listed")), "~").alias("items")
    )


@query("t7_split_typed", _NAMES.format(fields="p_partkey, " + _sql_items("[,;|]")))
def t7(spark, sf):
    return _listed(spark, sf).select(
        "p_partkey", T.join_list(T.split_typed(F.col("listed")), "~").alias("items")
    )


@query(
    "t8_concat_text",
    "SELECT p_partkey, concat(coalesce(p_name, ''), ' ', coalesce(CASE WHEN p_size > 25 THEN p_type END, ''), "
    "' ', coalesce(p_brand, '')) AS job_text FROM part",
)
def t8(spark, sf):
    rare = F.when(F.col("p_size") > 25, F.col("p_type"))
    return table(spark, sf, "part").select(
        "p_partkey", T.join_fields(" ", F.col("p_name"), rare, F.col("p_brand")).alias("job_text")
    )


@query(
    "t9_posting_text",
    f"WITH {P_CTE} SELECT posting_id, concat(job_title, ' | ', job_description, ' | ', '', ' | ', company, ' | ', "
    "coalesce(nullif(job_location, 'es'), '')) AS job_text FROM postings",
)
def t9(spark, sf):
    place = F.when(F.col("job_location") != "es", F.col("job_location"))
    return postings(spark, sf).select(
        "posting_id",
        T.posting_text(F.col("job_title"), F.col("job_description"), F.lit(None), F.col("company"), place)
        .alias("job_text"),
    )


@query(
    "t10_join_list",
    "SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(floor(x * 10) AS INTEGER)), ', ') AS joined FROM embeddings",
)
def t10(spark, sf):
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * 10).cast("int").cast("string"))
    return table(spark, sf, "embeddings").select("vec_id", T.join_list(ints).alias("joined"))


@query(
    "t11_parse_date",
    "SELECT event_id, CAST(epoch(TRY_CAST(CASE WHEN event_id % 4 = 0 THEN 'n/a ' || event_type ELSE "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP)) AS BIGINT) AS seen FROM events",
)
def t11(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("n/a "), "event_type")).otherwise(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    )
    return table(spark, sf, "events").select(
        "event_id", F.unix_timestamp(T.parse_date(raw)).alias("seen")
    )


@query(
    "t12_parse_number",
    "SELECT event_id, round(CASE WHEN isnan(v) THEN NULL ELSE v END, 6) AS amount FROM (SELECT event_id, "
    "TRY_CAST(CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN 'NaN' WHEN 2 THEN '' ELSE "
    "CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END AS DOUBLE) AS v FROM events)",
)
def t12(spark, sf):
    k = F.col("event_id") % 5
    raw = (
        F.when(k == 0, F.col("event_type")).when(k == 1, "NaN").when(k == 2, "")
        .otherwise(F.round(F.col("value") * 100).cast("long").cast("string"))
    )
    return table(spark, sf, "events").select(
        "event_id", F.round(T.parse_number(raw), 6).alias("amount")
    )


_SQL_TITLE = (
    "array_to_string(list_transform(regexp_extract_all({0}, '\\p{{L}}+|[^\\p{{L}}]+'), "
    "lambda x: CASE x[1] WHEN 'ß' THEN 'Ss' ELSE upper(x[1]) END || x[2:]), '')"
)
_SQL_DISPLAY = (
    "CASE WHEN d.display_name IS NOT NULL THEN d.display_name WHEN contains({0}, ' ') THEN "
    + _SQL_TITLE
    + " WHEN regexp_matches({0}, '^\\p{{L}}+$') THEN CASE {0}[1] WHEN 'ß' THEN 'Ss' ELSE upper({0}[1]) END || {0}[2:] ELSE {0} END"
)


@query(
    "t13_display_name",
    f"WITH {VOCAB_CTE}, {P_CTE}, terms AS (SELECT posting_id, lower(job_title) AS a, "
    f"lower(regexp_extract(job_title, '^[^ ]+')) AS b FROM postings), "
    "pairs AS (SELECT posting_id, 'phrase' AS kind, a AS t FROM terms UNION ALL SELECT posting_id, 'word', b FROM terms) "
    f"SELECT posting_id, kind, {_SQL_DISPLAY.format('t')} AS shown FROM pairs LEFT JOIN display d ON d.term = t",
)
def t13(spark, sf):
    names = map_literal(vocabulary(spark).displays)
    title = F.col("job_title")
    shown = F.explode(
        F.array(
            F.struct(F.lit("phrase").alias("kind"), T.display_name(title, names).alias("shown")),
            F.struct(
                F.lit("word").alias("kind"),
                T.display_name(F.split(title, " ")[0], names).alias("shown"),
            ),
        )
    )
    return postings(spark, sf).select("posting_id", shown.alias("s")).select("posting_id", "s.*")


@query(
    "t14_display_list",
    f"WITH {VOCAB_CTE}, {P_CTE}, words AS (SELECT posting_id, u.i, lower(u.w) AS t FROM postings, "
    f"unnest(string_split(job_title, ' ')) WITH ORDINALITY AS u(w, i)) "
    f"SELECT posting_id, string_agg({_SQL_DISPLAY.format('t')}, ', ' ORDER BY i) AS shown FROM words "
    "LEFT JOIN display d ON d.term = t GROUP BY posting_id",
)
def t14(spark, sf):
    names = map_literal(vocabulary(spark).displays)
    words = F.split("job_title", " ")
    return postings(spark, sf).select(
        "posting_id", T.join_list(T.display_list(words, names)).alias("shown")
    )


@query(
    "t15_link_authority",
    "SELECT page_id, lower(replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1), 'www.', '')) "
    "AS authority FROM pages",
)
def t15(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.link_authority(F.col("url")).alias("authority"))


@query(
    "t16_prefix",
    f"SELECT doc_id, substring({sql_norm('text')}, 1, 1200) AS head FROM documents",
)
def t16(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", T.prefix(T.normalize(F.col("text")), 1200).alias("head")
    )
