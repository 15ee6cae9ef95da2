"""TF-IDF vectors and cosine similarity as joins and sums.

Weights: ``idf = ln((1 + n) / (1 + df)) + 1``, ``tf * idf``, vectors scaled to length 1.  Term
counts are made inside the row, so the (document, term) pairs are never shuffled to be counted;
what shuffles is one partial sum per term (fit) and one per document (scores).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roleweave.functions import text as T
from roleweave.functions.arrays import let, run_counts
from roleweave.operators.joins import dealt_by
from roleweave.operators.topk import best_documents, build_index, sent_if_small
from roleweave.staging import staged
from roleweave.vocabulary import one_of

# A usual vocabulary size, for callers that want that cut; the default keeps all terms.
MAX_FEATURES = 40_000
HOT_TERMS = 20_000


def term_counts(text: Column, stopwords, bigrams: bool = True) -> Column:
    """``array<struct<term, tf>>`` of a text.

    Words have two or more characters.  Stop words go first, so a bigram may span a removed word.
    """
    words = F.regexp_extract_all(F.lower(T.text_or_empty(text)), F.lit(rf"{T.WORD}{{2,}}"), F.lit(0))
    kept = F.filter(words, lambda w: ~one_of(w, stopwords)) if stopwords else words
    if not bigrams:
        return run_counts(kept)

    def with_pairs(k: Column) -> Column:
        first = F.slice(k, 1, F.greatest(F.size(k) - 1, F.lit(0)))
        return F.concat(k, F.zip_with(first, F.slice(k, 2, F.size(k)), lambda a, b: F.concat(a, F.lit(" "), b)))

    return run_counts(let(kept, with_pairs))


def explode_terms(docs: DataFrame, id_col: str, counts_col: str = "terms") -> DataFrame:
    """Long (id, term, tf) table; a projection, no shuffle.  A document without terms keeps a row."""
    return docs.select(id_col, F.inline_outer(counts_col))


def fit_vocabulary(
    docs: DataFrame, counts_col: str = "terms", max_features: int | None = None
) -> DataFrame:
    """(term, df, idf) of the corpus; the cap keeps the most frequent terms, ties by term.

    The document count includes documents without any term.
    """
    stats = (
        docs.select(F.inline_outer(counts_col))
        .where("term IS NOT NULL")
        .groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count(F.lit(1)).alias("df"))
    )
    if max_features is not None:
        stats = stats.orderBy(F.col("total").desc(), F.col("term")).limit(max_features)
    n = docs.agg(F.count(F.lit(1))).scalar()
    return stats.select("term", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def weigh(terms: DataFrame, vocabulary: DataFrame, id_col: str, capped: bool, complete: bool = False) -> DataFrame:
    """(id, term, weight) with ``weight = tf * idf``; a document without terms keeps a row with nulls.

    A capped vocabulary has at most its cap of rows and is broadcast; terms outside it keep their
    rows without weight.  An uncapped one is split: the most frequent terms, a fixed number of
    them, are broadcast, and only the other rows shuffle by term, so no frequent term gathers in one
    task; terms outside it are dropped.  ``complete`` says that it holds every term of ``terms``: those of
    one document, most of it, then need no partner, because they share one weight.
    """
    weight = F.col("tf") * F.col("idf")
    if capped:
        joined = terms.join(F.broadcast(vocabulary.select("term", "idf")), "term", "left")
        return joined.select(id_col, "term", weight.alias("weight"))
    hot = vocabulary.orderBy(F.col("df").desc(), F.col("term")).limit(HOT_TERMS)
    tagged = terms.join(F.broadcast(hot.select("term", F.col("idf").alias("_hot"))), "term", "left")
    frequent = tagged.where("_hot IS NOT NULL OR term IS NULL").withColumnRenamed("_hot", "idf")
    rest = tagged.where("_hot IS NULL AND term IS NOT NULL").drop("_hot")
    if complete:
        once = vocabulary.where("df = 1").agg(F.max("idf")).scalar()
        rest = rest.join(vocabulary.where("df > 1").select("term", "idf"), "term", "left").withColumn("idf", F.coalesce("idf", once))
    else:
        rest = rest.join(vocabulary.select("term", "idf"), "term")
    return frequent.unionByName(rest).select(id_col, "term", weight.alias("weight"))


def fitted(docs: DataFrame, doc_id: str, max_features: int | None = None, written: bool = False) -> tuple[DataFrame, DataFrame]:
    """The term lists of a corpus as (id, term, tf) rows and its vocabulary, each computed once and written.

    ``written`` says that ``docs`` is a written table; otherwise its term lists are written first.
    """
    lists = docs.select(doc_id, "terms")
    if not written:
        lists = staged(lists, "terms")
    return explode_terms(lists, doc_id), staged(fit_vocabulary(lists, max_features=max_features), "vocabulary")


def unit_weights(terms: DataFrame, vocabulary: DataFrame, wanted: DataFrame, doc_id: str, capped: bool) -> DataFrame:
    """(id, term, weight) of the ``wanted`` part of the vocabulary, scaled to documents of length 1 over all of it."""
    norms = weigh(terms, vocabulary, doc_id, capped, complete=True).groupBy(doc_id).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    if wanted.count() <= HOT_TERMS:  # all of them are broadcast, so nothing shuffles
        weights = terms.join(F.broadcast(wanted.select("term", "idf")), "term").select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("weight"))
    else:
        weights = weigh(terms, wanted, doc_id, capped=False).where("weight > 0")
    return weights.join(norms, doc_id).select(doc_id, "term", (F.col("weight") / F.col("_norm")).alias("weight"))


def query_weights(queries: DataFrame, vocabulary: DataFrame, query_id: str, counts_col: str = "terms") -> DataFrame:
    """(query, term, qw): unit vectors of the queries over the corpus vocabulary."""
    raw = (
        explode_terms(queries, query_id, counts_col)
        .join(vocabulary.select("term", "idf"), "term")
        .select(query_id, "term", (F.col("tf") * F.col("idf")).alias("w"))
    )
    norms = raw.groupBy(query_id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, query_id).select(query_id, "term", (F.col("w") / F.col("norm")).alias("qw"))


def cosine_to_query(
    docs: DataFrame, query: DataFrame, doc_id: str, max_features: int | None = None, written: bool = False
) -> DataFrame:
    """Cosine of one query against every document: (doc, similarity), zero if nothing is shared.

    ``docs`` and the one-row ``query`` carry ``terms`` arrays.
    """
    if max_features is None:
        sums = _sums_by_key(docs if written else staged(docs.select(doc_id, "terms"), "terms"), query, doc_id)
    else:
        sums = _sums_by_term(docs, query, doc_id, max_features, written)
    similarity = F.coalesce(F.try_divide("dot", "norm"), F.lit(0.0))
    return sums.select(doc_id, similarity.alias("similarity"))


def _sums_by_term(docs: DataFrame, query: DataFrame, doc_id: str, max_features: int, written: bool) -> DataFrame:
    """(doc, norm, dot) over a capped vocabulary, which goes to every task with the query's weights."""
    terms, vocabulary = fitted(docs, doc_id, max_features, written)
    q = query_weights(query.withColumn("_q", F.lit(0)), vocabulary, "_q").select("term", "qw")
    # One query has no more terms than its own text.
    scored = weigh(terms, vocabulary, doc_id, capped=True).join(F.broadcast(q), "term", "left")
    return scored.groupBy(doc_id).agg(
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.sum(F.col("weight") * F.col("qw")).alias("dot"),
    )


#: Two hashes of a term, one of 64 bits and another one of 32, stand for it where it shuffles: of a billion
#: terms, two share both with a chance of about 1 in 10 ** 11.
TERM_KEY = ["_a", "_b"]


def _keyed(docs: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """(term key, tf) rows of the term lists, no text; a document without terms has none, or with ``outer`` one without ``tf``."""
    hashes = [F.xxhash64("term").alias("_a"), F.hash("term").alias("_b")]
    return docs.select(*keep, F.inline_outer("terms") if outer else F.inline("terms")).select(*keep, F.col("tf").cast("double").alias("tf"), *hashes)


#: So many of the most frequent terms, about, are counted and weighed where they are; the sketch that finds them
#: tracks this many, so no other term has more than about a ten-thousandth of the rows.
HOT_KEYS, TRACKED_KEYS = 10_000, 32_768
#: A task that counts the other terms takes the terms of so many bytes of files.
PART_BYTES = 8 * 1024 * 1024


def _sums_by_key(docs: DataFrame, query: DataFrame, doc_id: str) -> DataFrame:
    """(doc, norm, dot) over all terms of the written table ``docs``.

    The most frequent terms and those of the query go to every task with their counts; they are weighed where
    they are and summed per document before anything shuffles.  Every other row shuffles once, to its
    term, is counted there, and leaves again only if several documents have the term: one of a single
    document weighs ``once``, which is summed in the first place.  Which terms are taken for frequent changes no
    result.  A term has one row per document at most, and the rows that shuffle hold numbers alone.
    """
    n = docs.agg(F.count(F.lit(1))).scalar()
    asked = _keyed(query).withColumnRenamed("tf", "_q")
    frequent = _keyed(docs).agg(F.expr(f"approx_top_k(_a, {HOT_KEYS}, {TRACKED_KEYS})").alias("_top"))
    keys = frequent.select(F.explode("_top.item").alias("_a")).union(asked.select("_a")).distinct()
    counted = _keyed(docs).join(F.broadcast(staged(keys, "frequent")), "_a", "left_semi").groupBy(*TERM_KEY).agg(F.count(F.lit(1)).alias("df"))
    # One query has no more terms than its own text.
    sent = staged(counted.join(F.broadcast(asked), TERM_KEY, "left"), "sent")

    def squared(df: Column) -> Column:
        return F.pow(F.log((n + 1) / (df + 1)) + 1, F.lit(2.0))

    once = squared(F.lit(1))
    weights = sent.select(*TERM_KEY, squared(F.col("df")).alias("_w"), (squared(F.col("df")) * F.col("_q")).alias("_q"))
    tf = F.col("tf")
    here = (
        _keyed(docs, doc_id, outer=True).join(F.broadcast(weights), TERM_KEY, "left")
        .select(doc_id, (tf * tf * F.coalesce("_w", once)).alias("_square"), (tf * F.col("_q")).alias("_dot"))
    )
    others = _keyed(docs, doc_id).join(F.broadcast(sent.select(*TERM_KEY)), TERM_KEY, "left_anti")
    df = F.count(F.lit(1)).over(Window.partitionBy(*TERM_KEY))
    if docs._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1 and len(docs._jdf.inputFiles()):
        others = dealt_by(others, docs, *TERM_KEY, part_bytes=PART_BYTES)  # only files tell their size
    shared = others.withColumn("df", df).where("df > 1")
    there = shared.select(doc_id, (tf * tf * (squared(F.col("df")) - once)).alias("_square"), F.lit(None).cast("double").alias("_dot"))
    sums = here.unionByName(there).groupBy(doc_id).agg(F.coalesce(F.sum("_square"), F.lit(0.0)).alias("_square"), F.sum("_dot").alias("_dot"))
    length = sent.agg(F.sqrt(F.sum(squared(F.col("df")) * F.col("_q") * F.col("_q")))).scalar()
    return sums.select(doc_id, F.sqrt("_square").alias("norm"), F.try_divide(F.col("_dot"), length).alias("dot"))


def cosine_pairs(
    docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, max_features: int | None = None
) -> DataFrame:
    """(query, doc, similarity) for a table of queries; pairs that share no term are left out.

    As large as its result is; ``best_pairs`` keeps the best of each query without it.
    """
    weights, qvec = _corpus_and_queries(docs, queries, doc_id, query_id, max_features)
    # The weights come dealt by document; queries that go to every task leave them there to be summed.
    return (
        weights.join(sent_if_small(qvec), "term")
        .groupBy(query_id, doc_id)
        .agg(F.sum(F.col("weight") * F.col("qw")).alias("similarity"))
    )


def _corpus_and_queries(docs, queries, doc_id, query_id, max_features, written=False) -> tuple[DataFrame, DataFrame]:
    """Unit weights of the documents for the terms that some query holds, and unit weights of the queries."""
    terms, vocabulary = fitted(docs, doc_id, max_features, written)
    asked = explode_terms(queries, query_id).where("term IS NOT NULL").select("term").distinct()
    wanted = staged(vocabulary.join(asked, "term", "left_semi"), "wanted")
    qvec = staged(query_weights(queries, wanted, query_id), "queries")
    return unit_weights(terms, vocabulary, wanted, doc_id, max_features is not None), qvec


def best_pairs(
    docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int, max_features: int | None = None,
    digits: int | None = None,
) -> DataFrame:
    """(query, doc, similarity, rank): the k most similar documents of each query, ties by document."""
    weights, qvec = _corpus_and_queries(docs, queries, doc_id, query_id, max_features)
    weights = weights.select(F.col(doc_id).alias("doc"), F.col("term").alias("feature"), "weight")
    index = build_index(weights, docs.count())
    asks = qvec.select(F.col(query_id).alias("query"), F.col("term").alias("feature"), F.col("qw").alias("weight"))
    found = best_documents(index, asks, k, digits=digits)
    return found.select(F.col("query").alias(query_id), F.col("doc").alias(doc_id), F.col("score").alias("similarity"), "rank")
