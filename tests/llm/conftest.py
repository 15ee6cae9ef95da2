import pytest

from roleweave.llm.storage import share_package

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) rows, over several partitions."""
    share_package(spark)

    def make(rows, extra=False):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS).repartition(3)
        if extra:  # columns that operators use names like
            for name in ("row", "key", "n", "node", "label", "text_id", "group", "order", "site", "line", "score", "block", "window"):
                df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def prose():
    """Distinct pseudo-random prose of a given number of words."""
    import random

    def make(seed, words):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(words))

    return make
