import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from roleweave.session import local_session  # noqa: E402
from roleweave.vocabulary import Vocabulary  # noqa: E402

# Column functions need an active session even where a test module only builds a column.
local_session("tests", cpus=4)


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cpus=4)


@pytest.fixture(scope="session")
def vocab(spark):
    """The packaged seed lists."""
    return Vocabulary.load(spark)


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column over one row of given fields."""

    def value(column, **fields):
        from pyspark.sql import functions as F

        row = spark.range(1).select(*[_literal(v).alias(k) for k, v in fields.items()]) if fields else spark.range(1)
        return row.select(column.alias("v")).first()["v"]

    def _literal(v):
        from pyspark.sql import functions as F

        if v is None:
            return F.lit(None).cast("string")
        if isinstance(v, list):
            return F.array(*[F.lit(x) for x in v]).cast("array<string>")
        return F.lit(v)

    return value
