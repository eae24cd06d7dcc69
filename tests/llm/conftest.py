"""Small tables with the awkward cases: nulls, empty and very long texts, repeated rows, clashing columns."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from playbill.llm.tables import small_batches  # noqa: E402
from samples import CLASHING, SCHEMA, awkward  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents from (doc_id, text) rows, with columns whose names clash on request."""

    def make(rows, clash=False):
        small_batches(spark)
        docs = spark.createDataFrame([(d, t, None, "s", len(t or "")) for d, t in rows], SCHEMA)
        if clash:
            for name in CLASHING:
                docs = docs.selectExpr("*", f"'{name}' AS {name}")
        return docs.repartition(3)

    return make
