import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def table(spark):
    """Rows of (doc_id, text, ...) as a DataFrame over several partitions."""

    def build(rows, schema="doc_id bigint, text string"):
        return spark.createDataFrame(rows, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest given table of documents, in doc_id order."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    return sorted(rows, key=lambda r: r.doc_id)
