import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text[, source]) rows, with columns whose names clash with inner ones"""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        return frame.selectExpr("*", "1 as fp", "2 as h", "3 as size", "4 as pos", "5 as a", "6 as b", "7 as node", "8 as target", "9 as score", "10 as start")

    return make


def pytest_configure(config):
    os.environ.setdefault("TZ", "UTC")
