"""Every registered query with SQL against DuckDB on the smallest tables; the others must run."""

import duckdb
import pytest

from radiolens.catalog import CHECKS, Tables
from radiolens.catalog.base import TABLES
from radiolens.plans.stage import release
from tests.conftest import SMALL
from tools.verify import normal

# fits of whole model families take minutes; tests/test_models.py covers them in smaller form
LONG = {"train_coverage", "train_umts_tasks", "train_handover_tasks", "stream_score"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n in CHECKS if n not in LONG])
def test_registered_query(spark, duck, name):
    check = CHECKS[name]
    frame = check.run(Tables(spark, SMALL))
    rows = [tuple(r.asDict(recursive=True)[c] for c in frame.columns) for r in frame.collect()]
    release(spark)
    if not check.sql:
        assert rows
        return
    result = duck.execute(check.sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    got, want = normal(rows, frame.columns), normal(result.fetchall(), names)
    assert list(map(repr, got)) == list(map(repr, want))


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
