"""Drains that stop and go on store the same rows as one that was never interrupted."""

import pathlib

import pytest
from pyspark.sql import functions as F

from radiolens.streaming import live

SCHEMA = "event_id bigint, psc int, ts timestamp, rscp double, ecn0 double, rscp_det double"


def rows_of(spark, part):
    """Four parts of an hour each, the last one far ahead so that the watermark passes the others; repeated rows."""
    hour = part if part < 3 else 30
    rows = spark.range(240).selectExpr(
        f"{part} * 1000 + id div 2 as event_id", "int(id div 2 % 5) as psc",
        f"timestamp_seconds(1700000000 + {hour} * 3600 + (id div 2) * 29) as ts",
        "-80.0D - (id div 2 * 7) % 40 as rscp", "-6.0D - (id div 2 * 3) % 12 as ecn0", "-82.0D - (id div 2) % 30 as rscp_det")
    return rows.coalesce(1)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(path))


MADE = {
    "stats": lambda sdf: live.stream_cell_stats(sdf),
    "features": lambda sdf: live.stream_features(sdf),
    "unique": lambda sdf: live.stream_dedup(sdf, ["event_id"]),
}


@pytest.mark.parametrize("kind", MADE)
def test_stopped_and_replayed(spark, tmp_path, kind):
    def stored(table):
        return sorted(map(tuple, table.select([F.col(c).cast("string") for c in table.columns]).collect()), key=str)

    whole, halves = tmp_path / "whole", tmp_path / "halves"
    with live.rocksdb(spark):
        for part in range(4):
            rows_of(spark, part).write.mode("append").parquet(str(whole))
        expected = stored(live.drain(MADE[kind](source(spark, whole)), str(tmp_path / "once")))
        target = tmp_path / "again"
        counts = []
        for part in range(4):
            rows_of(spark, part).write.mode("append").parquet(str(halves))
            counts.append(live.drain(MADE[kind](source(spark, halves)), str(target)).count())
            if part == 1:  # the last batch was stored, its confirmation was lost
                commits = target / "_progress" / "commits"
                last = max((p for p in commits.iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
                last.unlink()
                pathlib.Path(commits / f".{last.name}.crc").unlink(missing_ok=True)
        got = stored(live.drain(MADE[kind](source(spark, halves)), str(target)))
    assert got == expected and len(got) > 0
    assert counts == sorted(counts) and counts[-1] == len(got)


def test_state_holds_pieces_not_rows():
    """Many rows are few entries of the state, and come back as they were."""
    import numpy as np
    import pandas as pd

    n = 2 * live.PIECE + 5
    frame = pd.DataFrame({"at": np.arange(n), "event_id": np.arange(n), "rscp": np.where(np.arange(n) % 3, -70.0, np.nan),
                          "ecn0": -9.0, "rscp_det": np.nan})

    class State:
        def exists(self):
            return True

        def get(self):
            return iter(live._entries(frame))

    assert len(live._entries(frame)) == 3
    pd.testing.assert_frame_equal(live._rows(State()), frame)
