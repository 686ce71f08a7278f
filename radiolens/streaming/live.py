"""The same operators on streams: results after a drain equal the batch results."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from radiolens.operators.score import score

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WIDEST = 10  # rows of the widest frame
TICK_MS = 1000

_COLUMNS = ["at", "event_id", "rscp", "ecn0", "rscp_det"]  # at: microseconds, free of time zones
_STATE = "rows binary"  # some rows, column by column: an entry for every row would be sent and coded alone
PIECE = 10_000  # rows of an entry
FEATURES = (
    "rscp_rmean_5 double, rscp_rmean_10 double, ecn0_rmean_5 double, ecn0_rmean_10 double, "
    "ecn0_rstd_5 double, rscp_diff double, ecn0_diff double, interference int, handover_needed int"
)


def _entries(frame: pd.DataFrame) -> list[tuple]:
    """Entries of a list state that hold the rows of ``frame``."""
    parts = (frame.iloc[at : at + PIECE] for at in range(0, len(frame), PIECE))
    return [(pickle.dumps([part[c].to_numpy() for c in _COLUMNS]),) for part in parts]


def _rows(state) -> pd.DataFrame:
    """The rows that a list state holds."""
    parts = [pickle.loads(entry[0]) for entry in state.get()] if state.exists() else []
    return pd.DataFrame({c: np.concatenate([part[i] for part in parts]) if parts else [] for i, c in enumerate(_COLUMNS)})


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Stateful processors need the RocksDB store; the session gets its own setting back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class CellFeatures(StatefulProcessor):
    """Buffers a cell's rows until the watermark passes them, then emits them in time order.

    State per cell: the rows still open (bounded by the watermark delay) and the last rows emitted
    (the reach of the widest frame).  Rows behind the watermark are dropped and counted by Spark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open_rows = handle.getListState("open", _STATE)
        self.past_rows = handle.getListState("past", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            self.open_rows.appendList(_entries(batch[_COLUMNS]))
            earliest = int(batch["at"].min())
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake_after(first)
        yield from ()

    def _wake_after(self, at: int) -> None:
        """One timer for the earliest open row; the next one is set when it has fired."""
        self.handle.registerTimer((at // 1000 // TICK_MS + 1) * TICK_MS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _rows(self.open_rows)
        if held.empty:
            return
        limit = timerValues.getCurrentWatermarkInMs() * 1000
        ready = held[held["at"] < limit].sort_values(["at", "event_id"])
        rest = held[held["at"] >= limit]
        if len(rest):
            self._wake_after(int(rest["at"].min()))
        if ready.empty:
            return
        past = _rows(self.past_rows)
        line = pd.concat([past, ready], ignore_index=True) if len(past) else ready.reset_index(drop=True)
        made = self._features(line.astype({"rscp": "float64", "ecn0": "float64", "rscp_det": "float64"}))
        made.insert(0, "psc", key[0])
        self._store(self.open_rows, rest)
        self._store(self.past_rows, line.tail(WIDEST - 1))
        yield made.iloc[len(past):]

    @staticmethod
    def _store(state, frame: pd.DataFrame) -> None:
        state.clear()
        if len(frame):
            state.put(_entries(frame))

    @staticmethod
    def _features(line: pd.DataFrame) -> pd.DataFrame:
        out = line[["at", "event_id"]].copy()
        for c in ("rscp", "ecn0"):
            for n in (5, 10):
                out[f"{c}_rmean_{n}"] = line[c].rolling(n, min_periods=1).mean()
        out["ecn0_rstd_5"] = line["ecn0"].rolling(5, min_periods=1).std().fillna(0.0)
        for c in ("rscp", "ecn0"):
            out[f"{c}_diff"] = line[c].diff().fillna(0.0)
        bad = line["ecn0"] < -10
        close = ((line["rscp"] - line["rscp_det"]) < 5) & line["rscp_det"].notna() & bad
        out["interference"] = (bad.astype(int).rolling(5, min_periods=1).sum() >= 3).astype("int32")
        out["handover_needed"] = (close.astype(int).rolling(4, min_periods=1).sum() >= 2).astype("int32")
        return out

    def close(self) -> None:
        pass


def stream_features(sdf: DataFrame, key: str = "psc", watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Rolling features and persistence labels per cell, emitted in time order behind the watermark.

    Rows without a cell need no state: as in batch they get no means, no steps and no labels. Start the
    query inside ``rocksdb(spark)``.
    """
    every = sdf.select(
        F.col(key).alias("psc"), F.col(time).alias("ts"), F.unix_micros(F.col(time)).alias("at"), "event_id",
        *[F.col(c).cast("double").alias(c) for c in ("rscp", "ecn0", "rscp_det")])
    rows = every.where(F.col("psc").isNotNull())
    key_type = dict(rows.dtypes)["psc"]
    names = [c.split() for c in FEATURES.split(", ")]
    loose = every.where(F.col("psc").isNull()).select(
        "psc", "event_id", *[F.lit(None if "mean" in c else 0).cast(kind).alias(c) for c, kind in names], "ts")
    placed = (
        rows.withWatermark("ts", watermark)
        .groupBy("psc")
        .transformWithStateInPandas(
            statefulProcessor=CellFeatures(),
            outputStructType=f"psc {key_type}, at bigint, event_id bigint, {FEATURES}",
            outputMode="Append",
            timeMode="EventTime",
        )
        .withColumn("ts", F.timestamp_micros("at"))
        .drop("at")
    )
    return placed.unionByName(loose)


def stream_cell_stats(
    sdf: DataFrame, window: str = "15 minutes", watermark: str = "1 hour", key: str = "psc", time: str = "ts"
) -> DataFrame:
    """Tumbling statistics per cell; partial sums combine before the shuffle, late rows are dropped."""
    return (
        sdf.withWatermark(time, watermark)
        .groupBy(F.window(time, window), key)
        .agg(
            F.count("rscp").alias("n_samples"), F.avg("rscp").alias("rscp_mean"), F.stddev_samp("rscp").alias("rscp_std"),
            F.avg("ecn0").alias("ecn0_mean"), F.stddev_samp("ecn0").alias("ecn0_std"),
        )
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key,
                "n_samples", "rscp_mean", "rscp_std", "ecn0_mean", "ecn0_std")
    )


def stream_score(model: PipelineModel, sdf: DataFrame, labels: Sequence[str]) -> DataFrame:
    return score(model, sdf, labels)


def stream_dedup(sdf: DataFrame, keys: Sequence[str], watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Repeated logger rows; a copy is recognised while the watermark has not passed the first one."""
    return sdf.withWatermark(time, watermark).dropDuplicatesWithinWatermark(list(keys))


def drain(sdf: DataFrame, path: str) -> DataFrame:
    """Process what is there, append it to a table at ``path`` and return the stored rows.

    The progress log and the state lie under ``path``, out of sight of readers. A query that is drained
    into the same path again, after new files or after a failure, goes on where it stopped; a batch that was
    stored but not confirmed is not stored twice, because the table lists its files by batch. The state of
    windows and cells that are still open is kept between drains.
    """
    query = (
        sdf.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{path}/_progress")
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return sdf.sparkSession.read.schema(sdf.schema).parquet(path)
