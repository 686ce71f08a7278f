"""Reliable materialisation: survives lost executors because it lives in shared storage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a scratch one in local runs."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is not None:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="radiolens-"))
    return spark.sparkContext.getCheckpointDir()


_paths: dict[int, list[str]] = {}  # by session
_passing: dict[int, list[str]] = {}  # by thread


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for an intermediate table; ``release`` deletes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _paths.setdefault(id(spark), []).append(path)
    if (passing := _passing.get(threading.get_ident())) is not None:
        passing.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session; call it when the results that read them are written."""
    for path in _paths.pop(id(spark), []):
        discard(spark, path)


def discard(spark: SparkSession, path: str | None) -> None:
    """Delete a folder that no later step reads."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from the written rows.

    Unlike a row checkpoint the table is compressed and columnar, so a later step reads only the
    columns it needs, and its statistics are the real sizes.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` returns, written once; tables written on the way are deleted, nothing else may read them."""
    me, passing = threading.get_ident(), []
    outer, _passing[me] = _passing.get(me), passing
    try:
        df = make()
    finally:
        if outer is None:
            del _passing[me]
        else:
            _passing[me] = outer
    out = materialize(df)
    for path in passing:
        discard(df.sparkSession, path)
        _paths[id(df.sparkSession)].remove(path)
    return out
