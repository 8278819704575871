"""Lookup tables in versions: written beside each other, made current by one small row, read by streams a version per batch.

A folder holds ``data/v=N`` for each version and ``log``, a table with a row per
committed version. A version without its row is not there for anyone, so a writer
that dies halfway changes nothing. Readers take the newest committed version, or
the one that their batch took before, so a batch that is run again sees the same
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "version long, batch string"


def _exists(spark, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def _log(spark, root: str, name: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(f"{root}/{name}") if _exists(spark, f"{root}/{name}") else spark.createDataFrame([], LOG)


def _note(spark, root: str, name: str, version: int, batch: str | None = None) -> None:
    spark.createDataFrame([(version, batch)], LOG).coalesce(1).write.mode("append").parquet(f"{root}/{name}")


def newest(spark, root: str) -> int | None:
    """The newest committed version; None before the first."""
    return _log(spark, root, "log").agg(F.max("version")).first()[0]


def read(spark, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/data/v={version}")


def publish(table: DataFrame, root: str, *, merge_with=None) -> int:
    """Writes ``table`` as the next version and commits it; ``merge_with(old, new)`` makes it from the current one. One writer at a time."""
    spark = table.sparkSession
    now = newest(spark, root)
    if merge_with is not None and now is not None:
        table = merge_with(read(spark, root, now), table)
    version = 0 if now is None else now + 1
    table.write.mode("overwrite").parquet(f"{root}/data/v={version}")  # over what a writer left that died
    _note(spark, root, "log", version)
    return version


def pinned(spark, root: str, reader: str, batch: int) -> int | None:
    """The version that ``reader`` takes for ``batch``: the one noted when the batch ran first, else the newest, which is noted."""
    key = f"{reader}/{batch}"
    before = _log(spark, root, "taken").filter(F.col("batch") == key).agg(F.max("version")).first()[0]
    if before is not None:
        return before
    now = newest(spark, root)
    if now is not None:
        _note(spark, root, "taken", now, key)
    return now


def forget(spark, root: str, keep: int = 2) -> list[int]:
    """Deletes the data of all but the newest ``keep`` committed versions; returns them."""
    gone = []
    for (v,) in sorted(_log(spark, root, "log").select("version").distinct().collect())[: -keep or None]:  # a row per version
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/data/v={v}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True):
            gone.append(v)
    return gone
