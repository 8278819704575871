"""Running a stream over what is there, and sinks that write a batch once however often it is run."""

from __future__ import annotations

import itertools
import uuid

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dnsloom.sources.tables import work_dir

#: Where state is kept on disk, and where state with more than one value per key has to be.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def each(spark, df: DataFrame, work: Callable[[DataFrame, int], DataFrame], folder: str, mode: str = "update", store: bool = False) -> None:
    """Runs ``df`` until its input is read, ``work`` over every batch; results go below ``folder``/out, a folder per batch. A batch
    is kept while ``work`` uses it, and let go after: in the executors, or with ``store`` as Parquet below ``folder``, for batches
    that are large or come from much state, which is then read once whatever ``work`` does."""

    def write(batch: DataFrame, n: int) -> None:
        if store:
            kept = f"{folder}/kept-{n}"
            batch.write.mode("overwrite").parquet(kept)
            work(spark.read.schema(batch.schema).parquet(kept), n).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
            system, there = _there(spark, kept)
            system.delete(there, True)
            return
        batch.persist()
        try:
            work(batch, n).write.mode("overwrite").parquet(f"{folder}/out/batch={n}")
        finally:
            batch.unpersist()

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()


def read_or_empty(spark, schema: StructType | str, path: str) -> DataFrame:
    """The rows below ``path``; none where nothing was written."""
    system, there = _there(spark, path)
    if not system.exists(there):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def _there(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def drain(spark, df: DataFrame, mode: str) -> DataFrame:
    """Runs ``df`` until its input is read. Append: all rows written; complete: the last result; update: every row with its
    batch as ``batch_id``. As Parquet in the shared folder; no rows without a batch."""
    folder = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{folder}/out").start().awaitTermination()
        return spark.read.schema(schema).parquet(f"{folder}/out")
    if mode == "update":
        each(spark, df, lambda batch, n: batch.withColumn("batch_id", F.lit(n).cast("long")), folder)
        return read_or_empty(spark, schema.add("batch_id", "long"), f"{folder}/out")
    last = [-1]

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{n}")
        last[0] = n

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out/{last[0]}") if last[0] >= 0 else spark.createDataFrame([], schema)


@contextmanager
def rocksdb_state(spark):
    """Streams made and started within keep their state in RocksDB; after, streams keep it as before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, ROCKSDB)
        yield
    finally:
        spark.conf.set(name, before)


def deliver_lines(lines: DataFrame, folder: str, checkpoint: str) -> None:
    """Runs a stream with a ``line`` column into text files below ``folder``, appended batch by batch.

    A batch's files go to a folder of its own that is written over when the batch is run again: a replay leaves no line twice.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.select("line").write.mode("overwrite").text(f"{folder}/batch={n}")

    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_delivered(spark, folder: str) -> DataFrame:
    """All lines delivered."""
    return spark.read.option("recursiveFileLookup", "true").text(folder).withColumnRenamed("value", "line")


def deliver_with(lines: DataFrame, post: Callable[[str, Iterator[str]], None], folder: str, checkpoint: str) -> None:
    """Runs a stream with a ``line`` column into ``post(key, lines)``, called on executors once for each part of a batch.

    A part that is done is noted below ``folder``; when its batch is run again it is not posted again. A part that fails
    halfway is posted anew under the same key, so a receiver that keeps keys sees every line once. For the parts to be the
    same each time, a batch is written down first and posted from there.
    """
    spark = lines.sparkSession

    def write(batch: DataFrame, n: int) -> None:
        kept, done = f"{folder}/kept/batch={n}", f"{folder}/done/batch={n}"
        system, path = _there(spark, f"{kept}/_SUCCESS")
        if not system.exists(path):
            batch.select("line").withColumn("part", F.spark_partition_id()).write.mode("overwrite").partitionBy("part").parquet(kept)
        if not system.globStatus(_there(spark, f"{kept}/part=*")[1]):
            return  # nothing in this batch
        rows = spark.read.schema("line string, part int").parquet(kept)
        before = [r[0] for r in read_or_empty(spark, StructType().add("part", "integer"), done).distinct().collect()]  # parts of one batch
        left = rows.filter(~F.col("part").isin(before)) if before else rows

        # A part's rows together and in one task, handed on as they come.
        dealt = left.repartition("part").sortWithinPartitions("part")
        dealt.mapInPandas(_posted(n, post), "part int").write.mode("append").parquet(done)

    lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _posted(n: int, post: Callable[[str, Iterator[str]], None]):
    def run(frames):
        rows = ((p, x) for f in frames for p, x in zip(f["part"], f["line"], strict=True))
        for part, own in itertools.groupby(rows, key=lambda r: r[0]):
            post(f"{n}/{part}", (x for _, x in own))
            yield pd.DataFrame({"part": [part]})

    return run
