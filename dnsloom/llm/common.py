"""Helpers that the training-data operators share.

Shared storage: whatever has to outlive an executor goes to the folder named by
``spark.checkpoint.dir``; it is read from the session and set here only where a
local session (tests) leaves it unset.
"""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

M64 = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir")


#: The folders of the ``scratch`` blocks around, innermost last, of this thread of control; other threads have their own.
_FOLDERS: ContextVar[tuple[str, ...]] = ContextVar("folders", default=())


@contextmanager
def scratch(spark: SparkSession):
    """Tables settled inside are deleted at the end; those settled with ``keep`` outlive it, until the end of a ``scratch`` around it."""
    folder = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    before = _FOLDERS.set((*_FOLDERS.get(), folder))
    try:
        yield
    finally:
        _FOLDERS.reset(before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps that nothing refers to any more, before a large step writes its own."""
    for _ in range(2):  # what the first round frees is found by the next; the deletion itself runs behind
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def settle(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and no executor's loss undoes it. Within ``scratch``
    the table goes with it; ``keep`` marks a result, which goes with the next ``scratch`` around."""
    spark = df.sparkSession
    folder = (shared_dir(spark), *_FOLDERS.get())
    folder = folder[-2 if keep and len(folder) > 1 else -1]
    path = f"{folder}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _lower(spark: SparkSession, name: str, most: int) -> None:
    now = int(spark.conf.get(name))
    spark.conf.set(name, min(now, most) if now > 0 else most)  # 0 and less: no limit


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Within, tasks hand at most so many rows at once to Python: less memory where rows are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    _lower(spark, name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Rows of texts handed to Python at once, and read from Parquet at once, where memory counts.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 256}


def few_rows(spark: SparkSession) -> None:
    """From here on this session reads, and hands to Python, few rows at once: for results that the caller runs, where no
    block around the operator's own steps can settle it. Smaller values stay."""
    for name, most in FEW_ROWS.items():
        _lower(spark, name, most)


@contextmanager
def few_rows_within(spark: SparkSession):
    """``few_rows``, with the session's own values back at the end."""
    before = {name: spark.conf.get(name) for name in FEW_ROWS}
    few_rows(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


#: Rows of one key that one part of a join takes at least, and hot keys at most.
HOT, HOT_KEYS = 10_000, 100_000


def hot_join(many: DataFrame, few: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Inner join of ``many`` rows with the ``few`` rows of each key. ``counts`` (else ``few``) has ``_n``, the rows that a
    key has among ``many``, once for each key. A hot key is dealt to several parts, and its few rows go to each; as a hot
    key has more than 1 / ``HOT_KEYS`` of all rows, the list of hot keys that is broadcast holds at most that many."""
    if counts is None:
        counts, few = few.select(*keys, "_n").distinct(), few.drop("_n")
    counts = counts.filter(f"_n > {HOT}")
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not most:
        return many.join(few, keys)
    each = max(HOT, total // HOT_KEYS)
    hot = F.broadcast(counts.filter(F.col("_n") > each).select(*keys, F.ceil(F.col("_n") / each).cast("int").alias("_parts")))
    part = F.coalesce(F.pmod(F.xxhash64(*many.columns), F.col("_parts")), F.lit(0)).cast("int")
    dealt = many.join(hot, keys, "left").withColumn("_part", part).drop("_parts")
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return dealt.join(few.join(hot, keys, "left").withColumn("_part", F.explode(parts)).drop("_parts"), [*keys, "_part"]).drop("_part")


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column in one array, and where each row begins (one entry more than rows). Null: empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, at - at[0] if len(at) else np.zeros(1, np.int64)


def portions(sizes: np.ndarray, most: int):
    """Consecutive row ranges whose sizes add up to about ``most``; a row is never divided."""
    first, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def spread(rows: int, per_part: int, least: int = 1) -> int:
    """A number of partitions or blocks that follows the number of rows."""
    return max(least, -(-int(rows) // per_part))


#: A-Z in lower case, all else as it is.
FOLD_AZ = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLANK = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else _BLANK[c] for c in range(256))
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(256)], np.uint64)


def word_hashes(raw: np.ndarray, at: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the white-space words of every row, where each row's words begin, and each word's first byte and the byte after it (n x 2)."""
    text = np.frombuffer(raw.tobytes().translate(_LOWER if lower else _BLANK), np.uint8)
    solid = text != 32
    edge = at[:-1][at[:-1] < len(text)]
    opens, closes = solid.copy(), solid.copy()
    opens[1:] &= ~solid[:-1]
    opens[edge] |= solid[edge]
    closes[:-1] &= ~solid[1:]
    inner = edge[edge > 0] - 1
    closes[inner] |= solid[inner]
    w = np.flatnonzero(opens)
    begin = np.searchsorted(w, at, "left")
    if not len(w):
        return np.zeros(0, np.uint64), begin, np.zeros((0, 2), np.int64)
    found, _ = run_hashes(text[w[0] :], solid[w[0] :], w - w[0])
    return found, begin, np.stack([w, np.flatnonzero(closes) + 1], axis=1)


def run_hashes(text: np.ndarray, solid: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and length of each run of bytes; runs begin at ``starts`` (the first at 0) and hold their ``solid`` bytes, which come first in them."""
    gaps = np.diff(np.append(starts, len(text)))
    place = np.arange(len(text)) - np.repeat(starts, gaps)
    coded = np.where(solid, text.astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWERS[place & 255]
    if gaps.max() > 256:  # powers repeat beyond 256 bytes; the round is mixed in, so long runs stay told apart
        far = (place > 255) & solid
        coded[far] = mix64(coded[far] + (place[far] >> 8).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    return mix64(np.add.reduceat(coded, starts)), np.add.reduceat(solid, starts, dtype=np.int64)
