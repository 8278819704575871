"""Telemetry frames in a binary column, decoded by expressions.

A frame: length (2 bytes, of what follows), type (1 byte), payload; numbers
are little-endian. Type 0 maps a hash to a domain, type 1 is an event. Short
or unknown frames go to a third table. Unknown reason bits are masked out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.config import ACTIONS
from dnsloom.functions.network import format_ip
from dnsloom.sources.tables import stored

REASON_MASK = 0x7FFF


def _bytes(h: Column, at: int, n: int) -> Column:
    """Hexadecimal text of n bytes from byte ``at``."""
    return F.substr(h, F.lit(2 * at + 1), F.lit(2 * n))


def _number(h: Column, at: int, n: int) -> Column:
    """The little-endian number of n bytes from byte ``at``, as a signed 64-bit long."""
    digits = F.concat(*[_bytes(h, at + i, 1) for i in reversed(range(n))])
    if n < 8:
        return F.conv(digits, 16, 10).cast("long")
    high, low = F.conv(F.substr(digits, F.lit(1), F.lit(8)), 16, 10).cast("long"), F.conv(F.substr(digits, F.lit(9), F.lit(8)), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


#: Frames handed on at once.
HELD = 50_000


def _cut(content: bytes):
    """(offset, bytes, fault) of each frame of an archive in turn; fault is None, or why the rest from there is no frame."""
    at, end = 0, len(content)
    while at < end:
        size = int.from_bytes(content[at : at + 2], "little")
        stop = at + 2 + size
        if at + 2 > end or stop > end:
            yield at, content[at:], "torn"
            return
        known = size > 0 and content[at + 2] in (0, 1)
        if not known and stop < end and not (stop + 3 <= end and content[stop + 2] in (0, 1) and int.from_bytes(content[stop : stop + 2], "little") > 0):
            yield at, content[at:], "misaligned"
            return
        yield at, content[at:stop], None
        at = stop


def _split(batches):
    def rows(held):
        cols = list(zip(*held, strict=True)) or [(), (), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["archive", "frame_no", "at", "frame", "fault"])

    for batch in batches:
        for name, content in zip(batch.column("archive").to_pylist(), batch.column("content"), strict=True):
            held = []
            for k, (at, frame, fault) in enumerate(_cut(content.as_py() or b"")):
                held.append((name, k, at, frame, fault))
                if len(held) >= HELD:
                    yield rows(held)
                    held = []
            yield rows(held)


def split_archives(archives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Byte strings of many frames each (archive: a name, content) -> (archive, frame_no, at, frame; archive, frame_no, at, frame: the rest, fault).

    Each frame begins with its length. Where fewer bytes are left than it says, the rest is set aside as ``torn``. A frame of an
    unknown type is passed on (``decode_frames`` sets it aside alone) if another frame or the end follows it; else the lengths
    cannot be trusted any more, and the rest is set aside as ``misaligned``. Archives are split side by side, each in one pass,
    and what comes of it is stored: both tables read from there. One archive has to fit into a task's memory. Null and empty ones have no frames.
    """
    one = archives.select(F.col("archive").cast("string").alias("archive"), "content")
    found = stored(one.mapInArrow(_split, "archive string, frame_no long, at long, frame binary, fault string"), "split")
    return found.filter("fault is null").drop("fault"), found.filter("fault is not null")


def read_archives(spark, path: str) -> DataFrame:
    """Files of concatenated frames, a row each, for ``split_archives``."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), "content")


def decode_frames(frames: DataFrame, column: str = "frame") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mappings: domain_hash, domain; events: ts, domain_hash, client_ip, action, flags; frames that are neither)."""
    h = F.hex(column)
    d = frames.withColumn("_h", h).withColumn("_size", F.octet_length(column)).withColumn("_said", _number(h, 0, 2)).withColumn("_type", _bytes(h, 2, 1))
    whole = F.coalesce((F.col("_size") >= 3) & (F.col("_size") >= 2 + F.col("_said")) & (F.col("_said") >= 1), F.lit(False))
    payload = F.col("_said") - 1
    p = F.substr(F.col("_h"), F.lit(7), (2 * payload).cast("int"))
    d = d.withColumn("_p", p).withColumn("_n", F.when(whole, payload).otherwise(-1))
    named = _number(F.col("_p"), 8, 2)
    code = F.conv(_bytes(F.col("_p"), 32, 1), 16, 10).cast("int")
    mapping = F.coalesce((F.col("_type") == "00") & (F.col("_n") >= 10) & (F.col("_n") >= 10 + named), F.lit(False))
    event = F.coalesce((F.col("_type") == "01") & (F.col("_n") >= 33) & code.between(0, 4) & ((code < 2) | (F.col("_n") >= 35)), F.lit(False))
    x = F.col("_p")
    mappings = d.filter(mapping).select(_number(x, 0, 8).alias("domain_hash"), F.decode(F.unhex(F.substr(x, F.lit(21), (2 * named).cast("int"))), "UTF-8").alias("domain"))
    reason = _number(x, 33, 2).bitwiseAND(F.lit(REASON_MASK).cast("long")).cast("int")
    events = d.filter(event).select(
        F.timestamp_seconds(_number(x, 0, 8)).alias("ts"),
        _number(x, 8, 8).alias("domain_hash"),
        format_ip(F.unhex(_bytes(x, 16, 16))).alias("client_ip"),
        F.element_at(F.array(*[F.lit(a) for a in ACTIONS]), code + 1).alias("action"),
        F.when(code >= 2, reason).alias("flags"),
    )
    return mappings, events, d.filter(~mapping & ~event).select(*frames.columns)
