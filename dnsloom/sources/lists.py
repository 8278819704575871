"""Filter lists as tables of lines, and lists written back as text."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LINES = "source string, role string, load_order int, line_no bigint, line string"


def read_lists(spark, paths: Sequence[str], role: str = "black", first_order: int = 0) -> DataFrame:
    """A row per line of each file, in order within the file. Bytes that are no UTF-8 become replacement characters.

    A list's place in the load order goes by its whole path, so lists of one file name stay apart.
    """
    if not paths:
        return spark.createDataFrame([], LINES)
    raw = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    # Within a block of a file first, then blocks by their line counts: no task numbers a whole list.
    inside = raw.withColumn("_in", F.row_number().over(Window.partitionBy("source", "_block").orderBy("_at")))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = raw.groupBy("source", "_block").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    numbered = inside.join(blocks, ["source", "_block"]).withColumn("line_no", (F.col("_before") + F.col("_in")).cast("long"))
    return numbered.select("source", F.lit(role).alias("role"), _order(spark, paths, first_order).alias("load_order"), "line_no", F.col("value").alias("line"))


def _order(spark, paths: Sequence[str], first: int) -> Column:
    """The place of a source among the given paths, by its whole path; files of a folder share the folder's place."""
    at, folders = {}, F.lit(None).cast("int")
    for i, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        name = re.sub("^([a-z]+):/+", r"\1:/", system.makeQualified(path).toUri().toString())
        at[name] = first + i
        if system.exists(path) and system.getFileStatus(path).isDirectory():
            folders = F.when(_plain().startswith(name + "/"), first + i).otherwise(folders)
    known = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    return F.coalesce(F.element_at(known, _plain()), folders, F.lit(first)).cast("int")


def _plain() -> Column:
    return F.regexp_replace("source", "^([a-z]+):/+", "$1:/")


def read_nrd(spark, path: str | None) -> DataFrame:
    """Newly registered domains; nothing without a path."""
    return read_lists(spark, [path] if path else [], role="nrd")


def write_lines(lines: DataFrame, path: str, *, single_file: bool = False) -> None:
    """One rule per line, in the order of ``lines``; nothing is written for an empty table or without a path."""
    if not path or lines.isEmpty():
        return
    (lines.coalesce(1) if single_file else lines).select(lines.columns[0]).write.mode("overwrite").text(path)


def write_browser_rules(parsed: DataFrame, path: str) -> None:
    """Collected browser rules in load order."""
    write_lines(parsed.filter("kind = 'browser'").orderBy("load_order", "line_no").select("value"), path)
