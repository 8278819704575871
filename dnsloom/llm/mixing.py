"""Mixing sources to target weights by systematic sampling.

Each source gets a target share of the mix. Inside a source the documents stand
in a fixed order (size, then a hash of the id, then the id); every document
adds its expected number of copies to a running sum that starts at one random
offset, and is emitted once for each integer the sum passes. As the order goes
by size, what a source contributes stays within about one document of its
target. Targets are filled like water: a source stops at ``most`` times its own
size, and what is above goes to the others by weight.

The running sum never puts a source into one task: counts go up by (source,
size), then by hash bucket within that, and only the rows of one bucket are
numbered together.

Null source: a source of its own, last. Null or empty text: size 0, never
emitted by a source whose documents are all empty (target 0). Repeated rows
are documents of their own; of equal sizes the order is by hash of the id, then
by id. A very long text is one document of that size. An empty table gives an
empty result. Columns of any name come along as they are; a measure whose name
is taken is called ``mix_size`` and so on. Helper columns are prefixed ``_mx_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import scratch, settle

WORD = r"[^\x20\x09-\x0D]+"
#: Rows of one bucket, about; the number of buckets follows the input.
BUCKET_ROWS = 50_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source: str, size: str, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """A row per source: _mx_source, source_size, target, _mx_offset (0 to 1, from a hash of the source's name).

    Sorted by how soon a source is full (its cap over its weight), the full ones
    are a prefix, so the water level needs running sums only. The table has a
    row per source.
    """
    by_name = Window.orderBy(F.col("_mx_source").asc_nulls_last())
    level = Window.orderBy("_mx_ratio", F.col("_mx_source").asc_nulls_last())
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    rest = level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    totals = Window.partitionBy()
    w = F.array(*[F.lit(float(x)) for x in weights])
    t = (
        sized.groupBy(F.col(source).alias("_mx_source"))
        .agg(F.sum(size).alias("source_size"))
        .withColumn("_mx_w", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
        .withColumn("_mx_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_mx_ratio", F.col("_mx_cap") / F.col("_mx_w"))
        .withColumn("_mx_all", F.sum("source_size").over(totals) * F.lit(float(share)))
        .withColumn("_mx_level", (F.col("_mx_all") - F.coalesce(F.sum("_mx_cap").over(upto), F.lit(0.0))) / F.sum("_mx_w").over(rest))
        .withColumn("_mx_open", F.col("_mx_level") < F.col("_mx_ratio"))
        .withColumn("_mx_water", F.min(F.when(F.col("_mx_open"), F.struct("_mx_ratio", "_mx_source", "_mx_level"))).over(totals)["_mx_level"])
    )
    full = F.coalesce(F.col("_mx_ratio") <= F.col("_mx_water"), F.lit(True))
    return t.select(
        "_mx_source",
        "source_size",
        F.when(full, F.col("_mx_cap")).otherwise(F.col("_mx_water") * F.col("_mx_w")).alias("target"),
        (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("_mx_source"), F.lit("")), F.lit("#offset"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)).alias("_mx_offset"),
    )


MEASURES = ("size", "source_size", "target", "copies")


def measures(columns: Sequence[str]) -> dict[str, str]:
    """Names under which ``mix`` adds its measures to a table of these columns: a taken name gets ``mix_`` before it."""
    named: dict[str, str] = {}
    for name in MEASURES:
        free = name
        while free in columns or free in named.values():
            free = f"mix_{free}"
        named[name] = free
    return named


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size_col: str | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document), named by ``measures``.

    ``size_col``: a column that holds the sizes already; else the words of ``text_col`` are counted.
    """
    name = measures(docs.columns)
    # One key without nulls for grouping, numbering and joining, so rows with texts move once.
    key = ["_mx_source", "_mx_size", "_mx_b"]
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else count_words(F.col(text_col))
    keyed = docs.withColumns({"_mx_source": F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")), "_mx_size": size, "_mx_h": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))})
    digits = 1
    while 16**digits < max(1, docs.count() // bucket_rows) and digits < 6:
        digits += 1
    dealt = keyed.withColumn("_mx_b", F.substring("_mx_h", 1, digits))

    cells = settle(dealt.groupBy(*key).agg(F.count(F.lit(1)).alias("_mx_n")), "cells")
    plain = F.when(F.col("_mx_source") != "", F.expr("substring(_mx_source, 2)"))
    targets = source_targets(cells.select(plain.alias("s"), (F.col("_mx_size") * F.col("_mx_n")).alias("n")), "s", "n", weights, share, most)
    by_size = cells.groupBy("_mx_source", "_mx_size").agg(F.sum("_mx_n").alias("_mx_m"))
    before_size = by_size.withColumn("_mx_lower", F.coalesce(F.sum("_mx_m").over(Window.partitionBy("_mx_source").orderBy("_mx_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_mx_source", "_mx_size").orderBy("_mx_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_mx_in", F.coalesce(F.sum("_mx_n").over(inside), F.lit(0))).join(before_size, ["_mx_source", "_mx_size"])
    starts = starts.withColumn("_mx_name", plain).alias("c").join(targets.alias("t"), F.col("_mx_name").eqNullSafe(F.col("t._mx_source")))
    starts = settle(starts.select(*[F.col(f"c.{c}") for c in key], (F.col("_mx_lower") + F.col("_mx_in")).alias("_mx_start"), F.col("source_size").alias("_mx_all"), F.col("target").alias("_mx_target"), "_mx_offset"), "starts")

    rate = F.when(F.col("_mx_all") > 0, F.col("_mx_target") / F.col("_mx_all")).otherwise(F.lit(0.0))
    at = F.col("_mx_start") + F.row_number().over(Window.partitionBy(*key).orderBy("_mx_h", F.col(id_col).asc_nulls_first()))
    out = dealt.join(starts, key).withColumn("_mx_copies", (F.floor(rate * at + F.col("_mx_offset")) - F.floor(rate * (at - 1) + F.col("_mx_offset"))).cast("long"))
    added = zip(MEASURES, ("_mx_size", "_mx_all", "_mx_target", "_mx_copies"), strict=True)
    return out.select(*docs.columns, *[F.col(c).alias(name[m]) for m, c in added])


def emit(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The mix itself, in the ``columns`` of the table that was mixed: each document as often as it is taken."""
    copies = measures(columns)["copies"]
    return mixed.filter(F.col(copies) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias("_mx_copy")).drop("_mx_copy")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch(spark):
        sized = settle(docs.select("doc_id", "source", count_words(F.col("text")).alias("n_words")), "sized")
        mixed = mix(sized, size_col="n_words").select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
        return settle(mixed, "mixed", keep=True)


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS whole FROM w),
l AS (SELECT *, (whole - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) /
        sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
o AS (SELECT *, (SELECT arg_min(level, (ratio, coalesce(source, ''))) FROM l x WHERE x.level < x.ratio) AS water FROM l),
t AS (SELECT source, source_size, CASE WHEN coalesce(ratio <= water, true) THEN cap ELSE water * w END AS target,
        ('0x' || substr(md5(coalesce(source, '') || '#offset'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM o),
n AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate * k + u) - floor(rate * (k - 1) + u))::BIGINT * size)::BIGINT AS taken FROM n
"""
