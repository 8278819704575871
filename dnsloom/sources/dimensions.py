"""Tables that the analytics look things up in: domains by hash, answers by event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def domain_map(rules_or_names: DataFrame, column: str = "domain") -> DataFrame:
    """domain_hash (XXH64, seed 42) and domain of every distinct name."""
    return rules_or_names.select(F.col(column).alias("domain")).distinct().select(F.xxhash64("domain").alias("domain_hash"), "domain")


def merge_domain_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Later loads overwrite per hash; hashes that are not loaded again stay."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)))
    last = Window.partitionBy("domain_hash").orderBy(F.desc("_load"), F.desc("domain"))
    return both.withColumn("_n", F.row_number().over(last)).filter("_n = 1").select("domain_hash", "domain")


def write_domain_map(rules: DataFrame, path: str | None) -> None:
    """The exact rules' hashes and domains, sorted by hash in each file; nothing without a path."""
    if path:
        domain_map(rules.filter("kind = 'exact'"), "value").sortWithinPartitions("domain_hash").write.mode("overwrite").parquet(path)


def load_domain_map(spark, *paths: str) -> DataFrame:
    """Maps read in turn, later ones over earlier ones."""
    maps = [spark.read.parquet(p).select("domain_hash", "domain") for p in paths]
    out = maps[0]
    for m in maps[1:]:
        out = merge_domain_map(out, m)
    return out
