"""Ordering, sampling and static partitioning, all from hashes of keys, so that they do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from presslens.storage import materialize


def hash_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys, the same in any engine with MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows a stratum; rank filters are pushed before the shuffle by Spark's window group limit."""
    w = Window.partitionBy(stratum).orderBy(hash_order(F.col(key), seed), key)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def shuffle_rows(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(F.col(key), seed), key)


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``is_eval``: about ``share`` of each label, decided by the key's hash alone (no shuffle)."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(label), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("is_eval", h < int(share * 2**32))


def row_index(df: DataFrame, key: str) -> DataFrame:
    """Adds ``rn``, the place in the order of the key from 1, without a global sort in one task: partitions are ranges, their sizes are summed."""
    # written, as ranges are drawn anew whenever the plan runs
    ranged = materialize(df.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_pid", F.spark_partition_id()), "ranged")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(key)))
    sizes = ranged.groupBy("_pid").agg(F.count("*").alias("_n"))
    # one row a partition
    before = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_before"))
    return local.join(before, "_pid").withColumn("rn", F.col("_before") + F.col("_local")).drop("_pid", "_local", "_before")


def assign_part(df: DataFrame, key: str, parts: int = 8) -> DataFrame:
    """Adds ``part`` (1 to ``parts``): equal runs of total // parts rows in key order, the last one takes the rest."""
    total = df.agg(F.count("*").alias("t"))
    size = F.floor(F.col("_t") / parts)
    part = F.when(size == 0, parts).otherwise(F.least(F.floor((F.col("rn") - 1) / F.greatest(size, F.lit(1))) + 1, F.lit(parts)))
    return row_index(df, key).withColumn("_t", total.scalar()).withColumn("part", part.cast("int")).drop("_t", "rn")


def batches(df: DataFrame, key: str, size: int = 200) -> DataFrame:
    """``(batch, items)`` of ``size`` keys each, in key order."""
    keyed = row_index(df.select(key).where(F.col(key).isNotNull()).distinct(), key)
    return keyed.groupBy(F.floor((F.col("rn") - 1) / size).alias("batch")).agg(F.array_sort(F.collect_list(key)).alias("items"))


def quantile_bins(df: DataFrame, column: str, bins: int = 4) -> DataFrame:
    """Adds ``<column>_bin`` (0 to bins - 1) by exact quantiles; a value on a cut belongs to the bin above; null stays null."""
    cuts = df.agg(F.percentile(column, F.array(*(F.lit(i / bins) for i in range(1, bins)))).alias("c"))
    below = F.size(F.filter("_cuts", lambda x: F.col(column) >= x))
    return df.withColumn("_cuts", cuts.scalar()).withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), below)).drop("_cuts")
