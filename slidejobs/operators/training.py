"""Reproducible training, validation and test sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOD, STEP = 10007, 7919


def split_dataset(items: DataFrame, seed: int = 0, val: float = 0.2, test: float = 0.125, buckets: int = MOD) -> DataFrame:
    """items (class, item: a long) with split: per class ceil(val * n) for validation, ceil(test * rest) for test, the rest to train.

    The order is (item * STEP + seed) % MOD, then item. A class may hold most items, so ranks come in two stages: rows before a
    bucket of that order, and the rank within it.
    """
    order = F.pmod(F.col("item") * STEP + seed, F.lit(MOD))
    rows = items.withColumn("_b", order)
    sizes = rows.groupBy("class", "_b").agg(F.count(F.lit(1)).alias("_n"))
    ahead = W.partitionBy("class").orderBy("_b")  # MOD rows per class at most
    sizes = sizes.withColumn("_before", F.sum("_n").over(ahead) - F.col("_n")).withColumn("_all", F.sum("_n").over(W.partitionBy("class"))).drop("_n")
    rank = F.col("_before") + F.row_number().over(W.partitionBy("class", "_b").orderBy("item"))
    n_val = F.ceil(F.round(F.col("_all") * val, 6))
    n_test = F.ceil(F.round((F.col("_all") - n_val) * test, 6))
    split = F.when(rank <= n_val, "val").when(rank <= n_val + n_test, "test").otherwise("train")
    return rows.join(sizes, ["class", "_b"]).withColumn("split", split).select(*items.columns, "split")


def class_index(items: DataFrame) -> DataFrame:
    """class, idx: names in order, from 0. Classes are few."""
    return items.select("class").distinct().withColumn("idx", F.row_number().over(W.orderBy("class")) - 1)


def class_counts(split: DataFrame) -> DataFrame:
    """class and the number of items per split."""
    return split.groupBy("class").agg(*[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")])
