"""Masks as pixels and as spans (keys, y, x0, x1: runs of a row, ends included)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidejobs.functions.storage import apart
from slidejobs.operators.annotations import merge_spans
from slidejobs.operators.tiles import WHITE


def to_spans(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of neighbouring pixels (keys, x, y); repeated pixels count once."""
    row = W.partitionBy(*keys, "y").orderBy("x")
    runs = pixels.select(*keys, "x", "y", (F.col("x") - F.dense_rank().over(row)).alias("run"))
    return runs.groupBy(*keys, "y", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")


def to_pixels(spans: DataFrame) -> DataFrame:
    return spans.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def tile_spans(tiles: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Spans of whole tiles: one row per tile and pixel row, then merged."""
    rows = tiles.withColumn("y", F.explode(F.sequence(F.col("ty") * size, F.col("ty") * size + size - 1)))
    return merge_spans(rows.select(*keys, "y", (F.col("tx") * size).alias("x0"), (F.col("tx") * size + size - 1).alias("x1")), keys)


def stroma_mask(class_pixels: DataFrame) -> DataFrame:
    """class_pixels with mask: 255 for stroma, 0 for the other classes and background, 1 for blanked pixels."""
    return class_pixels.withColumn("mask", F.when(F.col("cls") == 2, 255).when(F.col("cls") == WHITE, 1).otherwise(0))


def stroma_pixels(pixels: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """pixels (keys, x, y, r, g, b), black outside the stroma; patches without a mask are left out."""
    m = mask.select(*keys, "x", "y", "mask")
    on = F.col("mask") == 255
    return pixels.join(m, [*keys, "x", "y"]).select(*keys, "x", "y", *[F.when(on, F.col(c)).otherwise(0).alias(c) for c in "rgb"])


def class_mask(class_pixels: DataFrame, cls: int) -> DataFrame:
    """The pixels of one class."""
    return class_pixels.filter(F.col("cls") == cls).drop("cls")


def mask_and(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of what two disjoint span tables share. Rows meet by (keys, y); only columns of `keys` stay, and those of a."""
    o = b.select(*keys, "y", F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    both = a.join(apart(o), [*keys, "y"]).filter("x0 <= o1 and o0 <= x1")
    return both.withColumns({"x0": F.greatest("x0", "o0"), "x1": F.least("x1", "o1")}).drop("o0", "o1")


def mask_or(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    cols = [*keys, "y", "x0", "x1"]
    return merge_spans(a.select(*cols).unionByName(b.select(*cols)), keys)


def spans_where(events: DataFrame, keys: list[str], sums: list[str], holds: str) -> DataFrame:
    """Spans (keys, y, x0, x1) where `holds` is true of the running sums of events (keys, y, x and the columns of `sums`); it is false of zeros."""
    line = W.partitionBy(*keys, "y").orderBy("x")
    at = events.groupBy(*keys, "y", "x").agg(*[F.sum(c).alias(c) for c in sums])
    run = at.select(*keys, "y", "x", *[F.sum(c).over(line.rowsBetween(W.unboundedPreceding, 0)).alias(c) for c in sums]).withColumn("on", F.expr(holds))
    turns = run.withColumn("was", F.coalesce(F.lag("on").over(line), F.lit(False))).filter("on <> was")
    return turns.select(*keys, "y", "on", F.col("x").alias("x0"), (F.lead("x").over(line) - 1).alias("x1")).filter("on").drop("on")


def span_events(spans: DataFrame, keys: list[str], row: Column, marks: dict[str, int]) -> DataFrame:
    """Each span as two events of its row: the marks where it begins, and less the marks after its end."""
    ends = F.array(*[F.struct(x.cast("int").alias("x"), *[F.lit(sign * v).alias(c) for c, v in marks.items()]) for x, sign in ((F.col("x0"), 1), (F.col("x1") + 1, -1))])
    return spans.select(*keys, row.cast("int").alias("y"), F.explode(ends).alias("e")).select(*keys, "y", "e.*")


def union_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, y, x0, x1) that overlap or touch become one, by events that are summed before they are moved."""
    return spans_where(span_events(spans, keys, F.col("y"), {"n": 1}), keys, ["n"], "n > 0")


def mask_minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, y, x0, x1) of what the first has and the second hasn't. Both may overlap themselves."""
    both = span_events(a, keys, F.col("y"), {"own": 1, "other": 0}).unionByName(span_events(b, keys, F.col("y"), {"own": 0, "other": 1}))
    return spans_where(both, keys, ["own", "other"], "own > 0 and other = 0")


def area(spans: DataFrame, keys: list[str], name: str = "area") -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias(name))
