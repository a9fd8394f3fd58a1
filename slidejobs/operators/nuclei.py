"""Nucleus outlines: normalised channels, shape features, filters, labels and erosion."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from slidejobs.functions.storage import small, stored
from slidejobs.operators.annotations import merge_spans
from slidejobs.operators.grid import gray
from slidejobs.operators.masks import area, mask_and, to_pixels


def channel_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, c, v, n: how many pixels have value v (0 to 255) in channel c. A task sends 256 counts per key and channel at most for a batch of pixels."""
    rows = pixels.select(*keys, *[F.col(c).cast("int").alias(c) for c in "rgb"])
    names = [*keys, "c", "v", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            for c in "rgb":
                n = t.group_by([*keys, c], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
                cols = [n.column(k) for k in keys] + [pa.array([c] * len(n)), n.column(c), n.column("count_all").cast(pa.int64())]
                yield from pa.table(cols, names).to_batches()

    types = {f.name: f.dataType for f in rows.schema}
    counts = rows.mapInArrow(run, StructType([*[StructField(k, types[k]) for k in keys], StructField("c", StringType()), StructField("v", IntegerType()), StructField("n", LongType())]))
    return counts.groupBy(*keys, "c", "v").agg(F.sum("n").alias("n"))


def percentile_normalize(pixels: DataFrame, keys: list[str], low: float = 0.01, high: float = 0.998) -> DataFrame:
    """keys, x, y, r, g, b as (v - p_low) / (p_high - p_low), per channel; null where both percentiles are equal.

    Percentiles are exact: values are counted first (256 at most per key and channel), and the counts weigh in. blocks.normalize_blocks does the same for rasters in blocks.
    """
    counts = channel_counts(pixels, keys)
    q = counts.groupBy(*keys).agg(*[F.expr(f"percentile(v, array({low}, {high}), n) filter (where c = '{c}')").alias(f"q{c}") for c in "rgb"])
    scaled = [F.try_divide(F.col(c) - F.col(f"q{c}")[0], F.col(f"q{c}")[1] - F.col(f"q{c}")[0]).alias(c) for c in "rgb"]
    q = small(stored(q, "percentiles"))  # one row for each key
    return pixels.join(q, keys).select(*keys, "x", "y", *scaled)


def contours_from_detections(detections: DataFrame) -> DataFrame:
    """detections with pts: coordinate arrays ys, xs as points of whole numbers, cut towards zero."""
    return detections.withColumn("pts", F.zip_with("xs", "ys", lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y")))).drop("xs", "ys")


def _edges(pts: str) -> Column:
    n = F.size(pts)
    turned = F.when(n > 0, F.concat(F.slice(pts, 2, F.greatest(n - 1, F.lit(0))), F.slice(pts, 1, 1))).otherwise(F.col(pts))
    return F.zip_with(F.col(pts), turned, lambda p, q: F.struct(p.x.cast("long").alias("ax"), p.y.cast("long").alias("ay"), q.x.cast("long").alias("bx"), q.y.cast("long").alias("by")))


def contour_features(contours: DataFrame, pts: str = "pts") -> DataFrame:
    """contours with area (of the polygon), perimeter (closed) and roundness p^2 / (4 pi A), 0 if either is 0."""
    edges = _edges(pts)
    area = F.abs(F.aggregate(edges, F.lit(0).cast("long"), lambda s, e: s + e.ax * e.by - e.bx * e.ay)) / 2
    length = F.aggregate(edges, F.lit(0.0), lambda s, e: s + F.sqrt(((e.ax - e.bx) * (e.ax - e.bx) + (e.ay - e.by) * (e.ay - e.by)).cast("double")))
    out = contours.withColumn("area", area).withColumn("perimeter", length)
    round_ = F.col("perimeter") * F.col("perimeter") / (4 * F.pi() * F.col("area"))
    return out.withColumn("roundness", F.when((F.col("area") == 0) | (F.col("perimeter") == 0), 0.0).otherwise(round_))


def size_limits(slides: DataFrame) -> DataFrame:
    """slide, min_area, max_area, max_roundness in pixels: discs of 2 and 9 microns across (pi as 3.14). Slides without a resolution are left out."""
    known = slides.filter("mpp_x > 0 and mpp_y > 0")
    disc = lambda d: F.lit((d / 2) ** 2 * 3.14) / (F.col("mpp_x") * F.col("mpp_y"))
    return known.select("slide", disc(2).alias("min_area"), disc(9).alias("max_area"), F.when(F.col("mpp_x") < 0.3, 1.2).otherwise(1.4).alias("max_roundness"))


def rejected_slides(slides: DataFrame) -> DataFrame:
    """Slides that size_limits leaves out."""
    return slides.filter(~F.coalesce((F.col("mpp_x") > 0) & (F.col("mpp_y") > 0), F.lit(False)))


def shape_filter(features: DataFrame, limits: DataFrame) -> DataFrame:
    """Contours strictly between the limits of their slide."""
    kept = features.join(limits, "slide").filter("area > min_area and area < max_area and roundness < max_roundness and area <> 0 and perimeter <> 0")
    return kept.select(*features.columns)


def stroma_filter(spans: DataFrame, stroma: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """keys, inside, filled of the contours (spans: keys, y, x0, x1; keys begin with slide) of which at least that share is stroma.

    stroma: slide, x, y, r, g, b, black outside; a pixel counts if its gray isn't 0.
    """
    filled = to_pixels(spans)
    lit_ = stroma.filter(gray(F.col("r"), F.col("g"), F.col("b"), swapped=False) > 0).select("slide", "x", "y", F.lit(1).alias("on"))
    sums = filled.join(lit_, ["slide", "x", "y"], "left").groupBy(*keys).agg(F.sum(F.coalesce("on", F.lit(0))).alias("inside"), F.count(F.lit(1)).alias("filled"))
    return sums.filter(F.col("inside") >= F.col("filled") * least)


def stroma_filter_spans(spans: DataFrame, lit: DataFrame, keys: list[str], place: list[str], least: float = 0.5) -> DataFrame:
    """The same of spans alone: lit has the disjoint spans (place, y, x0, x1) of stroma that isn't black; keys begin with place."""
    filled = area(spans, keys, "filled")
    inside = area(mask_and(spans, lit, place), keys, "inside")
    return filled.join(inside, keys, "left").fillna(0, ["inside"]).filter(F.col("inside") >= F.col("filled") * least).select(*keys, "inside", "filled")


def til_mask(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of contours, as spans by `keys`."""
    return merge_spans(spans.select(*keys, "y", "x0", "x1"), keys)


def label_pixels(spans: DataFrame, keys: list[str], contour: str = "contour") -> DataFrame:
    """keys, x, y, label: the 1-based index (in the order of contour) of the last contour that covers a pixel."""
    order = spans.select(*keys, contour).distinct().withColumn("label", F.row_number().over(W.partitionBy(*keys).orderBy(contour)))
    return to_pixels(spans.join(order, [*keys, contour])).groupBy(*keys, "x", "y").agg(F.max("label").cast("int").alias("label"))


def erode_overlaps(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labelled pixels whose 3 x 3 neighbourhood holds no other label.

    Runs of one label meet the runs of other labels in their own and the neighbouring rows; only the pixels next to such a run are made twice.
    """
    labels = stored(labels.select(*keys, "x", "y", "label"), "labels")  # read three times
    line = W.partitionBy(*keys, "y", "label").orderBy("x")
    px = labels.select(*keys, "y", "label", "x", (F.col("x") - F.row_number().over(line)).alias("run"))
    runs = px.groupBy(*keys, "y", "label", "run").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("run")
    other = runs.select(*keys, F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), F.col("label").alias("l"), F.col("x0").alias("o0"), F.col("x1").alias("o1"))
    met = runs.join(other, [*keys, "y"]).filter("label <> l and o0 <= x1 + 1 and x0 <= o1 + 1")
    gone = met.select(*keys, "y", F.explode(F.sequence(F.greatest("x0", F.col("o0") - 1), F.least("x1", F.col("o1") + 1))).alias("x")).distinct()
    return labels.join(gone, [*keys, "x", "y"], "left_anti")
