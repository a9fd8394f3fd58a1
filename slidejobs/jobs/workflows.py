"""The three workflows from tables to results; every step is a table, and a slide that has its result is left out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidejobs.functions.stages import Stages
from slidejobs.functions.storage import small, stored
from slidejobs.operators import annotations as an
from slidejobs.operators import blocks as bl
from slidejobs.operators import grid as gr
from slidejobs.operators import masks as ma
from slidejobs.operators import mosaic as mo
from slidejobs.operators import nuclei as nu
from slidejobs.operators import scores as sc
from slidejobs.operators import tiles as ti
from slidejobs.operators import training as tr


def _kept(stages: Stages | None, name: str, slides: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """make(slides); with stages only for the slides that this step hasn't finished."""
    return make(slides) if stages is None else stages.run(name, slides, make)


def _of(rows: DataFrame, slides: DataFrame) -> DataFrame:
    return rows.join(slides.select("slide"), "slide", "left_semi")


def patches_of(vertices: DataFrame, slides: DataFrame, pixels: DataFrame, size: tuple[int, int] = gr.PATCH, least_overlap: float = 0.7, most_white: float = 0.7, stages: Stages | None = None) -> DataFrame:
    """Annotated regions to numbered patches. stages: where the patches of finished slides are kept."""

    def make(left: DataFrame) -> DataFrame:
        v = _of(vertices, left)
        groups = an.overlap_groups(an.bounding_boxes(v, ["slide", "region"]))
        grid = gr.patch_grid(an.group_boxes(v, groups), left, size)
        spans = an.merge_spans(an.polygon_fill(v, ["slide", "region"]).join(groups, ["slide", "region"]), ["slide", "group_id"])
        return gr.select_patches(gr.patch_white(gr.annotation_overlap(grid, spans, ["slide", "group_id"], size), _of(pixels, left)), least_overlap, most_white)

    return _kept(stages, "patches", slides, make)


def global_scores(slides: DataFrame, tiles: DataFrame, outlines: DataFrame, stroma_px: DataFrame, tile: int = ti.TILE, done: DataFrame | None = None) -> DataFrame:
    """Classified tiles (slide, tx, ty, cls), outlines (slide, contour, seq, x, y) and stroma pixels to the global score of each slide.

    Tiles are smoothed, outlines filtered by shape and by stroma, and touching nuclei parted, before areas are counted.
    """
    if done is not None:
        slides = an.pending_work(slides, done, ["slide"])
    stroma = ma.tile_spans(ma.class_mask(ti.tile_smooth(tiles, ["slide"]), 2), ["slide"], tile)
    pts = outlines.groupBy("slide", "contour").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v.x.alias("x"), v.y.alias("y"))).alias("pts"))
    shaped = nu.shape_filter(nu.contour_features(pts), nu.size_limits(slides)).select("slide", "contour")
    spans = an.polygon_fill(outlines.join(shaped, ["slide", "contour"], "left_semi"), ["slide", "contour"])
    kept = spans.join(nu.stroma_filter(spans, stroma_px, ["slide", "contour"]).select("slide", "contour"), ["slide", "contour"], "left_semi")
    til = ma.to_spans(nu.erode_overlaps(nu.label_pixels(kept, ["slide"]), ["slide"]), ["slide"])
    return sc.global_score(slides, til, stroma)


def stitched_global_scores(slides: DataFrame, manifest: DataFrame, readable: DataFrame, stroma_px: DataFrame, til_px: DataFrame, pad: bool = False, done: DataFrame | None = None) -> DataFrame:
    """Masks of patches (slide, position, px, py, v: 0 or 255) to the global score of each slide, over their mosaics.

    Seams where patches disagree hold values between: they count as TIL (over 0), not as stroma (255 exactly).
    """
    if done is not None:
        slides = an.pending_work(slides, done, ["slide"])
        manifest = manifest.join(slides.select("slide"), "slide", "left_semi")
    spans = lambda px, on: ma.to_spans(mo.stitch_patches(px, manifest, readable, pad).filter(on), ["slide"])
    return sc.global_score(slides, stored(spans(til_px, "v > 0"), "til"), spans(stroma_px, "v = 255"))


def spatial_sweep(slides: DataFrame, tiles: DataFrame, til: DataFrame, areas: DataFrame, dists: DataFrame, tile: int = ti.TILE, stages: Stages | None = None) -> DataFrame:
    """Scores by cluster size and distance, of classified tiles and TIL spans. stages: where the scores of finished slides are kept; other thresholds are another run."""

    def make(left: DataFrame) -> DataFrame:
        spans = lambda cls: ma.tile_spans(ma.class_mask(_of(tiles, left), cls), ["slide"], tile)
        return sc.spatial_scores(left, spans(0), spans(2), _of(til, left), areas, dists)

    return _kept(stages, "sweep", slides, make)


def training_set(vertices: DataFrame, layers: DataFrame, slides: DataFrame, pixels: DataFrame, sizes: DataFrame, seed: int = 0, stages: Stages | None = None) -> DataFrame:
    """Annotated layers to numbered patches of each size, with class index and split. stages: where the patches of finished slides are kept; indices and splits are made of all of them."""

    def make(left: DataFrame) -> DataFrame:
        v = _of(vertices, left).join(small(layers.filter("class <> 'skip'")), "layer_id")
        classes = v.select("slide", "region", "class").distinct()
        cut = gr.training_patches(an.bounding_boxes(v, ["slide", "region"]), an.polygon_fill(v, ["slide", "region"]), left, sizes)
        return gr.number_training_patches(gr.patch_white(cut.filter("overlap >= 0.7"), _of(pixels, left), 220).join(classes, ["slide", "region"]))

    kept = _kept(stages, "training-patches", slides, make)
    keyed = kept.withColumn("item", F.xxhash64("slide", "class", "size", "number").bitwiseAND(F.lit(2**40 - 1)))
    return tr.split_dataset(keyed, seed).join(small(stored(tr.class_index(kept), "classes")), "class").drop("item")


PATCH_KEYS = ["slide", "position"]


def patch_masks(slides: DataFrame, patches: DataFrame, blocks: DataFrame, outlines: DataFrame, make_scorer: Callable, tile: int = ti.TILE) -> dict[str, DataFrame]:
    """Pixels and nucleus outlines of patches to their masks, as spans (slide, position, y, x0, x1): epithelium, stroma and til.

    patches: slide, position, width, height; blocks: rasters of the patches in blocks; outlines: slide, position, contour, seq, x, y within a patch.
    Tiles are scored by the caller's model and smoothed within their patch; white pixels belong to no class. Outlines are kept by shape (the slide's limits)
    and if half of their pixels at least are stroma that isn't black; touching nuclei are parted. Pixels leave their block only as runs.
    """
    tiles = stored(ti.tile_smooth(bl.classify_blocks(blocks, patches, PATCH_KEYS, make_scorer, tile, cut=None), PATCH_KEYS), "tiles")
    white = stored(bl.block_runs(blocks, PATCH_KEYS, bl.is_white), "white")
    of = lambda cls: ma.mask_minus(ti.class_spans(tiles, patches, PATCH_KEYS, cls, tile), white, PATCH_KEYS)
    stroma = stored(of(2), "stroma")
    key = [*PATCH_KEYS, "contour"]
    pts = outlines.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v.x.alias("x"), v.y.alias("y"))).alias("pts"))
    shaped = nu.shape_filter(nu.contour_features(pts), nu.size_limits(slides)).select(*key)
    spans = stored(an.polygon_fill(outlines.join(shaped, key, "left_semi"), key), "outlines")
    lit = ma.mask_minus(stroma, bl.block_runs(blocks, PATCH_KEYS, bl.is_black), PATCH_KEYS)
    kept = spans.join(nu.stroma_filter_spans(spans, lit, key, PATCH_KEYS).select(*key), key, "left_semi")
    til = ma.to_spans(nu.erode_overlaps(nu.label_pixels(kept, PATCH_KEYS), PATCH_KEYS), PATCH_KEYS)
    return {"epithelium": of(0), "stroma": stroma, "til": til}


def pixels_to_scores(
    slides: DataFrame, manifest: DataFrame, readable: DataFrame, blocks: DataFrame, outlines: DataFrame, make_scorer: Callable, tile: int = ti.TILE,
    areas: DataFrame | None = None, dists: DataFrame | None = None, stages: Stages | None = None,
) -> DataFrame:
    """Pixels of patches to the global score of each slide; with areas and dists to the scores of the sweep. Seams are those of the stitched masks:
    where patches disagree a pixel is no stroma and no epithelium, but TIL.

    manifest: slide, position, x0, y0, w, h, colored. stages: where finished slides of each step are kept, so a run that was stopped goes on from there.
    """
    patches = manifest.filter("colored").join(readable.select(*PATCH_KEYS), PATCH_KEYS).select(*PATCH_KEYS, F.col("w").alias("width"), F.col("h").alias("height"))

    def masks(left: DataFrame) -> DataFrame:
        found = patch_masks(left, _of(patches, left), _of(blocks, left), _of(outlines, left), make_scorer, tile)
        both = [df.select(*PATCH_KEYS, *[F.col(c).cast("int").alias(c) for c in ("y", "x0", "x1")], F.lit(kind).alias("kind")) for kind, df in found.items()]
        return both[0].unionByName(both[1]).unionByName(both[2])

    def mosaics(left: DataFrame) -> DataFrame:
        spans = stored(_of(_kept(stages, "masks", slides, masks), left), "masks")
        out = [mo.stitch_masks(spans.filter(F.col("kind") == kind).drop("kind"), _of(manifest, left), _of(readable, left)).withColumn("kind", F.lit(kind)) for kind in ("epithelium", "stroma", "til")]
        return out[0].unionByName(out[1]).unionByName(out[2])

    all_ = stored(_kept(stages, "mosaics", slides, mosaics), "mosaics")
    pick = lambda kind, on: ma.union_spans(all_.filter(F.col("kind") == kind).filter(on), ["slide"])
    til, stroma = stored(pick("til", "v > 0"), "til"), stored(pick("stroma", "v = 255"), "stroma")
    if areas is None or dists is None:
        return sc.global_score(slides, til, stroma)
    return sc.spatial_scores(slides, pick("epithelium", "v = 255"), stroma, til, areas, dists)
