"""Rasters in blocks, distances, fills, groups, stitched masks and resumed steps, against plain versions on small random input."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidejobs.functions.stages import Stages
from slidejobs.operators import annotations as an
from slidejobs.operators import blocks as bl
from slidejobs.operators import distance as di
from slidejobs.operators import masks as ma
from slidejobs.operators import mosaic as mo
from slidejobs.operators import nuclei as nu
from slidejobs.operators import tiles as ti
from slidejobs.sources import annotation_xml as xm

rng = np.random.default_rng(5)


def spans_of(image):
    """y, x0, x1 of the runs of a boolean array."""
    out = []
    for y, row in enumerate(image):
        turn = np.diff(np.r_[0, row.astype(int), 0])
        out += [(y, int(a), int(b) - 1) for a, b in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
    return out


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def brute_d2(image):
    at = np.argwhere(image)
    grid = np.indices(image.shape)
    return np.min([(grid[0] - y) ** 2 + (grid[1] - x) ** 2 for y, x in at], axis=0)


@pytest.mark.parametrize("density", [0.002, 0.05, 0.5])
def test_lower_envelopes(density):
    image = rng.random((40, 30)) < density
    image[7, 3] = True
    far = 200
    near = np.abs(np.arange(30)[None, :, None] - np.arange(30)[None, None, :]) + np.where(image[:, None, :], 0, far)
    assert (di.column_distances(np.minimum(near.min(axis=2), far))[image.any(axis=1)] == brute_d2(image)[image.any(axis=1)]).all()
    assert di.column_distances(np.zeros((0, 4), int)).shape == (0, 4)


@pytest.fixture(scope="module")
def clusters(spark):
    images = {i: rng.random((50, 70)) < p for i, p in enumerate((0.003, 0.1, 0.6))}
    images[3] = np.zeros((50, 70), bool)
    images[3][10:40, 20:60] = True
    rows = [(i, *s) for i, im in images.items() for s in spans_of(im)]
    slides = spark.createDataFrame([(i, 70, 50) for i in images], "slide long, width int, height int")
    return images, spark.createDataFrame(rows, "slide long, y int, x0 int, x1 int").repartition(4), slides


@pytest.mark.parametrize(("limit", "block"), [(5, 8), (9, 64), (3, None)])
def test_distances(clusters, limit, block):
    images, spans, slides = clusters
    got = {(r.slide, r.y, r.x): r.d2 for r in di.distance_to_clusters(spans, slides, limit, ["slide"], block).collect()}
    want = {(i, int(y), int(x)): int(d[y, x]) for i, im in images.items() for d in [brute_d2(im)] for y, x in np.argwhere(d <= limit * limit)}
    assert got == want


def test_distance_masks(spark, clusters):
    images, spans, slides = clusters
    dists = spark.createDataFrame([(0,), (4,), (11,)], "dist int")
    got = sorted((r.slide, r.dist, r.y, r.x0, r.x1) for r in di.distance_mask(spans, slides, dists, ["slide"]).collect())
    want = sorted((i, d, *s) for i, im in images.items() for d in (0, 4, 11) for s in spans_of(brute_d2(im) <= d * d))
    assert got == want


def test_inner_spans_make_no_border(clusters):
    _, spans, _ = clusters
    solid = spans.filter("slide = 3")
    for step, row in ((-1, 10), (1, 39)):
        assert [(r.y, r.x0, r.x1) for r in di.border_segments(solid, ["slide"], step).collect()] == [(row, 20, 59)]


def inside(ring, x, y):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay <= y) != (by <= y) and (ax - x) * abs(by - ay) + (y - ay) * (bx - ax) * (1 if by > ay else -1) < 0:
            odd = not odd
    return odd


def test_polygon_fill(spark):
    r = random.Random(1)
    rings = {i: [(r.randint(0, 15), r.randint(0, 12)) for _ in range(n)] for i, n in enumerate([1, 2, 3, 3, 4, 5, 8, 13, 3, 6])}
    rings[10] = [(0, 0), (9, 0), (9, 4), (4, 4), (4, 2), (9, 2), (9, 4), (0, 4)]
    rows = [(i, j, x, y) for i, ring in rings.items() for j, (x, y) in enumerate(ring)]
    df = an.polygon_fill(spark.createDataFrame(rows, "id long, seq int, x int, y int").repartition(3), ["id"])
    got = {i: set() for i in rings}
    for s in df.collect():
        px = {(s.y, x) for x in range(s.x0, s.x1 + 1)}
        assert not got[s.id] & px and (s.y, s.x0 - 1) not in got[s.id]
        got[s.id] |= px
    assert got == {i: {(y, x) for y in range(-1, 14) for x in range(-1, 17) if inside(ring, x, y)} for i, ring in rings.items()}
    assert exchanges(an.polygon_fill(spark.createDataFrame(rows, "id long, seq int, x int, y int"), ["id"])) == 1
    assert an.polygon_fill(spark.createDataFrame([], "id long, seq int, x int, y int"), ["id"]).count() == 0


def brute_groups(boxes):
    root = {i: i for i in range(len(boxes))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(enumerate(boxes), 2):
        if a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return [find(i) for i in range(len(boxes))]


@pytest.mark.parametrize(("n", "size", "most"), [(40, 3, 7), (200, 4, 1 << 20), (60, 60, 10), (0, 1, 5), (1, 1, 5)])
def test_sweep(n, size, most):
    at = rng.integers(0, 100, (n, 2))
    boxes = np.c_[at, at + rng.integers(0, size + 1, (n, 2))]
    got = an.sweep(*boxes.T.reshape(4, -1), most=most)
    want = brute_groups(boxes.tolist())
    assert [got[i] == got[j] for i in range(n) for j in range(n)] == [want[i] == want[j] for i in range(n) for j in range(n)]


def test_groups_across_cells(spark):
    at = rng.integers(0, 300, (150, 2))
    wh = rng.integers(1, 30, (150, 2))
    boxes = spark.createDataFrame([(i % 2, i, *map(int, at[i]), *map(int, wh[i])) for i in range(150)], "slide long, region long, x int, y int, w int, h int")
    for cell in (16, 4096):
        got = {(r.slide, r.region): r.group_id for r in an.overlap_groups(boxes, cell).collect()}
        for slide in (0, 1):
            own = [i for i in range(150) if i % 2 == slide]
            roots = brute_groups(np.c_[at, at + wh][own].tolist())
            assert [got[slide, i] for i in own] == [own[r] for r in roots]


@pytest.fixture(scope="module")
def patches(spark):
    rows, sets = [], {}
    for slide in range(3):
        for position in range(6):
            x0, y0, w, h = (int(v) for v in (*rng.integers(0, 25, 2), *rng.integers(5, 16, 2)))
            rows.append((slide, position * 2, x0, y0, w, h, (slide + position) % 5 != 0))
            sets[slide, position * 2] = rng.random((h, w)) < 0.5
    manifest = spark.createDataFrame(rows, "slide long, position int, x0 int, y0 int, w int, h int, colored boolean")
    return manifest, manifest.filter("position <> 6").select("slide", "position"), sets


def test_stitched_masks_are_stitched_pixels(spark, patches):
    manifest, readable, sets = patches
    spans = spark.createDataFrame([(*k, *s) for k, im in sets.items() for s in spans_of(im)], "slide long, position int, y int, x0 int, x1 int")
    px = spark.createDataFrame([(*k, x, y, 255 * int(im[y, x])) for k, im in sets.items() for y in range(im.shape[0]) for x in range(im.shape[1])], "slide long, position int, px int, py int, v int")
    want = {(r.slide, r.y, r.x): r.v for r in mo.stitch_patches(px, manifest, readable).filter("v > 0").collect()}
    got = {}
    for r in mo.stitch_masks(spans, manifest, readable).collect():
        for x in range(r.x0, r.x1 + 1):
            assert (r.slide, r.y, x) not in got
            got[r.slide, r.y, x] = r.v
    assert got == want and set(got.values()) >= {127, 255}


def test_patches_out_of_their_canvas(spark, patches):
    manifest, readable, _ = patches
    px = spark.createDataFrame([], "slide long, position int, px int, py int, v int")
    sizes = manifest.select("slide", "position", "w", (F.col("h") + F.when((F.col("slide") == 1) & (F.col("position") == 4), 100).otherwise(0)).alias("h"))
    with pytest.raises(ValueError, match="1 4"):
        mo.stitch_patches(px, manifest, readable, sizes=sizes)
    assert mo.stitch_patches(px, manifest, readable, sizes=manifest).count() == 0


@pytest.fixture(scope="module")
def raster(spark):
    images = {("a", 1): rng.integers(0, 256, (23, 31, 3)), ("a", 2): np.full((10, 10, 3), 240), ("b", 1): rng.integers(100, 103, (7, 9, 3))}
    px = [(*k, x, y, *map(int, im[y, x])) for k, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    extents = spark.createDataFrame([(*k, im.shape[1], im.shape[0]) for k, im in images.items()], "slide string, position int, width int, height int")
    pixels = spark.createDataFrame(px, "slide string, position int, x int, y int, r int, g int, b int").repartition(4)
    return images, pixels, extents, bl.to_blocks(pixels, extents, ["slide", "position"], 10)


KEYS = ["slide", "position"]


def test_blocks_hold_all_pixels(raster):
    images, pixels, extents, blocks = raster
    assert sorted(map(tuple, bl.block_pixels(blocks, KEYS).collect())) == sorted(map(tuple, pixels.collect()))
    assert {(r.w, r.h) for r in blocks.collect()} == {(10, 10), (1, 10), (10, 3), (1, 3), (9, 7)}
    some = bl.to_blocks(pixels.filter("x > 15"), extents, KEYS, 10).filter("slide = 'a' and position = 1 and bx = 1 and by = 0").first()
    assert np.array_equal(np.frombuffer(some.rgb, np.uint8).reshape(10, 10, 3), np.where(np.arange(10, 20)[None, :, None] > 15, images["a", 1][:10, 10:20], 0))


def test_tiles_of_blocks(raster):
    images, pixels, extents, blocks = raster
    good = {(r.slide, r.position, r.tx, r.ty): r.good for r in bl.block_tiles(blocks, KEYS, 5).collect()}
    full = {(*k, tx, ty) for k, im in images.items() for tx in range(im.shape[1] // 5) for ty in range(im.shape[0] // 5)}
    assert set(good) == full
    assert good == {k: v for k, v in {(r.slide, r.position, r.tx, r.ty): r.good for r in ti.good_tiles(pixels, KEYS, 5).collect()}.items() if k in full}
    scorer = lambda: lambda x: (x * 255).sum(axis=(1, 2))
    cls = {(r.slide, r.position, r.tx, r.ty): r.cls for r in bl.classify_blocks(blocks, extents, KEYS, scorer, 5).collect()}
    for (s, p, tx, ty), c in cls.items():
        part = images[s, p][ty * 5 : ty * 5 + 5, tx * 5 : tx * 5 + 5]
        want = 0 if part.shape[:2] != (5, 5) else -1 if (part.min(axis=2) > 230).sum() > 22.5 else int(part.sum(axis=(0, 1)).argmax())
        assert c == want
    assert len(cls) == sum(-(-im.shape[1] // 5) * -(-im.shape[0] // 5) for im in images.values())
    assert bl.classify_blocks(blocks, extents, KEYS, scorer, 5, cut=None).count() == len(full)


def test_class_spans_are_rendered_classes(raster):
    images, pixels, extents, blocks = raster
    tiles = bl.classify_blocks(blocks, extents, KEYS, lambda: lambda x: x.sum(axis=(1, 2)), 5, cut=None)
    for (s, p), im in images.items():
        own = f"slide = '{s}' and position = {p}"
        want = sorted((r.y, r.x) for r in ti.render_classes(pixels.filter(own), tiles, KEYS, im.shape[1], im.shape[0], 5).filter("cls = 1").collect())
        assert sorted((r.y, r.x) for r in ma.to_pixels(ti.class_spans(tiles, extents, KEYS, 1, 5).filter(own)).distinct().collect()) == want


def test_normalised_blocks(raster):
    images, pixels, _, blocks = raster
    rows = {(r.slide, r.position, r.y, r.x): (r.r, r.g, r.b) for r in nu.percentile_normalize(pixels, KEYS).collect()}
    for r in bl.normalize_blocks(blocks, KEYS).collect():
        v = np.frombuffer(r["values"], "<f4").reshape(r.h, r.w, 3)
        low, high = np.percentile(images[r.slide, r.position].reshape(-1, 3), [1, 99.8], axis=0)
        part = images[r.slide, r.position][r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w]
        with np.errstate(all="ignore"):
            assert np.allclose(v, np.where(high > low, (part - low) / (high - low), np.nan), atol=1e-4, equal_nan=True)
        for i, x in enumerate(rows[r.slide, r.position, r.y0, r.x0]):
            assert np.isnan(v[0, 0, i]) if x is None else v[0, 0, i] == pytest.approx(x, abs=1e-4)


def test_runs_and_differences(raster):
    images, _, _, blocks = raster
    runs = bl.block_runs(blocks, KEYS, lambda im: im[:, :, 0] > 120)
    joined = sorted((r.slide, r.position, r.y, r.x0, r.x1) for r in ma.union_spans(runs, KEYS).collect())
    assert joined == sorted((*k, *s) for k, im in images.items() for s in spans_of(im[:, :, 0] > 120))
    other = bl.block_runs(blocks, KEYS, lambda im: im[:, :, 1] > 90)
    left = sorted((r.slide, r.position, r.y, r.x0, r.x1) for r in ma.mask_minus(runs, other, KEYS).collect())
    assert left == sorted((*k, *s) for k, im in images.items() for s in spans_of((im[:, :, 0] > 120) & ~(im[:, :, 1] > 90)))


def test_annotations_of_any_root(spark):
    files = {
        "page": "<html><body><p>no</p></body></html>", "other": '<Other><a><Coordinates><q X="3.9" Y="-2.5"/><r X="1" Y="2"/></Coordinates></a><Coordinates/></Other>', "cut": "<Annotations><Annotation>", "blank": " \n", "null": None,
        "both": '<ASAP_Annotations><Annotation Id="7"><g><Region><Vertex X="1" Y="x"/><Vertex X="4" Y="5"/><Vertex X="inf" Y="1"/></Region></g></Annotation><Coordinates><c X="1" Y="1"/></Coordinates></ASAP_Annotations>',
        "bare": '<A><Annotation><Region/><Region><Vertex Y="1" X="8"/></Region></Annotation></A>', "bom": '﻿<?xml version="1.0" encoding="utf-8"?><A><Coordinates><c X="1" Y="1"/></Coordinates></A>',
    }
    df = spark.createDataFrame(list(files.items()), "path string, content string")
    got = sorted(tuple(r) for r in xm.read_annotations(df).select("path", "flavour", "region", "seq", "x", "y", F.coalesce("layer_id", F.lit(-1))).collect())
    assert got == [("bare", "imagescope", 1, 0, 8, 1, -1), ("bom", "asap", 0, 0, 1, 1, -1), ("both", "imagescope", 0, 1, 4, 5, 7), ("other", "asap", 0, 0, 3, -2, -1), ("other", "asap", 0, 1, 1, 2, -1)]
    assert {r.path: r.reason for r in xm.rejected_annotations(df).collect()} == {"page": "no annotations", "cut": "malformed", "blank": "empty", "null": "empty"}
    bad = spark.createDataFrame([("x", '<A><Coordinates><c X="1"/></Coordinates></A>')], "path string, content string")
    with pytest.raises(Exception, match="vertex without y"):
        xm.read_asap(bad).collect()


def test_a_stopped_run_goes_on(spark, tmp_path):
    slides = spark.createDataFrame([(i,) for i in range(40)], "slide long")
    made, fail = [], {"at": 3}

    def make(left):
        if fail["at"] == 0:
            raise RuntimeError("lost")
        fail["at"] -= 1
        made.append({r.slide for r in left.collect()})
        return left.select("slide", F.explode(F.array(F.lit(1), F.lit(2))).alias("v"))

    stages = Stages(spark, f"file://{tmp_path}/run", waves=5)
    with pytest.raises(RuntimeError):
        stages.run("step", slides, make)
    before = set().union(*made)
    assert len(made) == 3 and {r.slide for r in stages.finished("step", slides).collect()} == before
    # rows of a wave that was killed before its markers
    spark.createDataFrame([(99, 1), (1, 9)], "slide long, v int").write.parquet(f"file://{tmp_path}/run/step/rows/wave=wkilled")
    fail["at"] = 100
    out = stages.run("step", slides, make)
    assert sorted((r.slide, r.v) for r in out.collect()) == [(i, v) for i in range(40) for v in (1, 2)]
    assert not before & set().union(*made[3:]) and sum(map(len, made)) == 40
    stages.run("step", slides, make)
    assert sum(map(len, made)) == 40
    assert stages.run("step", slides.filter("slide < 3"), make).count() == 6
