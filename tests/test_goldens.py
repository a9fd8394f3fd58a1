"""Cases by hand for the rules that are easy to get wrong."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slidejobs.functions.components import connected_components
from slidejobs.operators import annotations as an
from slidejobs.operators import grid as gr
from slidejobs.operators import masks as ma
from slidejobs.operators import mosaic as mo
from slidejobs.operators import nuclei as nu
from slidejobs.operators import regions as rg
from slidejobs.operators import scores as sc
from slidejobs.operators import tiles as ti
from slidejobs.operators import training as tr
from slidejobs.sources import annotation_xml, rasters, sinks


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "slide long, region long, x int, y int, w int, h int")


def pixels(spark, picture, slide=1):
    rows = [(slide, x, y) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "slide long, x int, y int")


def groups(df):
    return {r.region: r.group_id for r in df.collect()}


def test_touching_boxes_are_one_group(spark):
    assert groups(an.overlap_groups(boxes(spark, [(0, 0, 5, 5), (5, 0, 5, 5), (11, 0, 2, 2)]), cell=3)) == {0: 0, 1: 0, 2: 2}


def test_chain_is_one_group(spark):
    assert set(groups(an.overlap_groups(boxes(spark, [(0, 0, 4, 4), (3, 3, 4, 4), (6, 6, 4, 4)]))).values()) == {0}


def test_grid_of_reference_size(spark):
    b = spark.createDataFrame([(1, 0, 150, 150, 4000, 3000)], "slide long, group_id long, x int, y int, w int, h int")
    s = spark.createDataFrame([(1, 100000, 100000)], "slide long, width int, height int")
    got = gr.patch_grid(b, s).orderBy("gy", "gx").collect()
    assert [(r.gx, r.gy, r.x0, r.y0) for r in got] == [(150, 150, 0, 0), (4000, 150, 3850, 0), (150, 3000, 0, 2850), (4000, 3000, 3850, 2850)]


@pytest.mark.parametrize("overlap,white,kept", [(0.7, 0.1, 0), (0.71, 0.1, 1), (0.9, 0.7, 0), (0.9, 0.69, 1)])
def test_limits_of_patches(spark, overlap, white, kept):
    p = spark.createDataFrame([(1, 0, 0, 0, overlap, white)], "slide long, group_id long, gy int, gx int, overlap double, white double")
    assert gr.select_patches(p).count() == kept


def test_training_keeps_overlap_of_exactly_the_limit(spark):
    p = spark.createDataFrame([(1, 0, 4, 0, 0, "a", 0.7, 0.1)], "slide long, region long, size int, iy int, ix int, class string, overlap double, white double")
    assert gr.number_training_patches(p).collect()[0].number == 0


def test_white_limit(spark):
    p = spark.createDataFrame([(1, v, v, v) for v in (231, 230, 221, 220)], "k int, r int, g int, b int")
    assert gr.white_fraction(p, ["k"]).first().n_white == 1
    assert gr.white_fraction(p, ["k"], 220).first().n_white == 3


def smooth(spark, rows):
    t = spark.createDataFrame([(1, x, y, c) for y, line in enumerate(rows) for x, c in enumerate(line)], "slide long, tx int, ty int, cls int")
    return {(r.tx, r.ty): r.cls for r in ti.tile_smooth(t, ["slide"]).collect()}


def test_smoothing(spark):
    assert smooth(spark, [[2, 0], [0, 1]])[0, 0] == 0
    assert smooth(spark, [[1, 1, 0], [0, 1, 0], [0, 2, 2]])[1, 1] == 0
    assert smooth(spark, [[0, 2, 0], [2, 1, 0], [2, 0, 2]])[1, 1] == 0  # a tie of 0 and 2
    assert smooth(spark, [[-1, 2, -1], [2, 1, -1], [2, -1, 2]])[1, 1] == 2  # -1 loses ties


def test_first_row_rule_is_sequential(spark):
    t = spark.createDataFrame([(1, x, y, c) for y, line in enumerate([[0, 1, 2, 1], [0, 0, 2, 2]]) for x, c in enumerate(line)], "slide long, tx int, ty int, cls int")
    got = {(r.tx, r.ty): r.cls for r in ti.tile_smooth_first_row(t, ["slide"]).collect()}
    assert [got[x, 0] for x in range(4)] == [0, 0, 0, 2]
    assert [got[x, 1] for x in range(4)] == [0, 0, 2, 2]


@pytest.mark.parametrize("values,want", [([255, 0], 127), ([0, 255], 127), ([255, 255], 255), ([10, 20, 31], 20)])
def test_blend(spark, values, want):
    p = spark.createDataFrame([(1, 0, 0, k, v) for k, v in enumerate(values)], "slide long, x int, y int, k int, v int")
    assert mo.blend_mosaic(p, ["k"]).first().v == want


def test_limits_of_shape_are_strict(spark):
    f = spark.createDataFrame([(1, a, 10.0, 1.0) for a in (5.0, 5.5, 9.0)], "slide long, area double, perimeter double, roundness double")
    lim = spark.createDataFrame([(1, 5.0, 9.0, 1.2)], "slide long, min_area double, max_area double, max_roundness double")
    assert [r.area for r in nu.shape_filter(f, lim).collect()] == [5.5]


def test_half_stroma_is_kept(spark):
    spans = spark.createDataFrame([(1, 7, 0, 0, 3)], "slide long, contour long, y int, x0 int, x1 int")
    st = lambda n: spark.createDataFrame([(1, x, 0, 9, 9, 9) for x in range(n)], "slide long, x int, y int, r int, g int, b int")
    assert nu.stroma_filter(spans, st(2), ["slide", "contour"]).count() == 1
    assert nu.stroma_filter(spans, st(1), ["slide", "contour"]).count() == 0


def test_erosion_of_touching_labels(spark):
    lab = spark.createDataFrame([(1, x, 0, v) for x, v in enumerate([1, 1, 2, 2])], "slide long, x int, y int, label int")
    assert sorted((r.x, r.label) for r in nu.erode_overlaps(lab, ["slide"]).collect()) == [(0, 1), (3, 2)]


def moments(spark, picture):
    lab = rg.external_components(ma.to_spans(pixels(spark, picture), ["slide"]), ["slide"])
    return rg.component_moments(lab, ["slide"])


def test_dot_in_a_ring(spark):
    (m,) = moments(spark, ["#####", "#...#", "#.#.#", "#...#", "#####"]).collect()
    assert (m.a2, m.n) == (32, 25)


def test_corner_neighbours_are_one_component_without_area(spark):
    m = moments(spark, ["#.", ".#"])
    assert [(r.a2, r.n) for r in m.collect()] == [(0, 2)]
    assert rg.centroids(m).count() == 0


def test_centroid_is_rounded_half_to_even(spark):
    c = rg.centroids(moments(spark, ["##", "##"])).first()
    assert (c.a2, c.cx, c.cy) == (2, 0, 0)


def contour(mask):
    """Area and moments of the outer border by the shoelace formula over a traced border (Moore neighbourhood)."""
    pad = np.pad(mask, 1)
    y, x = min(zip(*np.nonzero(pad), strict=True))
    start, at, out = (x, y), (x, y), [(x, y)]
    around = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]
    d, first = 0, None
    while True:
        for i in range(8):
            k = (d + i) % 8
            nx, ny = at[0] + around[k][0], at[1] + around[k][1]
            if pad[ny, nx]:
                break
        else:
            return 0.0
        if first is None:
            first = (nx, ny)
        elif at == start and (nx, ny) == first:
            break
        at, d = (nx, ny), (k + 5) % 8
        out.append(at)
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(out, out[1:] + out[:1], strict=True))) / 2


def test_cells_agree_with_a_traced_border(spark):
    rng = np.random.default_rng(3)
    blobs = {}
    for i in range(30):
        m = np.zeros((9, 9), bool)
        y = x = 4
        for _ in range(25):
            m[y, x] = True
            y, x = np.clip([y + rng.integers(-1, 2), x + rng.integers(-1, 2)], 0, 8)
        blobs[i] = m
    rows = [(i, int(x), int(y)) for i, m in blobs.items() for y, x in zip(*np.nonzero(m), strict=True)]
    lab = rg.external_components(ma.to_spans(spark.createDataFrame(rows, "slide long, x int, y int"), ["slide"]), ["slide"])
    got = {r.slide: r.a2 / 2 for r in rg.component_moments(lab, ["slide"]).collect()}
    assert got == {i: contour(m) for i, m in blobs.items()}


def test_slides_without_stroma_or_resolution(spark):
    slides = spark.createDataFrame([(1, 8, 8, 0.5, 0.5), (2, 8, 8, None, 0.5), (3, 8, 8, 0.0, 0.5)], "slide long, width int, height int, mpp_x double, mpp_y double")
    assert [r.slide for r in nu.rejected_slides(slides).orderBy("slide").collect()] == [2, 3]
    empty = spark.createDataFrame([], "slide long, y int, x0 int, x1 int")
    til = spark.createDataFrame([(1, 0, 0, 3)], "slide long, y int, x0 int, x1 int")
    got = sc.global_score(slides, til, empty).orderBy("slide").collect()
    assert [(r.til_score, r.til_area) for r in got] == [(None, 4), (None, 0), (None, 0)]
    one = lambda c, v: spark.createDataFrame([(v,)], f"{c} int")
    none = sc.spatial_scores(slides, empty, til, til, one("area", 1), one("dist", 1)).collect()
    assert {(r.til_score, r.stroma_area) for r in none} == {(None, 0)}


def test_cluster_and_distance_of_exactly_the_limits(spark):
    slides = spark.createDataFrame([(1, 30, 30)], "slide long, width int, height int")
    epi = spark.createDataFrame([(1, y, 0, 2) for y in range(3)], "slide long, y int, x0 int, x1 int")  # polygon area 4
    stroma = spark.createDataFrame([(1, 0, 5, 5), (1, 0, 6, 6)], "slide long, y int, x0 int, x1 int")
    par = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} int")
    got = sc.spatial_scores(slides, epi, stroma, epi, par("area", 4, 5), par("dist", 3)).collect()
    assert {(r.area, r.stroma_area) for r in got} == {(4, 1), (5, 0)}


def test_split_of_ten(spark):
    items = spark.createDataFrame([("a", i) for i in range(10)], "class string, item long")
    got = tr.class_counts(tr.split_dataset(items)).first()
    assert (got.n_train, got.n_val, got.n_test) == (7, 2, 1)
    again = tr.split_dataset(items.repartition(3)).collect()
    assert sorted(again) == sorted(tr.split_dataset(items).collect())


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(5)
    chain = [(int(a), int(a) + 1) for a in rng.permutation(60)] + [(100, b) for b in range(101, 160)] + [(200, 200)]
    df = spark.createDataFrame(chain, "a long, b long")
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert {r.node: r.comp for r in connected_components(df).collect()} == want
    assert {r.node: r.comp for r in connected_components(df, near=[df.a % 7]).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def test_spans_and_pixels_agree(spark):
    p = pixels(spark, ["##.#", "....", "####"])
    spans = ma.to_spans(p.union(p), ["slide"])
    assert ma.area(spans, ["slide"]).first().area == 7
    assert sorted(ma.to_pixels(spans).select("slide", "x", "y").collect()) == sorted(p.collect())
    assert ma.area(ma.mask_or(spans, spans, ["slide"]), ["slide"]).first().area == 7


def test_raw_rasters(spark, tmp_path):
    raw = np.arange(2 * 3 * 3, dtype=np.uint8)
    (tmp_path / "patch_position_12.tif").write_bytes(b"h" * 16 + raw.tobytes())
    (tmp_path / "patch_position_13.tif").write_bytes(b"")
    (tmp_path / "overview.tif").write_bytes(b"x")
    files = rasters.patch_files(spark, str(tmp_path))
    assert rasters.skipped_files(spark, str(tmp_path)).count() == 2
    got = rasters.read_patch_rasters(files, (2, 3, 3)).orderBy("y", "x").collect()
    assert [(r.position, r.r, r.g, r.b) for r in got] == [(12, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(6)]


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(7500, 79, 1, 0.5), (7500, 198, 1, None)], "area int, dist int, slide long, til_score double")
    sinks.write_scores(s, f"{tmp_path}/s", ["area", "dist"])
    assert (tmp_path / "s/area=7500/dist=79").exists()
    assert spark.read.option("header", True).csv(f"{tmp_path}/s").count() == 2
    rows = spark.createDataFrame([(1, 0), (2, 0)], "slide long, position int")
    sinks.write_table(rows, f"{tmp_path}/m")
    sinks.write_table(rows.filter("slide = 2").withColumn("position", rows.position + 5), f"{tmp_path}/m", replace=True)
    assert sorted((r.slide, r.position) for r in spark.read.parquet(f"{tmp_path}/m").collect()) == [(1, 0), (2, 5)]


def test_folders_of_slides_and_kinds(spark, tmp_path):
    for slide in ("S1", "S2"):
        (tmp_path / slide / "binary_masks").mkdir(parents=True)
        (tmp_path / slide / "binary_masks" / "position_4.tif").write_bytes(b"x")
        (tmp_path / f"{slide}.svs").write_bytes(b"x")
    (tmp_path / "S1" / "patches").mkdir()
    (tmp_path / "S1" / "patches" / "position_5.tif").write_bytes(b"x")
    (tmp_path / "S1.xml").write_text("<Annotations/>")
    of = lambda kind: sorted((r.slide, r.position) for r in rasters.patch_files_of_kind(spark, str(tmp_path), kind).collect())
    assert of("stroma_mask") == of("binary") == [("S1", 4), ("S2", 4)] and of("he") == [("S1", 5)]
    with pytest.raises(ValueError):
        rasters.patch_files_of_kind(spark, str(tmp_path), "other")
    assert sorted(r.path.rsplit("/", 1)[1] for r in annotation_xml.list_files(spark, str(tmp_path)).collect()) == ["S1.svs", "S1.xml", "S2.svs"]


def test_score_files(spark):
    s = spark.createDataFrame([("b", 1, 0.5), ("a", 1, None), ("b", 2, 0.1)], "slide string, dist int, til_score double")
    got = {(r["index"], r.Directory, r.dist) for r in sinks.keyed_scores(s, "Directory", ".tif", ["dist"]).collect()}
    assert got == {(0, "a.tif", 1), (1, "b.tif", 1), (0, "b.tif", 2)}
    assert [tuple(r) for r in sinks.keyed_scores(s.filter("dist = 2").drop("dist"), "WSI").collect()] == [(0, "b", 0.1)]


def test_padding_darkens_and_places_off_the_canvas_are_named(spark):
    man = spark.createDataFrame([(1, 1, 0, 0, 2, 1, True), (1, 2, 1, 0, 1, 1, True)], "slide long, position int, x0 int, y0 int, w int, h int, colored boolean")
    px = spark.createDataFrame([(1, 1, 0, 0, 100), (1, 1, 1, 0, 100), (1, 2, 0, 0, 50)], "slide long, position int, px int, py int, v int")
    cells = lambda pad: {(r.x, r.y): r.v for r in mo.stitch_patches(px, man, man, pad).collect()}
    assert cells(False) == {(0, 0): 100, (1, 0): 75} and cells(True) == {(0, 0): 100, (1, 0): 75, (2, 0): 0}
    extent = mo.canvas_extent(man).withColumn("width", F.lit(1))
    assert [r.position for r in mo.out_of_canvas(man, man, extent).collect()] == [1, 2]
    assert mo.out_of_canvas(man, man, mo.canvas_extent(man)).count() == 0


def test_white_share_of_sparse_pixels(spark):
    """Missing pixels count as not white, wherever they are."""
    white = [(1, x, 0, 250, 250, 250) for x in (0, 1, 2)] + [(1, 5, 1, 250, 250, 250), (1, 6, 1, 0, 0, 0)]
    px = spark.createDataFrame(white, "slide int, x int, y int, r int, g int, b int")
    patches = spark.createDataFrame([(1, 0, 0, 4, 1), (1, 4, 0, 8, 2), (2, 0, 0, 4, 4)], "slide int, x0 int, y0 int, x1 int, y1 int")
    got = {(r.slide, r.x0): r.white for r in gr.patch_white(patches, px).collect()}
    assert got == {(1, 0): 0.75, (1, 4): 0.125, (2, 0): 0.0}


def test_one_slide_is_many_tasks(spark, monkeypatch):
    """A slide's edges are dealt by bands, and components that cross them are still one."""
    monkeypatch.setattr(rg, "BAND", 4)
    rows = [(1, y, 0, 0) for y in range(40)] + [(1, y, 9, 9) for y in range(0, 40, 2)]
    lab = rg.label_spans(spark.createDataFrame(rows, "slide int, y int, x0 int, x1 int"), ["slide"])
    comps = {}
    for r in lab.collect():
        comps.setdefault((r.comp.y, r.comp.x0), []).append(r.y)
    assert sorted(len(v) for v in comps.values()) == [1] * 20 + [40]
