"""The three workflows end to end on the smallest tables, and properties that hold for any input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from slidejobs.fixtures import fixture
from slidejobs.functions.stages import Stages
from slidejobs.jobs import workflows as wf
from slidejobs.operators import annotations as an
from slidejobs.operators import nuclei as nu

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def fx(spark):
    return lambda name: fixture(spark, str(SF), name)


def test_global_scores(spark, fx):
    tiles, px = fx("fx_tiles"), fx("fx_pixels")
    stroma = px.join(tiles.filter("cls = 2"), (px.slide == tiles.slide) & (F.floor(px.x / 8) == tiles.tx) & (F.floor(px.y / 8) == tiles.ty), "left_semi")
    slides = fx("fx_slides")
    got = {r.slide: r for r in wf.global_scores(slides, tiles, fx("fx_outlines"), stroma, tile=8).collect()}
    assert len(got) == slides.count()
    for r in got.values():
        assert r.til_area_filled >= r.til_area and (r.area_diff_percent or 0) >= 0
        assert r.til_score is None or r.til_score == pytest.approx(r.til_area / r.stroma_area)
    assert any(r.til_count for r in got.values())
    done = slides.filter("slide < 4").select("slide")
    assert wf.global_scores(slides, tiles, fx("fx_outlines"), stroma, tile=8, done=done).count() == slides.count() - done.count()


def test_sweep_grows_with_distance_and_shrinks_with_area(spark, fx):
    til = nu.til_mask(an.polygon_fill(fx("fx_outlines"), ["slide", "contour"]), ["slide"])
    par = lambda c, v: spark.createDataFrame([(x,) for x in v], f"{c} int")
    got = {(r.slide, r.area, r.dist): r.stroma_area for r in wf.spatial_sweep(fx("fx_slides"), fx("fx_tiles"), til, par("area", [40, 100]), par("dist", [3, 7]), tile=8).collect()}
    for (slide, area, dist), n in got.items():
        assert n <= got[slide, area, 7] and n <= got[slide, 40, dist]


def test_training_set(spark, fx):
    v = fx("fx_vertices").withColumn("layer_id", (F.col("region") % 3).cast("int"))
    layers = spark.createDataFrame([(0, "stroma"), (1, "epithelium"), (2, "skip")], "layer_id int, class string")
    sizes = spark.createDataFrame([(4,), (6,)], "size int")
    got = wf.training_set(v, layers, fx("fx_slides"), fx("fx_pixels"), sizes).collect()
    assert got and {r["class"] for r in got} == {"stroma", "epithelium"}
    assert {(r["class"], r.idx) for r in got} == {("epithelium", 0), ("stroma", 1)}
    assert {r.split for r in got} == {"train", "val", "test"}
    assert all(r.overlap >= 0.7 and r.white < 0.7 for r in got)


def test_patches_of(spark, fx):
    got = wf.patches_of(fx("fx_vertices"), fx("fx_slides"), fx("fx_pixels"), (16, 12), 0.2, 0.7).collect()
    assert got and all(r.overlap > 0.2 for r in got)
    for slide in {r.slide for r in got}:
        assert sorted(r.position for r in got if r.slide == slide) == list(range(sum(r.slide == slide for r in got)))


def test_finished_slides_are_not_made_again(spark, fx, tmp_path, monkeypatch):
    stages = Stages(spark, f"file://{tmp_path}/kept", waves=2)
    slides, args = fx("fx_slides"), (fx("fx_pixels"), (16, 12), 0.2, 0.7)
    whole = wf.patches_of(fx("fx_vertices"), slides, *args)
    first = wf.patches_of(fx("fx_vertices"), slides.filter("slide < 4"), *args, stages=stages)
    assert first.select("slide").distinct().count() <= 4 and stages.pending("patches", slides).count() == slides.count() - stages.finished("patches", slides).count()
    asked = []
    monkeypatch.setattr(wf.an, "bounding_boxes", lambda v, keys, f=wf.an.bounding_boxes: asked.append({r.slide for r in v.select("slide").distinct().collect()}) or f(v, keys))
    both = wf.patches_of(fx("fx_vertices"), slides, *args, stages=stages)
    assert not set().union(*asked) & {r.slide for r in slides.filter("slide < 4").collect()}
    rows = lambda df: sorted(map(str, df.select(*whole.columns).collect()))
    assert rows(both) == rows(whole)
    asked.clear()
    assert rows(wf.patches_of(fx("fx_vertices"), slides, *args, stages=stages)) == rows(whole)
    assert not asked
