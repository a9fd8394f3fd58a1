"""The registered queries: every operator over slide tables derived from the given ones, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidejobs.fixtures import fixture, with_views
from slidejobs.functions.storage import new_path, stored
from slidejobs.jobs import workflows as wf
from slidejobs.operators import annotations as an
from slidejobs.operators import blocks as bl
from slidejobs.operators import distance as di
from slidejobs.operators import grid as gr
from slidejobs.operators import masks as ma
from slidejobs.operators import mosaic as mo
from slidejobs.operators import nuclei as nu
from slidejobs.operators import regions as rg
from slidejobs.operators import scores as sc
from slidejobs.operators import tiles as ti
from slidejobs.operators import training as tr
from slidejobs.sources import annotation_xml as xm
from slidejobs.sources import rasters as ra
from slidejobs.sources import sinks as sk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Columns of the SQL that DuckDB would give another width, and their types.
TYPES = {
    "read_annotations_imagescope": "region integer",
    "read_annotations_asap": "region integer, x integer, y integer",
    "bounding_boxes": "x bigint, w bigint",
    "group_boxes": "x bigint, w bigint",
    "patch_grid": "gy integer, y0 integer, y1 integer",
    "polygon_fill": "y integer, x0 integer, x1 integer",
    "annotation_overlap": "gy integer, y0 integer, y1 integer",
    "white_fraction": "px bigint, py bigint, n_white bigint",
    "select_patches": "gy integer, y0 integer, y1 integer, position integer",
    "flag_patches": "gy integer, y0 integer",
    "training_patches": "y0 integer, y1 integer, number integer",
    "classify_pixels": "cls integer",
    "block_histograms": "v integer",
    "mask_and": "y integer, x0 integer, x1 integer",
    "mask_or": "y integer, x0 integer, x1 integer",
    "size_limits": "max_roundness double",
    "til_mask": "y integer, x0 integer, x1 integer",
    "label_pixels": "x integer, y integer, label integer",
    "erode_overlaps": "x integer, y integer, label integer",
    "read_patch_rasters": "position integer, r integer, g integer, b integer",
    "read_patch_blocks": "position integer, r integer, g integer, b integer",
    "write_scores": "index integer",
    "order_patches": "position integer, k integer",
    "align_patches": "position integer, k integer",
    "align_patches_by_rank": "position integer, k integer",
    "place_patches": "k integer, v integer",
    "external_components": "comp_y integer, comp_x integer",
    "component_area": "comp_y integer, comp_x integer",
    "component_filled_area": "comp_y integer, comp_x integer",
    "component_centroids": "comp_y integer, comp_x integer",
    "global_score": "til_area_filled bigint",
    "distance_to_clusters": "x integer, y integer, d2 bigint",
    "distance_mask": "y integer, x0 integer, x1 integer",
    "spatial_stroma": "y integer, x0 integer, x1 integer",
    "centroid_in_stroma": "comp_y integer, comp_x integer",
    "spatial_score": "til_area bigint",
    "spatial_sweep": "til_area bigint",
    "class_index": "idx integer",
    "read_annotations": "region integer",
    "out_of_canvas": "position integer",
    "stitched_global_score": "til_area_filled bigint",
    "global_score_from_pixels": "til_area_filled bigint",
    "spatial_sweep_from_pixels": "til_area bigint",
}
#: Scaled to slides of 64 x 64 pixels.
PATCH, OVERLAP, PADDING, TILE = (24, 16), 4, 2, 8
AREAS, DISTS = [40, 100], [3, 7]


def query(sql: str | None = None):
    """Registers a function of fixture(name) under its own name."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: fixture(spark, sf_dir, name))
        if sql:
            casts = ", ".join(f"cast({c.split()[0]} as {c.split()[1]}) as {c.split()[0]}" for c in TYPES.get(f.__name__, "").split(", ") if c)
            SQL[f.__name__] = f"select * replace ({casts}) from ({with_views(sql)})" if casts else with_views(sql)
        return f

    return add


def _runs(source: str, keys: str) -> str:
    """Pixels (keys, x, y) of a table as spans, in SQL."""
    return f"(select {keys}, y, min(x) as x0, max(x) as x1 from (select {keys}, x, y, x - row_number() over (partition by {keys}, y order by x) as run from {source}) group by {keys}, y, run)"


# ---- sources ----

_PATHS = """select concat('/data/', slide % 7, '/S', slide, '.svs') as path from fx_slides
  union all select concat('/data/', slide % 7, case when slide % 11 = 0 then '/s' else '/S' end, slide, '.xml') from fx_slides where slide % 5 <> 0"""


@query(f"""with p as ({_PATHS}), c as (select path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)\\.[^./]*$', 1) as stem, right(path, 3) as ext from p)
  select s.dir, s.stem, s.path as slide_path, x.path as annotation_path, x.path is not null as matched
  from c s left join (select * from c where ext = 'xml') x on x.dir = s.dir and x.stem = s.stem where s.ext = 'svs'""")
def slide_inventory(fx):
    return an.slide_inventory(fx("fx_slides").sparkSession.sql(_PATHS.replace("fx_slides", "{s}"), s=fx("fx_slides")))


#: Every third slide has one layer only.
_LAYER = "case when slide % 3 = 0 then 1 else region % 2 + 1 end"


def _xml(fx, layered: bool, asap: bool = False) -> DataFrame:
    """One file per slide from fx_vertices; regions divisible by 3 have a vertex that can't be read (the first flavour only)."""
    point = F.concat(F.lit('<Coordinate X="' if asap else '<Vertex X="'), "x", F.lit('" Y="'), "y", F.lit('"/>'))
    regions = fx("fx_vertices").groupBy("slide", "region").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", point.alias("p")))), lambda v: v.p), "").alias("v"))
    if not asap:
        regions = regions.withColumn("v", F.concat("v", F.when(F.col("region") % 3 == 0, '<Vertex X="none" Y="1"/>').otherwise("")))
    open_, close = ("<Annotation><Coordinates>", "</Coordinates></Annotation>") if asap else ("<Region><Vertices>", "</Vertices></Region>")
    one = regions.withColumn("layer", F.expr(_LAYER) if layered else F.lit(1)).withColumn("v", F.concat(F.lit(open_), "v", F.lit(close)))
    each = one.groupBy("slide", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("region", "v"))), lambda v: v.v), "").alias("v"))
    if asap:
        return each.select(F.col("slide").cast("string").alias("path"), F.concat(F.lit("<ASAP_Annotations><Annotations>"), "v", F.lit("</Annotations></ASAP_Annotations>")).alias("content"))
    note = F.concat(F.lit('<Annotation Id="'), "layer", F.lit('"><Regions>'), "v", F.lit("</Regions></Annotation>"))
    files = each.withColumn("v", note).groupBy("slide").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "v"))), lambda v: v.v), "").alias("v"))
    return files.select(F.col("slide").cast("string").alias("path"), F.concat(F.lit("<Annotations>"), "v", F.lit("</Annotations>")).alias("content"))


_NUMBERED = f"""n as (select slide, region, layer, row_number() over (partition by slide order by layer, region) - 1 as num from
  (select slide, region, cast({_LAYER} as int) as layer from fx_regions))"""


@query(f"with {_NUMBERED} select cast(slide as varchar) as path, layer as layer_id, num as region, seq, x, y from n join fx_vertices v using (slide, region)")
def read_annotations_imagescope(fx):
    return xm.read_imagescope(_xml(fx, True))


@query("""select cast(v.slide as varchar) as path, num as region, seq, trunc(x / 2.0) as x, trunc(y / 2.0) as y from fx_vertices v
  join (select slide, region, row_number() over (partition by slide order by region) - 1 as num from fx_regions) n using (slide, region)""")
def read_annotations_asap(fx):
    return xm.read_asap(_xml(fx, False, asap=True), level=1)


@query(f"select cast(slide as varchar) as path, 'tumour' as class, count(*) as n from fx_vertices where {_LAYER} = 1 group by 1")
def read_annotation_layer(fx):
    v = xm.read_imagescope(_xml(fx, True))
    layers = v.sparkSession.createDataFrame([(1, "tumour"), (2, "skip"), (3, "stroma")], "layer_id int, class string")
    return xm.annotation_layers(v, layers).groupBy("path", "class").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with l as (select * from (values (1, 'tumour'), (2, 'other')) t(layer_id, class)), f as (select distinct slide from fx_regions)
  select cast(slide as varchar) as path, layer_id, class from f, l where not exists (select 1 from fx_regions r where r.slide = f.slide and case when r.slide % 3 = 0 then 1 else r.region % 2 + 1 end = l.layer_id)""")
def missing_annotation_layers(fx):
    files = _xml(fx, True)
    layers = files.sparkSession.createDataFrame([(1, "tumour"), (2, "other"), (3, "skip")], "layer_id int, class string")
    return xm.missing_layers(files, xm.read_imagescope(files), layers)


def _mixed(fx) -> DataFrame:
    """Slides divisible by 5 are of the second flavour; files of slides divisible by 7 are cut short, and empty ones, web pages and documents with another root come beside them."""
    one, two = _xml(fx, True).filter("path % 5 <> 0"), _xml(fx, False, asap=True).filter("path % 5 = 0")
    both = one.unionByName(two)
    cut = F.when(F.expr("path % 7 = 0"), F.expr("substr(content, 1, length(content) - 20)")).otherwise(F.concat(F.lit('<?xml version="1.0"?><!-- <no root> -->'), "content"))
    return both.withColumn("content", cut).unionByName(both.filter("path % 7 = 1").select(F.concat(F.lit("empty-"), "path").alias("path"), F.lit(" ").alias("content"))).unionByName(
        both.filter("path % 7 = 2").select(F.concat(F.lit("page-"), "path").alias("path"), F.lit("<html><body>Region</body></html>").alias("content"))
    ).unionByName(two.filter("path % 7 = 3").select(F.concat(F.lit("other-"), "path").alias("path"), F.regexp_replace(F.regexp_replace("content", "ASAP_Annotations", "Other"), "Annotations?>", "Deep>").alias("content")))


@query(f"""with {_NUMBERED} select cast(slide as varchar) as path, 'imagescope' as flavour, layer as layer_id, num as region, seq, x, y from n join fx_vertices v using (slide, region) where slide % 5 <> 0 and slide % 7 <> 0
  union all select cast(v.slide as varchar), 'asap', null, num, seq, x, y from fx_vertices v
  join (select slide, region, row_number() over (partition by slide order by region) - 1 as num from fx_regions) m using (slide, region) where v.slide % 5 = 0 and v.slide % 7 <> 0
  union all select concat('other-', v.slide), 'asap', null, num, seq, x, y from fx_vertices v
  join (select slide, region, row_number() over (partition by slide order by region) - 1 as num from fx_regions) m using (slide, region) where v.slide % 5 = 0 and v.slide % 7 = 3""")
def read_annotations(fx):
    return xm.read_annotations(_mixed(fx))


@query("""with f as (select distinct slide from fx_regions) select cast(slide as varchar) as path, 'malformed' as reason from f where slide % 7 = 0
  union all select concat('empty-', slide), 'empty' from f where slide % 7 = 1
  union all select concat('page-', slide), 'no annotations' from f where slide % 7 = 2""")
def rejected_annotations(fx):
    return xm.rejected_annotations(_mixed(fx))


def _raw_files(fx) -> DataFrame:
    """name, content: a raw raster of each slide below its folder; those divisible by 5 are empty, and those divisible by 7 come a second time with no position in their name."""
    sizes = fx("fx_slides").select("slide", "width", "height")
    image = bl.to_blocks(fx("fx_pixels"), sizes, ["slide"], 64).withColumn("content", F.concat(F.unhex(F.lit("2a" * ra.HEADER)), "rgb"))
    folder = F.concat(F.lit("S"), "slide", F.lit(f"/{ra.KINDS['he']}/"))
    named = image.select(F.concat(folder, F.lit("patch_position_"), "slide", F.lit(".tif")).alias("name"), F.when(F.col("slide") % 5 == 0, F.unhex(F.lit(""))).otherwise(F.col("content")).alias("content"))
    return named.unionByName(image.filter("slide % 7 = 0").select(F.concat(folder, F.lit("cover.tif")).alias("name"), "content"))


@query("select slide as position, x, y, r, g, b, concat('S', slide) as slide_folder from fx_pixels where slide % 5 <> 0")
def read_patch_rasters(fx):
    spark = fx("fx_slides").sparkSession
    sk.write_files(_raw_files(fx), root := new_path(spark, "rasters"))
    files = ra.patch_files_of_kind(spark, root, "he")
    return ra.read_patch_rasters(files, (64, 64, 3)).join(files.select("position", F.col("slide").alias("slide_folder")), "position")


@query("select concat('S', slide) as slide, slide as position, x, y, r, g, b from fx_pixels where slide % 5 <> 0")
def read_patch_blocks(fx):
    spark = fx("fx_slides").sparkSession
    sk.write_files(_raw_files(fx), root := new_path(spark, "rasters"))
    return bl.block_pixels(ra.read_patch_blocks(ra.patch_files_of_kind(spark, root, "he"), ["slide", "position"], (64, 64, 3), size=24), ["slide", "position"])


_SUMS = "select slide, cls + 2 as area, ty % 2 as dist, count(*) as n, avg(tx) as mean_tx from fx_tiles group by 1, 2, 3"


@query(f"with s as ({_SUMS}) select area, dist, row_number() over (partition by area, dist order by slide) - 1 as index, concat(slide, '.tif') as Directory, n, round(mean_tx, 6) as mean_tx from s")
def write_scores(fx):
    sums = fx("fx_tiles").groupBy("slide", (F.col("cls") + 2).alias("area"), (F.col("ty") % 2).alias("dist")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("tx"), 6).alias("mean_tx"))
    spark = sums.sparkSession
    keyed = sk.keyed_scores(sums, "Directory", ".tif", ["area", "dist"])
    sk.write_scores(keyed, path := new_path(spark, "scores"), ["area", "dist"])
    schema = ", ".join(f"`{c}` {dict(keyed.dtypes)[c]}" for c in ("index", "Directory", "n", "mean_tx", "area", "dist"))
    return spark.read.schema(schema).option("header", True).csv(path)


@query("select slide, region, case when slide % 3 = 0 then x0 + 1000 else x0 end as x0, y0, w, h from fx_regions where slide % 3 <> 0 or region % 2 = 0")
def write_table(fx):
    """Written for all slides; a rerun of every third replaces those and no others."""
    rows = fx("fx_regions")
    path = new_path(rows.sparkSession, "manifest")
    sk.write_table(rows, path)
    sk.write_table(rows.filter("slide % 3 = 0 and region % 2 = 0").withColumn("x0", (F.col("x0") + 1000).cast("int")), path, replace=True)
    return sk.read_table(rows.sparkSession, path, rows.schema)


@query("select slide, tx, ty from fx_tiles where not (tx % 3 = 0 and ty % 2 = 0)")
def pending_work(fx):
    t = fx("fx_tiles").select("slide", "tx", "ty")
    return an.pending_work(t, t.filter("tx % 3 = 0 and ty % 2 = 0"), ["slide", "tx", "ty"])


# ---- annotation geometry and grids ----

_BOX = "select slide, region, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from fx_vertices group by 1, 2"
_PAIRS = f"""box as ({_BOX}), pairs as (select p.slide, p.region as a, q.region as b from box p join box q on p.slide = q.slide and p.region < q.region
  and p.x + p.w >= q.x and p.x <= q.x + q.w and p.y + p.h >= q.y and p.y <= q.y + q.h)"""
_GROUPS = f"""{_PAIRS}, reach(slide, a, b) as (select slide, region, region from box union
  select r.slide, r.a, e.b from reach r join (select slide, a, b from pairs union all select slide, b, a from pairs) e on e.slide = r.slide and e.a = r.b),
  grp as (select slide, a as region, min(b) as group_id from reach group by 1, 2)"""
_GBOX = f"""{_GROUPS}, gbox as (select slide, group_id, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from fx_vertices join grp using (slide, region) group by 1, 2)"""
_GRID = f"""{_GBOX}, grid as (select slide, group_id, gy, gx, greatest(gx - {PADDING}, 0) as x0, greatest(gy - {PADDING}, 0) as y0,
  least(greatest(gx - {PADDING}, 0) + {PATCH[0]}, 64) as x1, least(greatest(gy - {PADDING}, 0) + {PATCH[1]}, 64) as y1
  from gbox, unnest(range(y, y + h, {PATCH[1] - OVERLAP})) a(gy), unnest(range(x, x + w, {PATCH[0] - OVERLAP})) b(gx))"""
#: Pixel by pixel: inside by the parity of crossings to the left, or on an edge.
_EDGE = """edge as (select {k}, x as ax, y as ay, coalesce(lead(x) over w, first_value(x) over w) as bx, coalesce(lead(y) over w, first_value(y) over w) as by from {t} window w as (partition by {k} order by seq))"""
_FILL = """{edge}, bx as (select {k}, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from {t} group by {k}),
  px as (select {k}, cast(px.v as int) as x, cast(py.v as int) as y from bx, unnest(range(lx, hx + 1)) px(v), unnest(range(ly, hy + 1)) py(v)),
  fill as (select {k}, px.x, px.y from px join edge e using ({k}) group by {k}, px.x, px.y
    having sum(case when (e.ay <= px.y) <> (e.by <= px.y) and (e.ax - px.x) * abs(e.by - e.ay) + (px.y - e.ay) * (e.bx - e.ax) * sign(e.by - e.ay) < 0 then 1 else 0 end) % 2 = 1
      or bool_or((e.bx - e.ax) * (px.y - e.ay) = (e.by - e.ay) * (px.x - e.ax) and px.x between least(e.ax, e.bx) and greatest(e.ax, e.bx) and px.y between least(e.ay, e.by) and greatest(e.ay, e.by)))"""


def _fill(table: str, keys: str) -> str:
    return _FILL.format(edge=_EDGE.format(k=keys, t=table), k=keys, t=table)


_GRAY = "(299 * b + 587 * g + 114 * r + 500) // 1000"
_OVERLAP = f"""{_GRID}, {_fill("fx_vertices", "slide, region")}, gfill as (select distinct slide, group_id, x, y from fill join grp using (slide, region)),
  ov as (select g.slide, g.group_id, gy, gx, x0, y0, x1, y1, count(f.x) / {PATCH[0] * PATCH[1]}.0 as overlap from grid g left join gfill f
    on f.slide = g.slide and f.group_id = g.group_id and f.x >= x0 and f.x < x1 and f.y >= y0 and f.y < y1 group by all)"""
_WHITE = f"""{_OVERLAP}, wh as (select o.*, (select avg(case when {_GRAY} > 230 then 1.0 else 0.0 end) from fx_pixels p
    where p.slide = o.slide and p.x >= x0 and p.x < x1 and p.y >= y0 and p.y < y1) as white from ov o)"""


def _boxes(fx):
    return an.bounding_boxes(fx("fx_vertices"), ["slide", "region"])


def _groups(fx):
    return an.overlap_groups(_boxes(fx), cell=16)


def _grid(fx, groups=None):
    groups = _groups(fx) if groups is None else groups
    return gr.patch_grid(an.group_boxes(fx("fx_vertices"), groups), fx("fx_slides"), PATCH, OVERLAP, PADDING)


def _overlap(fx):
    groups = _groups(fx)
    spans = an.polygon_fill(fx("fx_vertices"), ["slide", "region"]).join(groups, ["slide", "region"])
    return gr.annotation_overlap(_grid(fx, groups), an.merge_spans(spans, ["slide", "group_id"]), ["slide", "group_id"], PATCH)


def _white(fx):
    return gr.patch_white(_overlap(fx), fx("fx_pixels"))


@query("select slide, region, seq, cast(trunc(x / 4.0) as int) as x, cast(trunc(y / 4.0) as int) as y from fx_vertices")
def scale_vertices(fx):
    return an.scale_vertices(fx("fx_vertices"), 2)


@query(_BOX)
def bounding_boxes(fx):
    return _boxes(fx)


@query(f"with {_PAIRS} select * from pairs")
def overlap_pairs(fx):
    return an.overlap_pairs(_boxes(fx), cell=16)


@query(f"with recursive {_GROUPS} select * from grp")
def overlap_groups(fx):
    return _groups(fx)


@query(f"with recursive {_GBOX} select * from gbox")
def group_boxes(fx):
    return an.group_boxes(fx("fx_vertices"), _groups(fx))


@query(f"with recursive {_GRID} select * from grid")
def patch_grid(fx):
    return _grid(fx)


@query(f"with {_fill('fx_vertices', 'slide, region')} select slide, region, y, min(x) as x0, max(x) as x1 from fill group by 1, 2, 3")
def polygon_fill(fx):
    return an.polygon_fill(fx("fx_vertices"), ["slide", "region"])


_CONCAT = f"{_GROUPS}, cat as (select slide, group_id, region * 10 + seq as seq, x, y from fx_vertices join grp using (slide, region)), {_fill('cat', 'slide, group_id')}"


@query(f"with recursive {_CONCAT} select * from {_runs('fill', 'slide, group_id')}")
def concat_fill(fx):
    return an.polygon_fill(an.concat_vertices(fx("fx_vertices"), _groups(fx)), ["slide", "group_id"])


@query(f"with recursive {_OVERLAP} select * replace (round(overlap, 6) as overlap) from ov")
def annotation_overlap(fx):
    return _overlap(fx).withColumn("overlap", F.round("overlap", 6))


@query(f"select slide, x // 16 as px, y // 16 as py, sum(case when {_GRAY} > 230 then 1 else 0 end) as n_white, count(*) as n_pixels, round(avg(case when {_GRAY} > 230 then 1.0 else 0.0 end), 6) as white from fx_pixels group by 1, 2, 3")
def white_fraction(fx):
    p = fx("fx_pixels").withColumn("px", F.floor(F.col("x") / 16)).withColumn("py", F.floor(F.col("y") / 16))
    return gr.white_fraction(p, ["slide", "px", "py"]).withColumn("white", F.round("white", 6))


@query(f"""with recursive {_WHITE} select * replace (round(overlap, 6) as overlap, round(white, 6) as white), row_number() over (partition by slide order by group_id, gy, gx) - 1 as position
  from wh where overlap > 0.3 and white < 0.35""")
def select_patches(fx):
    return gr.select_patches(_white(fx), 0.3, 0.35).withColumns({c: F.round(c, 6) for c in ("overlap", "white")})


_SAVED = "select slide, 0 as group_id, 0 as gy, 0 as gx, 0 as x0, 0 as y0, true as colored from fx_slides where slide % 4 = 0"


@query(f"with recursive {_WHITE} select slide, group_id, gy, gx, x0, y0, white < 0.35 as colored from wh where slide % 4 <> 0 union all {_SAVED}")
def flag_patches(fx):
    saved = fx("fx_slides").filter("slide % 4 = 0").select("slide", *[F.lit(0).alias(c) for c in ("group_id", "gy", "gx", "x0", "y0")], F.lit(True).alias("colored"))
    return gr.flag_patches(_white(fx), saved, 0.35)


_TRAIN = f"""box as ({_BOX}), {_fill("fx_vertices", "slide, region")}, sz as (select * from (values (4), (9)) t(size)),
  cell as (select slide, region, size, cast(iy as int) as iy, cast(ix as int) as ix, x, y, w, h, x + ix * (size - ov) as px, y + iy * (size - ov) as py from
    (select *, size * 25 // 100 as ov from box, sz), unnest(range(greatest(1, (h - ov) // (size - ov)))) a(iy), unnest(range(greatest(1, (w - ov) // (size - ov)))) b(ix)),
  tq as (select c.slide, c.region, size, iy, ix, greatest(px - size // 10, 0) as x0, greatest(py - size // 10, 0) as y0,
      least(greatest(px - size // 10, 0) + size, 64) as x1, least(greatest(py - size // 10, 0) + size, 64) as y1, count(f.x) as n
    from cell c left join fill f on f.slide = c.slide and f.region = c.region and f.x >= px and f.x < least(px + size, c.x + w) and f.y >= py and f.y < least(py + size, c.y + h) group by all),
  tp as (select * exclude (n), n / (size * size) as overlap from tq)"""


def _training(fx):
    sizes = fx("fx_slides").sparkSession.createDataFrame([(4,), (9,)], "size int")
    return gr.training_patches(_boxes(fx), an.polygon_fill(fx("fx_vertices"), ["slide", "region"]), fx("fx_slides"), sizes, 10, 25)


@query(f"""with {_TRAIN}, wp as (select *, (select avg(case when {_GRAY} > 220 then 1.0 else 0.0 end) from fx_pixels p
    where p.slide = tp.slide and p.x >= x0 and p.x < x1 and p.y >= y0 and p.y < y1) as white, case when region % 2 = 0 then 'tumour' else 'stroma' end as class from tp where overlap >= 0.7)
  select slide, region, size, iy, ix, x0, y0, x1, y1, class, round(overlap, 6) as overlap, round(white, 6) as white, row_number() over (partition by slide, class, size order by region, iy, ix) - 1 as number
  from wp where white < 0.7""")
def training_patches(fx):
    patches = _training(fx).filter("overlap >= 0.7")
    patches = gr.patch_white(patches, fx("fx_pixels"), 220).withColumn("class", F.when(F.col("region") % 2 == 0, "tumour").otherwise("stroma"))
    return gr.number_training_patches(patches).withColumns({c: F.round(c, 6) for c in ("overlap", "white")})


# ---- tiles ----


def _cut(fx):
    return fx("fx_slides").select("slide", (F.col("slide") % 20 + 50).cast("int").alias("width"), (F.col("slide") % 7 + 58).cast("int").alias("height"))


_CUT = "cut as (select slide, cast(slide % 20 + 50 as int) as width, cast(slide % 7 + 58 as int) as height from fx_slides)"


@query(f"""with {_CUT} select slide, width, height, cast(tx as int) as tx, cast(ty as int) as ty, (tx + 1) * 8 <= width and (ty + 1) * 8 <= height as is_full,
  case when (tx + 1) * 8 <= width and (ty + 1) * 8 <= height then null else 0 end as cls from cut, unnest(range((width + 7) // 8)) a(tx), unnest(range((height + 7) // 8)) b(ty)""")
def tile_grid(fx):
    return ti.tile_grid(_cut(fx), TILE)


@query("select slide, x // 8 as tx, y // 8 as ty, sum(case when least(r, g, b) > 230 then 1 else 0 end) * 100 <= count(*) * 90 as good from fx_pixels group by 1, 2, 3")
def good_tile(fx):
    return ti.good_tiles(fx("fx_pixels"), ["slide"], TILE)


@query("""select slide, tx, ty, case when (tx + ty) % 5 = 0 then -1 when s[1] >= s[2] and s[1] >= s[3] then 0 when s[2] >= s[3] then 1 else 2 end as cls from fx_scores""")
def tile_predict(fx):
    return ti.tile_predict(fx("fx_scores").withColumn("good", (F.col("tx") + F.col("ty")) % 5 != 0)).select("slide", "tx", "ty", "cls")


#: Rasters whose sizes leave cut tiles, and blocks at their edges.
_PART = "part as (select slide, cast(slide % 20 + 44 as int) as width, cast(slide % 7 + 58 as int) as height from fx_slides), pp as (select p.* from fx_pixels p join part using (slide) where x < width and y < height)"


def _part(fx) -> tuple[DataFrame, DataFrame]:
    """Blocks and sizes."""
    part = fx("fx_slides").select("slide", (F.col("slide") % 20 + 44).cast("int").alias("width"), (F.col("slide") % 7 + 58).cast("int").alias("height"))
    return bl.to_blocks(fx("fx_pixels"), part, ["slide"], 3 * TILE), part


@query(f"with {_PART} select slide, x, y, cast(r as int) as r, cast(g as int) as g, cast(b as int) as b from pp")
def block_pixels(fx):
    return bl.block_pixels(_part(fx)[0], ["slide"])


def _brightest():
    """A scorer for three classes: the sum of each channel."""
    import numpy as np

    return lambda tiles: np.rint(tiles * 255).sum(axis=(1, 2))


@query(f"""with {_PART}, s as (select slide, x // 8 as tx, y // 8 as ty, sum(r) as r, sum(g) as g, sum(b) as b, sum(case when least(r, g, b) > 230 then 1 else 0 end) * 100 <= count(*) * 90 as good from pp group by 1, 2, 3)
  select part.slide, cast(tx.v as int) as tx, cast(ty.v as int) as ty, case when (tx.v + 1) * 8 > width or (ty.v + 1) * 8 > height then 0 when not good then -1 when r >= g and r >= b then 0 when g >= b then 1 else 2 end as cls
  from part, unnest(range((width + 7) // 8)) tx(v), unnest(range((height + 7) // 8)) ty(v) left join s on s.slide = part.slide and s.tx = tx.v and s.ty = ty.v""")
def classify_pixels(fx):
    blocks, part = _part(fx)
    return bl.classify_blocks(blocks, part, ["slide"], _brightest, TILE)


@query(f"""with {_PART} select slide, 'r' as c, r as v, count(*) as n from pp group by all union all select slide, 'g', g, count(*) from pp group by all union all select slide, 'b', b, count(*) from pp group by all""")
def block_histograms(fx):
    return bl.block_histograms(_part(fx)[0], ["slide"])


_VOTES = """v as (select t.slide, t.tx, t.ty, t.cls, n.cls as o from fx_tiles t join fx_tiles n on n.slide = t.slide and abs(n.tx - t.tx) <= 1 and abs(n.ty - t.ty) <= 1 and (n.tx, n.ty) <> (t.tx, t.ty)),
  c as (select slide, tx, ty, cls, o, count(*) as n, sum(count(*)) over (partition by slide, tx, ty) as of from v group by 1, 2, 3, 4, 5),
  j as (select slide, tx, ty, cls, max(of) as of, coalesce(max(n) filter (where o = cls), 0) as alike, arg_max(o, n * 10 + case o when 0 then 3 when 1 then 2 when 2 then 1 else 0 end) as win from c group by 1, 2, 3, 4)"""


@query(f"with {_VOTES} select slide, tx, ty, case when (of = 3 and alike = 0) or (of <> 3 and alike < 3) then win else cls end as cls from j")
def tile_smooth(fx):
    return ti.tile_smooth(fx("fx_tiles"), ["slide"])


#: Column by column, each with the new class of the one before; a class wins a tie before those that come later in 0, 1, 2, -1.
_FIRST_ROW = """with recursive dim as (select slide, max(tx) as mx, max(ty) as my from fx_tiles group by 1),
  cells as (select dim.slide, mx, my, x.v as x, y.v as y, coalesce(cls, 0) as cls from dim, unnest(range(mx + 1)) x(v), unnest(range(least(my, 1) + 1)) y(v) left join fx_tiles t on t.slide = dim.slide and t.tx = x.v and t.ty = y.v),
  near as (select a.slide, a.x, a.mx, a.cls as own, list_filter([max(case when b.y = 0 and b.x = a.x + 1 then b.cls end), max(case when b.y = 1 and b.x = a.x - 1 then b.cls end), max(case when b.y = 1 and b.x = a.x then b.cls end),
      max(case when b.y = 1 and b.x = a.x + 1 then b.cls end)], lambda c: c is not null) as others
    from cells a join cells b on b.slide = a.slide and b.x between a.x - 1 and a.x + 1 where a.y = 0 group by 1, 2, 3, 4),
  walk(slide, x, cls) as (select slide, cast(-1 as bigint), cast(null as int) from dim union all
    select slide, x, case when len(l) > 0 and case when len(l) = 3 then same = 0 else same < 3 end then best else own end from (
      select *, len(list_filter(l, lambda c: c = own)) as same, [0, 1, 2, -1][list_position(n, list_max(n))] as best from (
        select *, [len(list_filter(l, lambda c: c = 0)), len(list_filter(l, lambda c: c = 1)), len(list_filter(l, lambda c: c = 2)), len(list_filter(l, lambda c: c = -1))] as n from (
          select n.slide, n.x, n.own, case when w.cls is null then others else list_append(others, w.cls) end as l from walk w join near n on n.slide = w.slide and n.x = w.x + 1))))
  select t.slide, t.tx, t.ty, cast(case when t.ty = 0 then w.cls else t.cls end as int) as cls from fx_tiles t left join walk w on w.slide = t.slide and w.x = t.tx"""


@query(_FIRST_ROW)
def tile_smooth_first_row(fx):
    return ti.tile_smooth_first_row(fx("fx_tiles"), ["slide"])


_CLS = """cp as (select p.slide, p.x, p.y, r, g, b, coalesce(t.cls, -1) as cls from fx_pixels p left join fx_tiles t on t.slide = p.slide and t.tx = least(p.x // 8, 6) and t.ty = least(p.y // 8, 6) and p.x <= 56 and p.y <= 56)"""


def _class_pixels(fx):
    return ti.render_classes(fx("fx_pixels"), fx("fx_tiles"), ["slide"], 60, 60, TILE)


@query(f"with {_CLS} select slide, x, y, cls from cp")
def render_classes(fx):
    return _class_pixels(fx).select("slide", "x", "y", "cls")


@query(f"with {_CLS} select slide, x, y, case when least(r, g, b) > 230 then 3 else cls end as cls from cp")
def blank_white(fx):
    return ti.blank_white(_class_pixels(fx)).select("slide", "x", "y", "cls")


# ---- masks ----


@query(f"with {_CLS} select slide, x, y, case when least(r, g, b) > 230 then 1 when cls = 2 then 255 else 0 end as mask from cp")
def stroma_mask(fx):
    return ma.stroma_mask(ti.blank_white(_class_pixels(fx))).select("slide", "x", "y", "mask")


@query("""select p.slide, p.x, p.y, case when t.cls = 2 then r else 0 end as r, case when t.cls = 2 then g else 0 end as g, case when t.cls = 2 then b else 0 end as b
  from fx_pixels p left join fx_tiles t on t.slide = p.slide and t.tx = p.x // 8 and t.ty = p.y // 8 where p.slide % 9 <> 0""")
def stroma_pixels(fx):
    p = fx("fx_pixels")
    mask = ma.stroma_mask(ti.render_classes(p.select("slide", "x", "y"), fx("fx_tiles"), ["slide"], 64, 64, TILE))
    return ma.stroma_pixels(p, mask.filter("slide % 9 <> 0"), ["slide"])


@query("select slide, tx * 8 + x as x, ty * 8 + y as y from fx_tiles, (select range as x from range(8)), (select range as y from range(8)) where cls = 0")
def epithelium_mask(fx):
    spans = ma.tile_spans(ma.class_mask(fx("fx_tiles"), 0), ["slide"], TILE)
    return ma.to_pixels(spans).select("slide", F.col("x").cast("long"), F.col("y").cast("long"))


_NUC = _fill("fx_outlines", "slide, contour")
_TIL = f"{_NUC}, til as (select distinct slide, x, y from fill)"


def _outline_spans(fx):
    return an.polygon_fill(fx("fx_outlines"), ["slide", "contour"])


def _til(fx):
    return nu.til_mask(_outline_spans(fx), ["slide"])


def _tile_spans(fx, cls):
    return ma.tile_spans(ma.class_mask(fx("fx_tiles"), cls), ["slide"], TILE)


@query(f"with {_TIL}, ab as (select til.slide, x, y from til join fx_tiles t on t.slide = til.slide and t.tx = x // 8 and t.ty = y // 8 where cls = 2) select * from {_runs('ab', 'slide')}")
def mask_and(fx):
    return ma.mask_and(_til(fx), _tile_spans(fx, 2), ["slide"])


@query(f"""with {_TIL}, u as (select slide, x, y from til union select slide, tx * 8 + a, ty * 8 + b from fx_tiles, (select range as a from range(8)), (select range as b from range(8)) where cls = 2)
  select * from {_runs("u", "slide")}""")
def mask_or(fx):
    return ma.mask_or(_til(fx), _tile_spans(fx, 2), ["slide"])


# ---- nuclei ----


@query("""with q as (select slide, quantile_cont(r, [0.01, 0.998]) as qr, quantile_cont(g, [0.01, 0.998]) as qg, quantile_cont(b, [0.01, 0.998]) as qb from fx_pixels group by 1)
  select p.slide, p.x, p.y, round((r - qr[1]) / (qr[2] - qr[1]), 6) as r, round((g - qg[1]) / (qg[2] - qg[1]), 6) as g, round((b - qb[1]) / (qb[2] - qb[1]), 6) as b from fx_pixels p join q using (slide)""")
def percentile_normalize(fx):
    return nu.percentile_normalize(fx("fx_pixels"), ["slide"]).withColumns({c: F.round(c, 6) for c in "rgb"})


def _contours(fx):
    d = fx("fx_outlines").groupBy("slide", "contour").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    d = d.select("slide", "contour", F.transform("p", lambda v: v.x + F.lit(0.75)).alias("xs"), F.transform("p", lambda v: v.y + F.lit(0.25)).alias("ys"))
    return nu.contours_from_detections(d)


@query("select slide, contour, cast(x as int) as x, cast(y as int) as y, seq from fx_outlines")
def contours_from_detections(fx):
    return _contours(fx).select("slide", "contour", F.posexplode("pts").alias("seq", "p")).select("slide", "contour", "p.x", "p.y", "seq")


_SHAPE = """e as (select slide, contour, x as ax, y as ay, coalesce(lead(x) over w, first_value(x) over w) as bx, coalesce(lead(y) over w, first_value(y) over w) as b_y from fx_outlines window w as (partition by slide, contour order by seq)),
  s as (select slide, contour, abs(sum(ax * b_y - bx * ay)) / 2.0 as area, sum(sqrt((ax - bx) * (ax - bx) + (ay - b_y) * (ay - b_y))) as perimeter from e group by 1, 2),
  sh as (select *, case when area = 0 or perimeter = 0 then 0.0 else perimeter * perimeter / (4 * pi() * area) end as roundness from s)"""
_LIMITS = "lim as (select slide, 3.14 / (mpp_x * mpp_y) as min_area, 20.25 * 3.14 / (mpp_x * mpp_y) as max_area, case when mpp_x < 0.3 then 1.2 else 1.4 end as max_roundness from fx_slides where mpp_x > 0 and mpp_y > 0)"


@query(f"with {_SHAPE} select slide, contour, area from sh")
def contour_area(fx):
    return nu.contour_features(_contours(fx)).select("slide", "contour", "area")


@query(f"with {_SHAPE} select slide, contour, round(perimeter, 6) as perimeter from sh")
def contour_perimeter(fx):
    return nu.contour_features(_contours(fx)).select("slide", "contour", F.round("perimeter", 6).alias("perimeter"))


@query(f"with {_SHAPE} select slide, contour, round(roundness, 6) as roundness from sh")
def contour_roundness(fx):
    return nu.contour_features(_contours(fx)).select("slide", "contour", F.round("roundness", 6).alias("roundness"))


@query(f"with {_LIMITS} select slide, round(min_area, 6) as min_area, round(max_area, 6) as max_area, max_roundness from lim")
def size_limits(fx):
    return nu.size_limits(fx("fx_slides")).withColumns({c: F.round(c, 6) for c in ("min_area", "max_area")})


@query("select slide, width, height, mpp_x, mpp_y from fx_slides where mpp_x is null or mpp_y is null or mpp_x <= 0 or mpp_y <= 0")
def rejected_slides(fx):
    return nu.rejected_slides(fx("fx_slides"))


@query(f"with {_SHAPE}, {_LIMITS} select slide, contour, area from sh join lim using (slide) where area > min_area and area < max_area and roundness < max_roundness and area <> 0 and perimeter <> 0")
def shape_filter(fx):
    return nu.shape_filter(nu.contour_features(_contours(fx)), nu.size_limits(fx("fx_slides"))).select("slide", "contour", "area")


@query(f"""with {_NUC}, st as (select p.slide, x, y from fx_pixels p join fx_tiles t on t.slide = p.slide and t.tx = p.x // 8 and t.ty = p.y // 8 where t.cls = 2 and (299 * r + 587 * g + 114 * b + 500) // 1000 > 0)
  select f.slide, f.contour, count(st.x) as inside, count(*) as filled from fill f left join st on st.slide = f.slide and st.x = f.x and st.y = f.y group by 1, 2 having count(st.x) * 2 >= count(*)""")
def stroma_filter(fx):
    t = fx("fx_tiles").filter("cls = 2").select("slide", "tx", "ty")
    p = fx("fx_pixels").withColumn("tx", F.floor(F.col("x") / 8).cast("int")).withColumn("ty", F.floor(F.col("y") / 8).cast("int")).join(t, ["slide", "tx", "ty"], "left_semi")
    return nu.stroma_filter(_outline_spans(fx), p, ["slide", "contour"])


@query(f"with {_TIL} select * from {_runs('til', 'slide')}")
def til_mask(fx):
    return _til(fx)


_LABEL = f"{_NUC}, lab as (select slide, x, y, max(label) as label from fill join (select slide, contour, row_number() over (partition by slide order by contour) as label from (select distinct slide, contour from fx_outlines)) using (slide, contour) group by 1, 2, 3)"


@query(f"with {_LABEL} select * from lab")
def label_pixels(fx):
    return nu.label_pixels(_outline_spans(fx), ["slide"])


@query(f"with {_LABEL} select * from lab l where not exists (select 1 from lab n where n.slide = l.slide and abs(n.x - l.x) <= 1 and abs(n.y - l.y) <= 1 and n.label <> l.label)")
def erode_overlaps(fx):
    return nu.erode_overlaps(nu.label_pixels(_outline_spans(fx), ["slide"]), ["slide"])


# ---- stitching ----

_MAN = """man as (select slide, row_number() over (partition by slide order by region) * 3 as position, x0, y0, w, h, region % 3 <> 0 as colored from fx_regions),
  ordered as (select *, row_number() over (partition by slide order by position) as k from man),
  good as (select slide, position from man where colored and (slide + position) % 4 <> 0)"""


def _manifest(fx):
    n = F.row_number().over(W.partitionBy("slide").orderBy("region"))
    return fx("fx_regions").select("slide", (n * 3).alias("position"), "x0", "y0", "w", "h", (F.col("region") % 3 != 0).alias("colored"))


def _readable(fx):
    return _manifest(fx).filter("colored and (slide + position) % 4 <> 0").select("slide", "position")


@query(f"with {_MAN} select * from ordered")
def order_patches(fx):
    return mo.order_patches(_manifest(fx))


@query(f"with {_MAN} select slide, position, x0, y0, row_number() over (partition by slide order by position) as k from man join good using (slide, position)")
def align_patches(fx):
    return mo.align_patches(_manifest(fx), _readable(fx))


@query(f"""with {_MAN}, a as (select slide, x0, y0, row_number() over (partition by slide order by position) as k from man where colored),
  b as (select slide, position, row_number() over (partition by slide order by position) as k from good) select slide, position, x0, y0, k from b join a using (slide, k)""")
def align_patches_by_rank(fx):
    return mo.align_patches(_manifest(fx), _readable(fx), by="rank")


_EXT = "ext as (select slide, min(x0) as min_x, min(y0) as min_y, max(x0) - min(x0) + max(w) as width, max(y0) - min(y0) + max(h) as height from man where colored group by 1)"


@query(f"with {_MAN}, {_EXT} select * from ext")
def canvas_extent(fx):
    return mo.canvas_extent(_manifest(fx))


_PLACED = f"""{_MAN}, {_EXT}, al as (select slide, position, x0, y0, w, h, row_number() over (partition by slide order by position) as k from man join good using (slide, position)),
  placed as (select al.slide, x0 - min_x + cast(px.v as int) as x, y0 - min_y + cast(py.v as int) as y, k, (px.v * 7 + py.v * 13 + position * 29) % 256 as v from al join ext using (slide), unnest(range(w)) px(v), unnest(range(h)) py(v))"""


def _patch_pixels(fx):
    px = _manifest(fx).filter("colored").withColumn("px", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).withColumn("py", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return px.select("slide", "position", "px", "py", ((F.col("px") * 7 + F.col("py") * 13 + F.col("position") * 29) % 256).alias("v"))


def _placed(fx):
    return mo.place_patches(_patch_pixels(fx), mo.align_patches(_manifest(fx), _readable(fx)), mo.canvas_extent(_manifest(fx)))


@query(f"with {_PLACED} select slide, x, y, k, v from placed")
def place_patches(fx):
    return _placed(fx)


def _blend(source: str, order: str) -> str:
    return f"""lists as (select slide, x, y, list(cast(v as bigint) order by {order}) as vs from {source} group by 1, 2, 3),
  blended as (select slide, x, y, list_reduce(vs, lambda m, v, i: (m * (i - 1) + v) // i) as m from lists)"""


@query(f"with {_blend('fx_layers', 'k, k2, k3')} select slide, x, y, m as v from blended")
def blend_mosaic(fx):
    return mo.blend_mosaic(fx("fx_layers"), ["k", "k2", "k3"])


_PADDED = f"""{_PLACED}, mx as (select slide, max(w) as mw, max(h) as mh from al group by 1),
  padded as (select * from placed union all select slide, x0 - min_x + cast(px.v as int), y0 - min_y + cast(py.v as int), k, 0 from al join ext using (slide) join mx using (slide), unnest(range(mw)) px(v), unnest(range(mh)) py(v) where px.v >= w or py.v >= h)"""


def _sizes(fx):
    return _manifest(fx).join(_readable(fx), ["slide", "position"]).select("slide", "position", "w", "h")


@query(f"with {_PADDED}, {_blend('padded', 'k')} select slide, x, y, m as v from blended")
def blend_padded_patches(fx):
    return mo.stitch_patches(_patch_pixels(fx), _manifest(fx), _readable(fx), pad=True)


@query(f"""with {_MAN}, ext as (select slide, min(x0) as min_x, min(y0) as min_y, max(x0) - min(x0) + max(w) as width, max(y0) - min(y0) + max(h) as height from man where colored and position % 2 = 0 group by 1)
  select slide, position from man join good using (slide, position) left join ext using (slide)
  where not coalesce(x0 >= min_x and y0 >= min_y and x0 - min_x + w <= width and y0 - min_y + h <= height, false)""")
def out_of_canvas(fx):
    return mo.out_of_canvas(mo.align_patches(_manifest(fx), _readable(fx)), _sizes(fx), mo.canvas_extent(_manifest(fx).filter("position % 2 = 0")))


@query(f"with {_PLACED}, {_blend('placed', 'k')} select slide, x, y, m as v from blended")
def blend_patches_with_seams(fx):
    return mo.stitch_patches(_patch_pixels(fx), _manifest(fx), _readable(fx))


# ---- components and scores ----


def _components(source: str, out: str = "c") -> str:
    """CTEs over pixels `source` (slide, x, y): {out}span (filled spans), {out}lab (spans with comp), {out}cell (a2, m6x, m6y by comp)."""
    o = out
    runs = lambda src, name: f"{name} as (select slide, y, min(x) as x0, max(x) as x1 from (select slide, x, y, x - row_number() over (partition by slide, y order by x) as run from {src}) group by slide, y, run)"
    return f"""{o}fr as (select slide, min(x) - 1 as lx, max(x) + 1 as hx, min(y) - 1 as ly, max(y) + 1 as hy from {source} group by 1),
  {o}bg as (select f.slide, cast(a.v as int) as x, cast(b.v as int) as y from {o}fr f, unnest(range(lx, hx + 1)) a(v), unnest(range(ly, hy + 1)) b(v)
    where not exists (select 1 from {source} s where s.slide = f.slide and s.x = a.v and s.y = b.v)), {runs(f"{o}bg", f"{o}bs")},
  {o}out(slide, y, x0, x1) as (select s.slide, s.y, s.x0, s.x1 from {o}bs s join {o}fr f on f.slide = s.slide and f.ly = s.y union
    select s.slide, s.y, s.x0, s.x1 from {o}out u join {o}bs s on s.slide = u.slide and abs(s.y - u.y) = 1 and s.x0 <= u.x1 and u.x0 <= s.x1),
  {o}fill as (select slide, x, y from {source} union all select b.slide, b.x, b.y from {o}bg b where not exists (select 1 from {o}out u where u.slide = b.slide and u.y = b.y and b.x between u.x0 and u.x1)),
  {runs(f"{o}fill", f"{o}span")},
  {o}edge as (select a.slide, a.y * 1000 + a.x0 as a, b.y * 1000 + b.x0 as b from {o}span a join {o}span b on a.slide = b.slide and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
  {o}reach(slide, a, b) as (select slide, y * 1000 + x0, y * 1000 + x0 from {o}span union select r.slide, r.a, e.b from {o}reach r join {o}edge e on e.slide = r.slide and e.a = r.b),
  {o}root as (select slide, a, min(b) as comp from {o}reach group by 1, 2),
  {o}lab as (select s.*, comp from {o}span s join {o}root r on r.slide = s.slide and r.a = s.y * 1000 + s.x0),
  {o}px as (select slide, comp, cast(v as int) as x, y from {o}lab, unnest(range(x0, x1 + 1)) a(v)),
  {o}cc as (select slide, comp, x - dx as cx, y - dy as cy, count(*) as n, sum(x) as sx, sum(y) as sy from {o}px, (values (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy) group by 1, 2, 3, 4),
  {o}cell as (select slide, comp, sum(case n when 4 then 2 when 3 then 1 else 0 end) as a2, sum(case n when 4 then 6 * cx + 3 when 3 then sx else 0 end) as m6x, sum(case n when 4 then 6 * cy + 3 when 3 then sy else 0 end) as m6y from {o}cc group by 1, 2),
  {o}size as (select slide, comp, count(*) as n from {o}px group by 1, 2)"""


_STROMA = "st as (select slide, tx * 8 + cast(a as int) as x, ty * 8 + cast(b as int) as y from fx_tiles, (select range as a from range(8)), (select range as b from range(8)) where cls = 2)"
_EPI = "epi as (select slide, tx * 8 + cast(a as int) as x, ty * 8 + cast(b as int) as y from fx_tiles, (select range as a from range(8)), (select range as b from range(8)) where cls = 0)"
_COMP = f"with recursive {_TIL}, {_components('til')}"


@query(f"""with {_TIL}, m as (select slide, 'stroma' as kind, case when cls = 2 then 255 else 127 end as v from fx_tiles union all select slide, 'til', case when x % 2 = 0 then 127 else 255 end from til)
  select slide, count(*) filter (where kind = 'stroma' and v = 255) as stroma_area, count(*) filter (where kind = 'til' and v > 0) as til_area from m group by 1""")
def mask_areas(fx):
    s = fx("fx_tiles").select("slide", F.lit("stroma").alias("kind"), F.when(F.col("cls") == 2, 255).otherwise(127).alias("v"))
    t = ma.to_pixels(_til(fx)).select("slide", F.lit("til").alias("kind"), F.when(F.col("x") % 2 == 0, 127).otherwise(255).alias("v"))
    return sc.mask_areas(s.unionByName(t))


@query(f"{_COMP} select slide, comp // 1000 as comp_y, comp % 1000 as comp_x, count(*) as spans from clab group by 1, 2, 3")
def external_components(fx):
    lab = rg.external_components(_til(fx), ["slide"])
    return lab.groupBy("slide", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x")).agg(F.count(F.lit(1)).alias("spans"))


@query(f"{_COMP} select slide, comp // 1000 as comp_y, comp % 1000 as comp_x, a2 / 2.0 as area from ccell")
def component_area(fx):
    m = rg.component_moments(rg.external_components(_til(fx), ["slide"]), ["slide"])
    return m.select("slide", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x"), (F.col("a2") / 2).alias("area"))


@query(f"{_COMP} select slide, comp // 1000 as comp_y, comp % 1000 as comp_x, n from csize")
def component_filled_area(fx):
    m = rg.component_moments(rg.external_components(_til(fx), ["slide"]), ["slide"])
    return m.select("slide", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x"), "n")


_CENTRE = "cen as (select slide, comp, n, cast(round_even(m6x / (3.0 * a2), 0) as int) as cx, cast(round_even(m6y / (3.0 * a2), 0) as int) as cy from ccell join csize using (slide, comp) where a2 > 0)"


@query(f"{_COMP}, {_CENTRE} select slide, comp // 1000 as comp_y, comp % 1000 as comp_x, cx, cy from cen")
def component_centroids(fx):
    m = rg.centroids(rg.component_moments(rg.external_components(_til(fx), ["slide"]), ["slide"]))
    return m.select("slide", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x"), "cx", "cy")


#: From til, st (pixels) and their components.
_SCORE = """t as (select slide, count(*) as til_area from til group by 1), s as (select slide, count(*) as stroma_area from st group by 1),
  o as (select slide, count(*) as til_count, sum(a2) / 2.0 as til_area_contour, sum(n) as til_area_filled from ccell join csize using (slide, comp) group by 1),
  j as (select f.slide, coalesce(til_area, 0) as til_area, coalesce(stroma_area, 0) as stroma_area, coalesce(til_count, 0) as til_count, coalesce(til_area_contour, 0.0) as til_area_contour, coalesce(til_area_filled, 0) as til_area_filled
    from fx_slides f left join t using (slide) left join s using (slide) left join o using (slide))
  select slide, round(til_area / nullif(stroma_area, 0), 6) as til_score, til_count, til_area, til_area_contour, til_area_filled, stroma_area, round((til_area_filled - til_area) / nullif(til_area, 0) * 100, 6) as area_diff_percent from j"""


@query(f"{_COMP}, {_STROMA}, {_SCORE}")
def global_score(fx):
    return sc.global_score(fx("fx_slides"), _til(fx), _tile_spans(fx, 2)).withColumns({c: F.round(c, 6) for c in ("til_score", "area_diff_percent")})


def _named(name: str, source: str) -> str:
    return _blend(source, "k").replace("lists", f"{name}_lists").replace("blended", name)


@query(f"""with recursive {_PLACED}, sp as (select slide, x, y, k, case when v % 3 <> 0 then 255 else 0 end as v from placed), tp as (select slide, x, y, k, case when v % 11 = 0 then 255 else 0 end as v from placed),
  {_named("sm", "sp")}, {_named("tm", "tp")}, st as (select slide, x, y from sm where m = 255), til as (select slide, x, y from tm where m > 0), {_components("til")}, {_SCORE}""")
def stitched_global_score(fx):
    px = _patch_pixels(fx)
    mask = lambda rule: px.withColumn("v", F.when(F.expr(rule), 255).otherwise(0))
    out = wf.stitched_global_scores(fx("fx_slides"), _manifest(fx), _readable(fx), mask("v % 3 <> 0"), mask("v % 11 = 0"))
    return out.withColumns({c: F.round(c, 6) for c in ("til_score", "area_diff_percent")})


_CLUSTER = f"""{_EPI}, {_components('epi', 'e')}, cl as (select p.slide, area, p.comp, p.x, p.y from epx p join ecell c using (slide, comp), (values (40), (100)) a(area) where a2 >= 2 * area)"""


def _params(fx):
    spark = fx("fx_slides").sparkSession
    return spark.createDataFrame([(a,) for a in AREAS], "area int"), spark.createDataFrame([(d,) for d in DISTS], "dist int")


def _clusters(fx):
    return di.cluster_filter(_tile_spans(fx, 0), _params(fx)[0])


@query(f"with recursive {_CLUSTER} select slide, area, comp // 1000 as comp_y, comp % 1000 as comp_x, count(*) as n from cl group by 1, 2, 3, 4")
def cluster_filter(fx):
    c = _clusters(fx)
    return c.groupBy("slide", "area", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x")).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("n"))


#: Offsets up to 7 away; clusters are few enough for a plain join here.
_DIST = f"""with recursive {_CLUSTER}, off as (select a - 7 as dx, b - 7 as dy from (select range as a from range(15)), (select range as b from range(15)) where (a - 7) * (a - 7) + (b - 7) * (b - 7) <= 49),
  dd as (select slide, area, cast(x + dx as int) as x, cast(y + dy as int) as y, min(dx * dx + dy * dy) as d2 from cl, off where x + dx between 0 and 63 and y + dy between 0 and 63 group by 1, 2, 3, 4)"""


@query(f"{_DIST} select slide, area, x, y, d2 from dd")
def distance_to_clusters(fx):
    return di.distance_to_clusters(_clusters(fx), fx("fx_slides"), 7, ["slide", "area"], block=24)


_MASK = f"{_DIST}, dm as (select slide, area, dist, x, y from dd, (values (3), (7)) t(dist) where d2 <= dist * dist)"


@query(f"{_MASK} select * from {_runs('dm', 'slide, area, dist')}")
def distance_mask(fx):
    return di.distance_mask(_clusters(fx), fx("fx_slides"), _params(fx)[1], ["slide", "area"])


_ZONE = f"{_MASK}, {_STROMA}, zn as (select dm.* from dm join st using (slide, x, y))"


def _zone(fx):
    return ma.mask_and(di.distance_mask(_clusters(fx), fx("fx_slides"), _params(fx)[1], ["slide", "area"]), _tile_spans(fx, 2), ["slide"])


@query(f"{_ZONE} select * from {_runs('zn', 'slide, area, dist')}")
def spatial_stroma(fx):
    return an.merge_spans(_zone(fx), ["slide", "area", "dist"])


_KEPT = f"{_ZONE}, {_TIL}, {_components('til')}, {_CENTRE}, kept as (select c.slide, z.area, z.dist, c.comp, c.n from cen c join zn z on z.slide = c.slide and z.x = c.cx and z.y = c.cy)"


@query(f"{_KEPT} select slide, area, dist, comp // 1000 as comp_y, comp % 1000 as comp_x, n from kept")
def centroid_in_stroma(fx):
    tils = rg.centroids(rg.component_moments(rg.external_components(_til(fx), ["slide"]), ["slide"]))
    return di.points_in_spans(tils, _zone(fx).drop("comp"), ["slide"]).select("slide", "area", "dist", F.col("comp.y").alias("comp_y"), F.col("comp.x0").alias("comp_x"), "n")


_SWEEP = f"""{_KEPT}, za as (select slide, area, dist, count(*) as stroma_area from zn group by 1, 2, 3), ka as (select slide, area, dist, count(*) as til_count, sum(n) as til_area from kept group by 1, 2, 3)
  select area, dist, slide, round(coalesce(til_area, 0) / nullif(coalesce(stroma_area, 0), 0), 6) as til_score, coalesce(til_count, 0) as til_count, coalesce(til_area, 0) as til_area, coalesce(stroma_area, 0) as stroma_area
  from fx_slides cross join (values (40), (100)) a(area) cross join (values (3), (7)) d(dist) left join za using (slide, area, dist) left join ka using (slide, area, dist)"""


def _sweep(fx, areas, dists):
    return sc.spatial_scores(fx("fx_slides"), _tile_spans(fx, 0), _tile_spans(fx, 2), _til(fx), areas, dists).withColumn("til_score", F.round("til_score", 6))


@query(_SWEEP + " where area = 100 and dist = 7")
def spatial_score(fx):
    areas, dists = _params(fx)
    return _sweep(fx, areas.filter("area = 100"), dists.filter("dist = 7"))


@query(_SWEEP)
def spatial_sweep(fx):
    return _sweep(fx, *_params(fx))


# ---- from the pixels of patches to scores ----

#: Four patches of 36 x 36 pixels on each slide, 8 pixels of each in a seam; some aren't coloured, some can't be read.
_PATCHES = """pm as (select slide, cast(position as int) as position, cast(position % 2 * 28 as int) as x0, cast(position // 2 * 28 as int) as y0, 36 as w, 36 as h, (slide + position) % 5 <> 0 as colored
    from fx_slides, (select range as position from range(4)) p),
  pt as (select *, row_number() over (partition by slide order by position) as k from pm where colored and (slide + position * 3) % 7 <> 0),
  pq as (select slide, position, k, p.x - x0 as x, p.y - y0 as y, r, g, b, least(r, g, b) > 230 as white, (299 * r + 587 * g + 114 * b + 500) // 1000 > 0 as lit from fx_pixels p join pt using (slide) where p.x between x0 and x0 + 35 and p.y between y0 and y0 + 35),
  ts as (select slide, position, x // 8 as tx, y // 8 as ty, sum(r) as r, sum(g) as g, sum(b) as b, sum(case when white then 1 else 0 end) * 100 <= count(*) * 90 as good from pq where x < 32 and y < 32 group by 1, 2, 3, 4),
  tc as (select slide, position, tx, ty, case when not good then -1 when r >= g and r >= b then 0 when g >= b then 1 else 2 end as cls from ts),
  tv as (select t.slide, t.position, t.tx, t.ty, t.cls, n.cls as o from tc t join tc n on n.slide = t.slide and n.position = t.position and abs(n.tx - t.tx) <= 1 and abs(n.ty - t.ty) <= 1 and (n.tx, n.ty) <> (t.tx, t.ty)),
  tn as (select slide, position, tx, ty, cls, o, count(*) as n, sum(count(*)) over (partition by slide, position, tx, ty) as of from tv group by 1, 2, 3, 4, 5, 6),
  tj as (select slide, position, tx, ty, cls, max(of) as of, coalesce(max(n) filter (where o = cls), 0) as alike, arg_max(o, n * 10 + case o when 0 then 3 when 1 then 2 when 2 then 1 else 0 end) as win from tn group by 1, 2, 3, 4, 5),
  tm as (select slide, position, tx, ty, case when (of = 3 and alike = 0) or (of <> 3 and alike < 3) then win else cls end as cls from tj),
  cq as (select pq.*, cls from pq left join tm on tm.slide = pq.slide and tm.position = pq.position and tm.tx = least(x // 8, 3) and tm.ty = least(y // 8, 3) and x <= 32 and y <= 32),
  po as (select o.slide, cast(contour % 4 as int) as position, contour, seq, cast(greatest(0, least(35, x - contour % 2 * 28)) as int) as x, cast(greatest(0, least(35, y - contour % 4 // 2 * 28)) as int) as y from fx_outlines o)"""


def _po(text: str) -> str:
    """SQL over all outlines, over those of patches."""
    return text.replace("fx_outlines", "po").replace("slide, contour", "slide, position, contour").replace("group by 1, 2)", "group by 1, 2, 3)").replace(" s as (", " sums as (").replace("from s)", "from sums)")


_PATCH_TIL = f"""{_po(_SHAPE)}, {_LIMITS}, shaped as (select slide, position, contour from sh join lim using (slide) where area > min_area and area < max_area and roundness < max_roundness and area <> 0 and perimeter <> 0),
  {_fill("po", "slide, position, contour")}, nf as (select f.slide, f.position, f.contour from fill f join shaped using (slide, position, contour) join cq on cq.slide = f.slide and cq.position = f.position and cq.x = f.x and cq.y = f.y group by 1, 2, 3
    having 2 * count(*) filter (where cls = 2 and not white and lit) >= count(*)),
  lb as (select f.slide, f.position, f.x, f.y, max(label) as label from fill f join (select *, row_number() over (partition by slide, position order by contour) as label from nf) using (slide, position, contour) group by all),
  er as (select * from lb l where not exists (select 1 from lb n where n.slide = l.slide and n.position = l.position and abs(n.x - l.x) <= 1 and abs(n.y - l.y) <= 1 and n.label <> l.label))"""
_ON_CANVAS = f"""px_ext as (select slide, min(x0) as min_x, min(y0) as min_y from pm where colored group by 1),
  onc as (select cq.slide, pt.x0 - min_x + cq.x as x, pt.y0 - min_y + cq.y as y, cq.k, case when cls = 2 and not white then 255 else 0 end as s, case when cls = 0 and not white then 255 else 0 end as e, case when er.slide is null then 0 else 255 end as t
    from cq join pt on pt.slide = cq.slide and pt.position = cq.position join px_ext on px_ext.slide = cq.slide left join er on er.slide = cq.slide and er.position = cq.position and er.x = cq.x and er.y = cq.y),
  src_s as (select slide, x, y, k, s as v from onc), src_t as (select slide, x, y, k, t as v from onc), src_e as (select slide, x, y, k, e as v from onc), {_named("bs", "src_s")}, {_named("bt", "src_t")}, {_named("be", "src_e")},
  st as (select slide, x, y from bs where m = 255), til as (select slide, x, y from bt where m > 0), epi as (select slide, x, y from be where m = 255)"""


def _from_pixels(fx, *params) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.lit(3)))
    manifest = fx("fx_slides").select("slide", at.alias("position")).select(
        "slide", "position", (F.col("position") % 2 * 28).alias("x0"), (F.floor(F.col("position") / 2) * 28).cast("int").alias("y0"), F.lit(36).alias("w"), F.lit(36).alias("h"), ((F.col("slide") + F.col("position")) % 5 != 0).alias("colored"),
    )
    readable = manifest.filter("(slide + position * 3) % 7 <> 0").select("slide", "position")
    px = fx("fx_pixels").join(manifest.join(readable, ["slide", "position"]), "slide").withColumns({"x": F.col("x") - F.col("x0"), "y": F.col("y") - F.col("y0")}).filter("x between 0 and 35 and y between 0 and 35")
    blocks = bl.to_blocks(px.select("slide", "position", *"xyrgb"), manifest.select("slide", "position", F.col("w").alias("width"), F.col("h").alias("height")), wf.PATCH_KEYS, 2 * TILE)
    o = fx("fx_outlines").withColumn("position", (F.col("contour") % 4).cast("int"))
    local = lambda c, start: F.greatest(F.lit(0), F.least(F.lit(35), F.col(c) - start * 28)).cast("int").alias(c)
    outlines = o.select("slide", "position", "contour", "seq", local("x", F.col("contour") % 2), local("y", F.floor(F.col("contour") % 4 / 2)))
    outlines = outlines.join(manifest.filter("colored").join(readable, ["slide", "position"]).select("slide", "position"), ["slide", "position"], "left_semi")
    return wf.pixels_to_scores(fx("fx_slides"), manifest, readable, stored(blocks, "blocks"), outlines, _brightest, TILE, *params)


@query(f"with recursive {_PATCHES}, {_PATCH_TIL}, {_ON_CANVAS}, {_components('til')}, {_SCORE}")
def global_score_from_pixels(fx):
    return _from_pixels(fx).withColumns({c: F.round(c, 6) for c in ("til_score", "area_diff_percent")})


_PIXEL_SWEEP = _SWEEP.replace(f"with recursive {_EPI}", f"with recursive {_PATCHES}, {_PATCH_TIL}, {_ON_CANVAS}").replace(f", {_STROMA}", "").replace(f"{_TIL}, ", "")


@query(_PIXEL_SWEEP)
def spatial_sweep_from_pixels(fx):
    return _from_pixels(fx, *_params(fx)).withColumn("til_score", F.round("til_score", 6))


# ---- training sets ----

_SPLIT = """o as (select cls as class, item, row_number() over (partition by cls order by (item * 7919 + 5) % 10007, item) as rk, count(*) over (partition by cls) as n from fx_split),
  v as (select *, ceil(round(n * 0.2, 6)) as nv from o), sp as (select class, item, case when rk <= nv then 'val' when rk <= nv + ceil(round((n - nv) * 0.125, 6)) then 'test' else 'train' end as split from v)"""


def _split(fx):
    return tr.split_dataset(fx("fx_split").select(F.col("cls").alias("class"), "item"), seed=5)


@query(f"with {_SPLIT} select * from sp")
def split_dataset(fx):
    return _split(fx)


@query("select class, row_number() over (order by class) - 1 as idx from (select distinct concat('c', quantity_class) as class from (select cast(cls as varchar) as quantity_class from fx_tiles)) t")
def class_index(fx):
    return tr.class_index(fx("fx_tiles").select(F.concat(F.lit("c"), "cls").alias("class")))


@query(f"with {_SPLIT} select class, count(*) filter (where split = 'train') as n_train, count(*) filter (where split = 'val') as n_val, count(*) filter (where split = 'test') as n_test from sp group by 1")
def class_counts(fx):
    return tr.class_counts(_split(fx))
