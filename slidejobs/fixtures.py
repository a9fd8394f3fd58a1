"""Slide tables derived from the star-schema test tables: one text for Spark and DuckDB (`//` is Spark's div).

Slides are 64 x 64 pixels with 8 x 8 tiles of 8 pixels. Only integer arithmetic is used, so both engines agree.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from slidejobs.functions.storage import table

SIZE = 64
#: name: (text, other fixtures it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    "fx_slides": (
        """select s_suppkey as slide, 64 as width, 64 as height,
           cast(case when s_nationkey % 5 = 4 then null when s_nationkey % 2 = 0 then 0.25 else 0.5 end as double) as mpp_x,
           cast(case when s_nationkey % 5 = 4 then null when s_nationkey % 2 = 0 then 0.25 else 0.5 end as double) as mpp_y from [supplier]""",
        (),
    ),
    "fx_regions": (
        """select o_custkey % (select count(*) from [supplier]) as slide, o_orderkey as region, cast((o_orderkey * 7) % 54 as int) as x0,
           cast((o_orderkey // 54 * 11 + o_custkey) % 54 as int) as y0, cast(2 + o_orderkey % 8 as int) as w, cast(2 + o_custkey % 7 as int) as h
           from [orders]""",
        (),
    ),
    "fx_vertices": (
        """select slide, region, 0 as seq, x0 as x, y0 as y from [fx_regions] union all select slide, region, 1, x0 + w, y0 from [fx_regions]
           union all select slide, region, 2, x0 + w, y0 + h from [fx_regions] union all select slide, region, 3, x0 + w // 2, y0 + h from [fx_regions]""",
        ("fx_regions",),
    ),
    "fx_nuclei": (
        """select p_partkey % (select count(*) from [supplier]) as slide, p_partkey as contour, cast((p_partkey * 37) % 64 as int) as cx,
           cast((p_partkey * 53 + p_size) % 64 as int) as cy, cast(1 + p_size % 4 as int) as r from [part]""",
        (),
    ),
    "fx_outlines": (
        "select slide, contour, seq, greatest(0, least(63, cx + dx)) as x, greatest(0, least(63, cy + dy)) as y from ("
        + " union all ".join(
            f"select slide, contour, {i} as seq, cx, cy, {dx} as dx, {dy} as dy from [fx_nuclei]"
            for i, (dx, dy) in enumerate([("r", "r // 2"), ("r // 2", "r"), ("-(r // 2)", "r"), ("-r", "r // 2"), ("-r", "-(r // 2)"), ("-(r // 2)", "-r"), ("r // 2", "-r"), ("r", "-(r // 2)")])
        )
        + ") t",
        ("fx_nuclei",),
    ),
    "fx_tiles": (
        """select l_suppkey as slide, cast(l_partkey % 8 as int) as tx, cast(l_orderkey % 8 as int) as ty,
           cast(sum(cast(l_quantity as bigint)) % 4 - 1 as int) as cls from [lineitem] group by 1, 2, 3""",
        (),
    ),
    "fx_layers": (
        """select l_suppkey as slide, cast(l_partkey % 64 as int) as x, cast(l_orderkey % 64 as int) as y, l_linenumber as k, l_orderkey as k2,
           l_partkey as k3, cast(l_quantity as bigint) * 5 as v from [lineitem]""",
        (),
    ),
    "fx_split": ("select cast(l.quality as varchar(10)) as cls, d.doc_id as item from [documents] d join [labels] l on d.doc_id = l.doc_id", ()),
    "fx_scores": ("select vec_id // 64 as slide, cast(vec_id % 8 as int) as tx, cast((vec_id // 8) % 8 as int) as ty, embedding as s from [embeddings]", ()),
    "fx_grid": ("select s_suppkey as slide, cast(x as int) as x, cast(y as int) as y from [supplier], (<xs>) xs, (<ys>) ys", ()),
    "fx_pixels": (
        """select slide, x, y, case when white then 240 else (x * 31 + y * 17 + slide * 7) % 231 end as r,
           case when white then 240 else (x * 29 + y * 11 + slide * 5) % 231 end as g, case when white then 240 else (x * 23 + y * 19 + slide * 3) % 231 end as b
           from (select p.slide, p.x, p.y, coalesce(t.cls, 0) = -1 or (p.x * 13 + p.y * 7 + p.slide) % 11 = 0 as white
                 from [fx_grid] p left join [fx_tiles] t on t.slide = p.slide and t.tx = p.x // 8 and t.ty = p.y // 8) q""",
        ("fx_grid", "fx_tiles"),
    ),
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text, needs = VIEWS[name]
    text = text.replace("//", "div")
    for axis in "xy":
        text = text.replace(f"<{axis}s>", f"select id as {axis} from range({SIZE})")
    frames = {t: fixture(spark, sf_dir, t) if t in VIEWS else table(spark, sf_dir, t) for t in set(re.findall(r"\[(\w+)\]", text))}
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **frames)


def with_views(body: str) -> str:
    """DuckDB text: `body` after the fixtures that it names."""
    order: list[str] = []

    def need(name: str) -> None:
        for n in VIEWS[name][1]:
            need(n)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            need(name)

    def text(name: str) -> str:
        out = VIEWS[name][0]
        for axis in "xy":
            out = out.replace(f"<{axis}s>", f"select range as {axis} from range({SIZE})")
        return re.sub(r"\[(\w+)\]", r"\1", out)

    views = ", ".join(f"{n} as ({text(n)})" for n in order)
    body = body.strip()
    rest = re.match(r"(?is)with\s+(recursive\s+)?(.*)", body)
    if rest:
        return f"with recursive {views}, {rest[2]}" if rest[1] else f"with {views}, {rest[2]}"
    return f"with {views} {body}"
