"""Annotated regions: inventory, vertices, boxes, groups of overlapping boxes, polygon fill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from slidejobs.functions import lines as ln
from slidejobs.functions.components import connected_components, roots
from slidejobs.functions.storage import apart


def slide_inventory(paths: DataFrame) -> DataFrame:
    """dir, stem, slide_path, annotation_path, matched for each slide file among `paths` (path).

    An annotation belongs to the slide of the same folder and stem, case-sensitive; a slide without one is reported with matched = false.
    """
    cut = paths.select("path", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), F.regexp_extract("path", r"\.([^./]*)$", 1).alias("ext"))
    slides = cut.filter("ext = 'svs'").select("dir", "stem", F.col("path").alias("slide_path"))
    notes = cut.filter("ext = 'xml'").groupBy("dir", "stem").agg(F.min("path").alias("annotation_path"))
    return slides.join(notes, ["dir", "stem"], "left").withColumn("matched", F.col("annotation_path").isNotNull())


def pending_work(wanted: DataFrame, done: DataFrame, keys: list[str], rerun: bool = False) -> DataFrame:
    """Keys whose outputs are missing; all of them on a rerun."""
    return wanted if rerun else wanted.join(done.select(*keys), keys, "left_anti")


def scale_vertices(vertices: DataFrame, level: int) -> DataFrame:
    """Coordinates of pyramid level `level`: divided by 2 ** level, cut towards zero."""
    return vertices.withColumns({c: (F.col(c) / (1 << level)).cast("int") for c in ("x", "y")})


def bounding_boxes(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """x, y, w, h per key; a box ends one past the largest coordinate."""
    return vertices.groupBy(*keys).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
    )


def _cells(start: Column, end: Column, size: int) -> Column:
    return F.explode(F.sequence(F.floor(start / size), F.floor(end / size)))


def overlap_pairs(boxes: DataFrame, cell: int = 4096) -> DataFrame:
    """slide, a, b (a < b) for regions whose closed rectangles (x, y, x + w, y + h) meet, touching included.

    Boxes are dealt to grid cells, so the join has equality keys; a pair is taken in the cell where its intersection begins.
    """
    r = boxes.select("slide", "region", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    r = r.withColumn("cx", _cells(F.col("l"), F.col("r"), cell)).withColumn("cy", _cells(F.col("t"), F.col("b"), cell))
    p, q = r.alias("p"), r.alias("q")
    same = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in ("slide", "cx", "cy")]
    meet = (F.col("p.r") >= F.col("q.l")) & (F.col("p.l") <= F.col("q.r")) & (F.col("p.b") >= F.col("q.t")) & (F.col("p.t") <= F.col("q.b"))
    begins = (F.floor(F.greatest("p.l", "q.l") / cell) == F.col("p.cx")) & (F.floor(F.greatest("p.t", "q.t") / cell) == F.col("p.cy"))
    pairs = p.join(q, same[0] & same[1] & same[2] & (F.col("p.region") < F.col("q.region")) & meet & begins)
    return pairs.select(F.col("p.slide").alias("slide"), F.col("p.region").alias("a"), F.col("q.region").alias("b"))


def sweep(left: np.ndarray, top: np.ndarray, right: np.ndarray, bottom: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """Of each closed rectangle the first one that it is joined with, through any others. Rectangles are met in the order of their left sides, `most` pairs at a time."""
    order = np.argsort(left, kind="stable")
    x, end, t, b = left[order], right[order], top[order], bottom[order]
    after = np.searchsorted(x, end, side="right") - np.arange(len(x)) - 1  # those that begin before it ends
    total = np.cumsum(after)
    root, done = np.arange(len(x)), 0
    while done < len(x):
        stop = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + most, side="right")), done + 1)
        for lo in range(0, int(after[done:stop].max(initial=0)) if stop == done + 1 else 1, most):  # one that meets more than `most` is taken in parts
            n = np.clip(after[done:stop] - lo, 0, most if stop == done + 1 else None)
            p = np.repeat(np.arange(done, stop), n)
            q = p + 1 + lo + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            met = (t[p] <= b[q]) & (t[q] <= b[p])
            root = roots(root[p[met]], root[q[met]], len(x))[root]
        done = stop
    first = np.full(len(x), len(x))
    np.minimum.at(first, root, order)
    out = np.empty(len(x), np.int64)
    out[order] = first[root]
    return out


def overlap_groups(boxes: DataFrame, cell: int = 4096) -> DataFrame:
    """slide, region, group_id: connected components of overlap_pairs, named by their smallest region.

    Boxes are dealt to the grid cells that they reach. A cell sweeps its own, which gives each group there as a star about one region, however many pairs overlap;
    stars of different cells that share a region are joined by contraction. So a slide with very many regions is the work of many tasks.
    """
    r = boxes.select("slide", "region", F.col("x").alias("l"), F.col("y").alias("t"), (F.col("x") + F.col("w")).alias("r"), (F.col("y") + F.col("h")).alias("b"))
    dealt = r.withColumn("cx", _cells(F.col("l"), F.col("r"), cell)).withColumn("cy", _cells(F.col("t"), F.col("b"), cell))
    types = {f.name: f.dataType for f in r.schema}

    def stars(t: pa.Table, begins: np.ndarray) -> Iterator[pa.Table]:
        l, top, r, b = (t.column(c).to_numpy().astype(np.int64) for c in "ltrb")
        cell_of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, t.num_rows)))
        aside = cell_of * (int(r.max()) - int(l.min()) + 2)  # cells lie side by side, so one sweep takes all of them
        first = sweep(l + aside, top, r + aside, b)
        joined = np.flatnonzero(first != np.arange(len(first)))
        cols = [t.column("slide"), t.column("region"), t.column("cx"), t.column("cy")]
        at, to = pa.array(first[joined]), pa.array(joined)
        yield pa.table([cols[0].take(to), cols[1].take(at), cols[1].take(to), cols[2].take(to), cols[3].take(to)], schema.names)

    schema = StructType([StructField("slide", types["slide"]), StructField("a", types["region"]), StructField("b", types["region"]), StructField("cx", LongType()), StructField("cy", LongType())])
    edges = ln.by_groups(dealt, ["slide", "cx", "cy"], [], stars, schema)
    node = lambda c: F.struct("slide", F.col(c).alias("region"))
    # edges of a slide's neighbouring cells are joined first by one task
    comp = connected_components(edges.select(node("a").alias("a"), node("b").alias("b"), "cx", "cy"), near=[F.col("a.slide"), F.floor(F.col("cx") / 8), F.floor(F.col("cy") / 8)])
    comp = comp.select("node.slide", "node.region", F.col("comp.region").alias("group_id"))
    return boxes.select("slide", "region").join(apart(comp), ["slide", "region"], "left").withColumn("group_id", F.coalesce("group_id", "region"))


def group_boxes(vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """slide, group_id, x, y, w, h over all vertices of a group."""
    return bounding_boxes(vertices.join(apart(groups), ["slide", "region"]), ["slide", "group_id"])


def concat_vertices(vertices: DataFrame, groups: DataFrame) -> DataFrame:
    """slide, group_id, seq, x, y: the vertices of a group's regions as one outline, region after region; polygon_fill fills it by the even-odd rule."""
    return vertices.join(apart(groups), ["slide", "region"]).select("slide", "group_id", F.struct("region", "seq").alias("seq"), "x", "y")


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, y, x0, x1; ends included) that overlap or touch become one."""
    row = W.partitionBy(*keys, "y").orderBy("x0", "x1")
    before = F.max("x1").over(row.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.select(*keys, "y", "x0", "x1", F.when(F.col("x0") <= before + 1, 0).otherwise(1).alias("new"))
    runs = marked.withColumn("run", F.sum("new").over(row.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "y", "run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("run")


def polygon_fill(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """Spans (keys, y, x0, x1) of the pixels whose centre is inside a polygon by the even-odd rule, or on an edge.

    vertices: keys, seq, x, y (ints), one closed outline per key. Outlines are moved once, whole; a task cuts the edges of many of them by the rows that
    they reach, and pairs the cuts of a row, side by side.
    """
    types = {f.name: f.dataType for f in vertices.schema}
    schema = StructType([*[StructField(k, types[k]) for k in keys], *[StructField(c, IntegerType()) for c in ("y", "x0", "x1")]])

    def run(t: pa.Table, begins: np.ndarray) -> Iterator[pa.Table]:
        count = np.diff(np.append(begins, t.num_rows))
        x, y = (t.column(c).fill_null(0).to_numpy().astype(np.int64) for c in "xy")
        known = t.column("x").is_valid().to_numpy() & t.column("y").is_valid().to_numpy()
        after = np.arange(1, t.num_rows + 1)
        after[begins + count - 1] = begins  # the last vertex goes back to the first
        down = y <= y[after]
        ends = [np.where(down, v, v[after]) for v in (x, y)] + [np.where(down, v[after], v) for v in (x, y)]  # from the upper end to the lower one
        edges = np.stack([np.repeat(np.arange(len(begins)), count), *ends])[:, known & known[after]]
        reach = np.bincount(edges[0], weights=edges[4] - edges[2] + 1, minlength=len(begins)).astype(np.int64)
        first = np.searchsorted(edges[0], np.arange(len(begins) + 1))
        for a, b in ln.portions(reach, _CUTS):
            for g, rows, p0, p1 in _fill_rows(edges[:, first[a] : first[b]]):
                yield pa.table([*ln.keys_of(t, keys, begins[g]), pa.array(rows), pa.array(p0), pa.array(p1)], schema.names)

    points = vertices.select(*keys, "seq", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    return ln.by_groups(points, keys, ["seq", "x", "y"], run, schema)


#: Cuts of edges with rows that are made at once.
_CUTS = 1 << 18


def _fill_rows(edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """group, y, x0, x1 of the pixels in or on the outlines of edges (group, ax, ay, bx, by; ay <= by). Where there are too many cuts the upper and the lower half of the rows come one after the other."""
    if not edges.shape[1]:
        return
    low, high = int(edges[2].min()), int(edges[4].max())
    todo = [(low, high)]
    while todo:
        low, high = todo.pop()
        g, ax, ay, bx, by = edges[:, (edges[2] <= high) & (edges[4] >= low)]
        from_, to = np.maximum(ay, low), np.minimum(by, high)
        if int((to - from_ + 1).sum()) > 2 * _CUTS and low < high:
            todo += [((low + high) // 2 + 1, high), (low, (low + high) // 2)]
            continue
        e, y = ln.repeats(to - from_ + 1)
        if not len(e):
            continue
        y = y + from_[e]
        group, ax, ay, bx, by = g[e], ax[e], ay[e], bx[e], by[e]
        tall = by - ay
        num = ax * tall + (y - ay) * (bx - ax)
        per = np.maximum(tall, 1)
        left = int(min(ax.min(), bx.min()))
        wide, rows = int(max(ax.max(), bx.max())) - left + 4, high - low + 2
        line = (group * rows + y - low) * wide + 1 - left
        flat, on = tall == 0, (tall > 0) & (num % per == 0)
        cut = np.flatnonzero(y < by)
        cut = cut[np.lexsort((num[cut] / per[cut], line[cut]))]
        of = line[cut]
        new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
        place = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
        i = np.flatnonzero(place % 2 == 0)
        i = i[(i + 1 < len(of))]
        i = i[of[i + 1] == of[i]]
        in0, in1 = -(-num[cut[i]] // per[cut[i]]), num[cut[i + 1]] // per[cut[i + 1]]
        some = in0 <= in1
        p0 = np.concatenate([(of[i] + in0)[some], (line + num // per)[on], (line + np.minimum(ax, bx))[flat]])
        p1 = np.concatenate([(of[i] + in1)[some], (line + num // per)[on], (line + np.maximum(ax, bx))[flat]])
        p0, p1 = ln.union(p0, p1)
        row = p0 // wide
        yield row // rows, row % rows + low, p0 % wide - 1 + left, p1 % wide - 1 + left
