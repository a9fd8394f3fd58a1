"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from slidejobs.functions.storage import apart, stored


def roots(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of 0..n-1 is joined with: roots of edges are hung below smaller ones, then all pointers are followed."""
    up = np.arange(n)
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(further := up[up], up):
            up = further
        u, v = up[u], up[v]
        u, v = u[u != v], v[u != v]
    return up


def _stars(edges: DataFrame, near: list[Column], most: int = 200_000) -> DataFrame:
    """Edges with the same components and short paths: each run of up to `most` edges that a task reads becomes stars about its smallest nodes.

    near: edges with the same values are read by the same task.
    """
    kind = edges.schema["a"].dataType
    arrow = to_arrow_type(kind)

    def contract(kept: list[pa.RecordBatch]) -> pa.RecordBatch:
        nodes = pa.concat_arrays([b.column(i).cast(arrow) for i in (0, 1) for b in kept])
        fields = nodes.flatten() if isinstance(kind, StructType) else [nodes]
        wide = pd.DataFrame({str(i): f.to_numpy(zero_copy_only=False) for i, f in enumerate(fields)})
        code = wide.groupby(list(wide.columns), dropna=False).ngroup().to_numpy()  # in the order of the nodes
        half = len(code) // 2
        _, first = np.unique(code, return_index=True)
        up = roots(code[:half], code[half:], len(first))
        below = np.flatnonzero(up != np.arange(len(first)))
        return pa.RecordBatch.from_arrays([nodes.take(pa.array(first[up[below]])), nodes.take(pa.array(first[below]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for b in batches:
            kept.append(b)
            n += b.num_rows
            if n > most:
                yield contract(kept)
                kept, n = [], 0
        if n:
            yield contract(kept)

    return edges.repartition(*near).select("a", "b").mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", near: list[Column] | None = None) -> DataFrame:
    """node, comp for every node of edges: comp is the smallest node that it is joined with.

    Each round every node points to its smallest neighbour if that is smaller, pointers are followed once more,
    and edges are drawn between what was pointed to. Pointers lead downwards, so there are no cycles; one end at least of
    every edge moves to a smaller node, and only nodes that were pointed to go on. Rounds are written to the
    shared folder. near: columns of edges that most components agree in; edges that agree in them are joined first, in memory.
    Null ends are ignored; no edges give no rows.
    """
    left = edges.withColumns({"a": F.col(a), "b": F.col(b)}).filter("a <> b")
    left = stored(_stars(left, near) if near else left.select("a", "b").distinct(), "edges")
    moved = apart if near else lambda df: df
    levels: list[DataFrame] = []
    while left.take(1):
        both = left.union(left.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("to"))
        again = up.select(F.col("node").alias("to"), F.col("to").alias("further"))
        up = stored(up.join(moved(again), "to", "left").select("node", F.coalesce("further", "to").alias("to")), "pointers")
        levels.append(up)
        x, y = up.select(F.col("node").alias("a"), F.col("to").alias("ta")), up.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        left = stored(left.join(moved(x), "a").join(moved(y), "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b").distinct(), "edges")
    if not levels:
        return left.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    out = levels[0].withColumnRenamed("to", "comp")
    for up in levels[1:]:
        step = up.select(F.col("node").alias("comp"), F.col("to").alias("further"))
        out = out.join(moved(step), "comp", "left").select("node", F.coalesce("further", "comp").alias("comp"))
    return stored(out, "components") if len(levels) > 1 else out
