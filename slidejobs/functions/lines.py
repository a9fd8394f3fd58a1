"""Spans of many small groups at once, in memory: the rows of all groups are laid one after another on one line, so a set of spans is two sorted arrays.

A span is p0..p1, ends included. Rows are `wide` apart, with a free place at both ends and a free row between groups, so nothing meets that shouldn't.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from slidejobs.functions.components import roots

FAR = 1 << 62


def union(p0: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with gaps between them: what overlaps or touches becomes one."""
    if not len(p0):
        return p0, p1
    order = np.argsort(p0, kind="stable")
    p0, p1 = p0[order], np.maximum.accumulate(p1[order])
    new = np.flatnonzero(np.concatenate([[True], p0[1:] > p1[:-1] + 1]))
    return p0[new], p1[np.append(new[1:], len(p0)) - 1]


def repeats(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i, and 0..n[i]-1, for every i."""
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)


def meet(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """i, j of the spans of a and of b (sorted, disjoint) that share a place."""
    lo = np.searchsorted(b1, a0, "left")
    i, more = repeats(np.maximum(np.searchsorted(b0, a1, "right") - lo, 0))
    return i, lo[i] + more


def minus(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the spans a have and the spans b (both as union() leaves them) haven't."""
    g0, g1 = np.concatenate([[-FAR], b1 + 1]), np.concatenate([b0 - 1, [FAR]])
    i, j = meet(a0, a1, g0, g1)
    return np.maximum(a0[i], g0[j]), np.minimum(a1[i], g1[j])


def joined(p0: np.ndarray, p1: np.ndarray, wide: int, reach: int) -> np.ndarray:
    """Of each span the first one that it is joined with by way of neighbouring rows; reach 1: corners join."""
    i, j = meet(p0 - reach, p1 + reach, p0 - wide, p1 - wide)
    return roots(i, j, len(p0))


def portions(weight: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of groups whose weights sum up to `most`, or hold one group."""
    total, at = np.cumsum(weight), 0
    while at < len(weight):
        to = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")), at + 1)
        yield at, to
        at = to


def by_groups(rows: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table, np.ndarray], Iterator[pa.Table]], schema: StructType, most: int = 100_000) -> DataFrame:
    """run(table, begins) over tables of whole groups: those with equal keys, in `order`; begins: where each begins. A table has some `most` rows, or one group.

    One exchange; groups are dealt to as many tasks as a shuffle has, and a task takes many of them at once.
    """
    arrow = to_arrow_schema(schema)

    def begins(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for k in keys:
            code = t.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = (code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table, at: np.ndarray) -> Iterator[pa.RecordBatch]:
            for made in run(t, at):
                yield from made.select(arrow.names).cast(arrow).to_batches(max_chunksize=100_000)

        held, n, wanted = [], 0, most
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= wanted:
                t = pa.Table.from_batches(held).combine_chunks()
                at = begins(t)
                if at[-1]:
                    yield from out(t.slice(0, at[-1]), at[:-1])
                held = t.slice(at[-1]).to_batches()
                n = t.num_rows - int(at[-1])
                wanted = max(most, 2 * n)  # a long group is not searched again with each batch
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from out(t, begins(t))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(go, schema)


def keys_of(t: pa.Table, keys: list[str], rows: np.ndarray) -> list[pa.ChunkedArray]:
    at = pa.array(rows)
    return [t.column(k).take(at) for k in keys]
