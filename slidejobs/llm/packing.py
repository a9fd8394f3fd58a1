"""Best-two-fit packing of token pieces into sequences of a fixed capacity.

A bin is filled greedily, each time with the longest piece that still fits. Then its smallest piece is replaced by
the two unpacked pieces that fill the widened gap most tightly, if two fill more than the one did.

Only lengths matter for that, and there are at most `capacity` different ones. So the plan is made from the counts
of all lengths (a table of bounded size): each pattern of lengths is used as often as the counts allow before the
next one is made. Pieces then find their place by their rank among the pieces of their length. The rank comes
from counts by (length, hash bucket) and a window within a bucket, so a length that a third of all pieces
share is spread over many tasks. Texts and ids are never shuffled.

Edge cases: a null or empty text is a document of its end token alone. Repeated rows and rows with a null doc_id are packed
each. An empty table gives no rows. Extra columns are ignored by pack_documents; pack keeps them, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidejobs.functions.storage import stored, table
from slidejobs.llm.bpe import Encoder, over_texts, word_bpe
from slidejobs.llm.names import unused

CAPACITY = 2048


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document with its end token, cut only where it is longer than a sequence."""
    end = end_id.to_bytes(4, "little")

    def make(doc_ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
        whose, piece, start, length, crc, ids = [], [], [], [], [], []
        for row, raw in enumerate(Encoder.at(path).encode(texts)):
            raw += end
            for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                part = raw[at : at + 4 * capacity]
                whose.append(row)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    ids.append(np.frombuffer(part, "<i4"))
        cols = [doc_ids.take(pa.array(whose, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        return cols + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else [])

    return over_texts(docs, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if keep_ids else ""), make, id_col, text_col)


def largest(mask: int, most: int) -> int:
    """The largest length of the set `mask` (bit i: length i) that is at most `most`; 0 if none is."""
    return max((mask & ((1 << (most + 1)) - 1)).bit_length() - 1, 0) if most > 0 else 0


def best_two(count: np.ndarray, mask: int, gap: int, least: int) -> tuple[int, int] | None:
    """The two lengths with the largest sum over `least` and at most `gap`."""
    best, a = None, largest(mask, min(gap, len(count) - 1))
    while a and 2 * a > least:
        b = largest(mask, min(a, gap - a))
        if b == a and count[a] < 2:
            b = largest(mask, a - 1)
        if b and a + b > least:
            best, least = (a, b), a + b
            if least == gap:
                break
        a = largest(mask, a - 1)
    return best


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths (a bin each) and how often each is used; together they use up the counts."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        count[length] = n
    mask = sum(1 << int(i) for i in np.flatnonzero(count))
    out = []

    def take(length: int, n: int = 1) -> None:
        nonlocal mask
        count[length] -= n
        mask = mask | 1 << length if count[length] else mask & ~(1 << length)

    while mask:
        bin_, gap = [], capacity
        while length := largest(mask, gap):
            bin_.append(length)
            take(length)
            gap -= length
        if gap and len(bin_) > 1 and (two := best_two(count, mask, gap + bin_[-1], bin_[-1])):
            take(bin_.pop(), -1)
            for length in two:
                take(length)
                bin_.append(length)
            bin_.sort(reverse=True)
        used = {length: bin_.count(length) for length in bin_}
        more = min(int(count[length]) // n for length, n in used.items())
        for length, n in used.items():
            take(length, n * more)
        out.append((bin_, 1 + more))
    return out


class Places:
    """Where the r-th piece of a length goes: arrays of runs of ranks, of a size that the capacity bounds."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        rows, given, sequence = [], {}, 0
        for bin_, times in patterns:
            offset = 0
            for length in dict.fromkeys(bin_):
                k = bin_.count(length)
                rows.append((length, given.get(length, 0), k, sequence, offset))
                given[length] = given.get(length, 0) + k * times
                offset += k * length
            sequence += times
        self.runs = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = self.runs[:, 0] << 48 | self.runs[:, 1]
        self.sequences = sequence

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = self.runs[np.searchsorted(self.keys, length << 48 | rank, side="right") - 1]
        ahead = rank - run[:, 1]
        return run[:, 3] + ahead // run[:, 2], run[:, 4] + ahead % run[:, 2] * length


def pack(rows: DataFrame, order: list[str], capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """rows (stored, with lengths 1..capacity) with sequence_id and offset. order: columns that tell rows apart."""
    spark = rows.sparkSession
    n = rows.count()
    buckets = int(max(64, min(4096, n // 20_000)))
    bucket, within, rank, before = (unused(rows.columns, c) for c in ("_bucket", "_within", "_rank", "_before"))
    bucketed = rows.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = bucketed.groupBy(F.col(length_col).alias("length"), F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "lengths")
    totals = {r[0]: r[1] for r in sizes.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(totals, capacity)))
    ahead = F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")
    sizes = sizes.select(F.col("length").alias(length_col), F.col("bucket").alias(bucket), ahead.alias(before))
    own = F.row_number().over(W.partitionBy(length_col, bucket).orderBy(*order)) - 1
    ranked = bucketed.withColumn(within, own).join(sizes, [length_col, bucket]).withColumn(rank, F.col(before) + F.col(within))
    ranked = ranked.select(*rows.columns, rank)
    names = [*rows.columns, "sequence_id", "offset"]
    at = rows.columns.index(length_col)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            seq, off = places.value.find(length, b.column(len(names) - 2).to_numpy(zero_copy_only=False).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq), pa.array(off)], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(put, schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    return pack(stored(pieces(docs, path or word_bpe(), capacity, end_id, id_col, text_col, keep_ids), "pieces"), ["doc_id", "piece", "ids_crc32"], capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
