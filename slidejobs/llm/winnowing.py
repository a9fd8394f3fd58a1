"""Document fingerprints by winnowing.

Every k-gram of characters has a rolling hash; of each window of w neighbouring k-grams the smallest is chosen, of
equal ones the rightmost. Chosen hashes are kept with their positions. Two texts that share w + k - 1 characters in a
row share a chosen hash, at the positions of that passage. Texts under 2 (w + k - 1) characters have a smaller window, so that
either half holds a whole one; its choice holds all that the full window would choose. Where half a text is shorter than k, all
k-grams are chosen, and all grams of the two longest of k/2, k/4, ... characters that fit into half the text. So a text and its edited
one always share a chosen hash of the half that stays. A-Z count as a-z and any of [\\x09-\\x0D] as a space, each at its place.

Next documents. Rows are dealt by ranges of doc_id into buckets whose limits are quantiles of the ids. The first row of
each bucket is sent to the bucket before it as well (a bucket's only neighbour), so one sort within buckets gives every row its
next one, and texts move once.

Edge cases: null counts as empty; an empty text has an empty fingerprint. A text shorter than k has one hash, of all of it.
Two empty fingerprints are alike (1.0), an empty one and another are not (0.0). Rows with one doc_id follow each other in the order of
their texts' hashes; null ids come last. A table of one row is its own next row; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import stored, table

K, WINDOW = 25, 76
NO_ID = 2**63 - 1  # stands for a null id, so that it is the last
SHORT = [K >> i for i in range(1, K.bit_length())]  # grams of texts whose half is shorter than K
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[65:91] += 32
_FOLD[9:14] = 32


def code_points(text: str) -> np.ndarray:
    if text.isascii():
        return _FOLD[np.frombuffer(text.encode(), np.uint8)]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = c < 128
    return np.where(low, _FOLD[np.where(low, c, 0)], c)


def kgram_hashes(c: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k-gram: a polynomial modulo 2^64, built by doubling, then mixed."""
    mixed = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    k = min(k, len(c))
    out, have, block, size, power = None, 0, mixed, 1, BASE
    while True:  # block: hashes of all runs of `size`, power: BASE ** size
        if k & size:
            if out is None:
                out, have = block, size
            else:  # the run of `have` characters, then one of `size`
                n = len(c) - have - size + 1
                out = out[:n] * power + block[have : have + n]
                have += size
        if size * 2 > k:
            break
        n = len(c) - 2 * size + 1
        block = block[:n] * power + block[size : size + n]
        power = np.uint64(int(power) ** 2 & (2**64 - 1))
        size *= 2
    out = out ^ (out >> np.uint64(32))
    out = out * np.uint64(0xD6E8FEB86659FD93)
    return (out >> np.uint64(32)).astype(np.uint32)


def winnow(text: str, k: int | None = None, w: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes that are chosen, by position. Without k and w: K and WINDOW, the module's rule for short texts included."""
    c = code_points(text)
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    if k is not None or w is not None:
        return chosen(c, k or K, w or WINDOW)
    half = len(c) - len(c) // 2
    pos, h = chosen(c, K, max(1, min(WINDOW, half - K + 1)))
    if half >= K:
        return pos, h
    grams = [g for g in SHORT if g <= half][:2]
    pos, h = (np.concatenate(x) for x in zip((pos, h), *[chosen(c, g, 1) for g in grams], strict=True))
    order = np.argsort(pos, kind="stable")
    return pos[order], h[order]


def chosen(c: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    h = kgram_hashes(c, k)
    w = min(w, len(h))
    # of equal hashes the rightmost: later positions make smaller keys
    key = h.astype(np.uint64) << np.uint64(32) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    low, size = key, 1
    while size * 2 <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    pos = (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)
    pos = pos[np.r_[True, pos[1:] != pos[:-1]]]
    return pos, h[pos]


def as_text(pos: np.ndarray, h: np.ndarray) -> str:
    """hash@position, hexadecimal and decimal, by position."""
    return " ".join([f"{b:08x}@{a}" for a, b in zip(pos.tolist(), h.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the chosen hashes of either that both have. a, b: sorted, distinct."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def edited(text: str, following: str) -> str:
    """text with its last floor(n/2) characters replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(rows: DataFrame, per_bucket: int = 1000, most: int = 8192) -> DataFrame:
    """rows (doc_id, text) with columns bucket, side and order keys: sorted by them within a bucket, each row with
    side 0 is followed by the next document. Rows with side 1 are copies that only serve as the next one of another.
    """
    ids = rows.select("doc_id")
    n = ids.count()
    buckets = max(1, min(most, n // per_bucket))
    probs = [i / buckets for i in range(1, buckets)]
    limits = sorted(set(ids.agg(F.percentile_approx("doc_id", probs, 10 * buckets)).first()[0])) if probs and n else []
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(np.array(limits, np.int64))  # `most` numbers at most

    @F.pandas_udf("int")
    def bucket_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(held.value, x.to_numpy(np.int64), side="right").astype(np.int32))

    dealt = rows.select("doc_id", "text", bucket_of("doc_id").alias("bucket"), F.xxhash64("text").alias("tie"))
    firsts = stored(dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("f")).select("bucket", "f.*"), "firsts")
    order = [r[0] for r in firsts.select("bucket").orderBy("bucket").collect()]  # `most` numbers at most
    if not order:
        return dealt.withColumn("side", F.lit(0))
    before = spark.createDataFrame([(b, order[i - 1]) for i, b in enumerate(order)], "bucket int, sent int")
    sent = firsts.join(F.broadcast(before), "bucket").select(F.col("doc_id").alias("_id"), F.col("tie").alias("_tie"), "sent")
    copies = dealt.join(F.broadcast(sent), (F.col("doc_id") == F.col("_id")) & (F.col("tie") == F.col("_tie")))
    copies = copies.select("doc_id", "text", F.col("sent").alias("bucket"), "tie", F.lit(1).alias("side"))
    return dealt.withColumn("side", F.lit(0)).unionByName(copies)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, w: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = with_next(rows)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket", "side", "doc_id", "tie").select("bucket", "side", "doc_id", "text")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []
        for b in batches:
            for bucket, side, doc_id, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if last is None or last[0] != bucket:
                    last, seen = None, None
                prints = None
                if last is not None and not (side and seen):
                    prints = winnow(text, k, w)
                    out.append(one(last, text, prints))
                    seen = bool(side)
                if not side:
                    last = (bucket, doc_id, text, prints or winnow(text, k, w))
                    seen = False
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
                out = []

    def one(row: tuple, following: str, prints: tuple) -> tuple:
        _, doc_id, text, (pos, h) = row
        new = edited(text, following)
        new_pos, new_h = winnow(new, k, w)
        own = np.unique(h)
        return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(pos, h), as_text(new_pos, new_h), likeness(own, np.unique(new_h)), likeness(own, np.unique(prints[1])))

    out = dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
