"""How document filters interact: what each removes at each place of each order, and what only it would have removed.

Texts are scanned as the bytes of Arrow buffers: tables give each byte its classes, prefix sums count words, capitals, symbols and code points of
all texts of a batch. Words are hashed, hashes are sorted within their document, and equal neighbours are compared byte by byte, so the number
of different words is exact; a document in which equal hashes stand for different words is counted again as a set.

What a document fails is a mask of five bits, so a part of the corpus is 32 counts, and every order of the filters follows from those.
Whether a text was there before is found by its SHA-256: rows are first summed by digest, id and mask, so a text that a third of all rows share
is a few rows when the smallest id is looked up.

Edge cases: a null text counts as empty, a null lang as the empty string. A text with no words has too few words, and not too few different ones.
Rows repeated with their doc_id have no smaller id among them, so none of them is a copy of another; they count each. A null doc_id stands last:
such a row is a copy if any row with an id has its text, and rows of null ids are no copies of each other; it has no labels. A document
labelled more than once has a label if any of its rows has it; a null label is 0. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidejobs.functions.storage import table
from slidejobs.llm.bpe import slices
from slidejobs.llm.wordscan import SMALL, Blocks, byte_class, hashes, per_text, raw_bytes, same_bytes, words

LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3  # words; percent of the words; percent of the code points
SPACE, CAPITAL, SYMBOL, LATER = 1, 2, 4, 8
CLASSES = byte_class(b" \t\n\x0b\x0c\r", SPACE) | byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", CAPITAL) | byte_class(b"#$%&*|", SYMBOL) | byte_class(bytes(range(0x80, 0xC0)), LATER)


def distinct_words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, text: np.ndarray, texts: int, bits: int = 44) -> np.ndarray:
    """How many different words each text has. bits: of a word's hash; texts must fit in the other bits."""
    blocks = Blocks(data)
    key = (text.astype(np.uint64) << np.uint64(bits)) | (hashes(blocks, starts, sizes) >> np.uint64(64 - bits))
    order = np.argsort(key)
    key = key[order]
    again = np.flatnonzero(key[1:] == key[:-1]) + 1
    a, b = order[again - 1], order[again]
    alike = sizes[a] == sizes[b]
    alike[alike] = same_bytes(blocks, starts[a[alike]], starts[b[alike]], sizes[a[alike]])
    out = np.bincount(text, minlength=texts) - np.bincount(text[b], minlength=texts)
    for i in np.unique(text[b[~alike]]):
        own = np.flatnonzero(text == i)
        out[i] = len({data[s : s + n].tobytes() for s, n in zip(starts[own].tolist(), sizes[own].tolist(), strict=True)})
    return out


def scan(texts: pa.Array, bits: int = 44) -> dict[str, np.ndarray]:
    """Words, different words, capitals, symbols and code points of each text."""
    data, at = raw_bytes(texts)
    cls = CLASSES[data]
    starts, sizes, text = words((cls & SPACE) == 0, at)
    return {
        "words": np.bincount(text, minlength=len(texts)), "distinct": distinct_words(data, starts, sizes, text, len(texts), bits),
        "capitals": per_text((cls & CAPITAL) != 0, at), "symbols": per_text((cls & SYMBOL) != 0, at), "chars": per_text((cls & LATER) == 0, at),
    }


def failed(texts: pa.Array) -> np.ndarray:
    """Bits of the filters A to D that each text fails."""
    x = scan(texts)
    bad = [x["words"] < LEAST_WORDS, 100 * x["distinct"] < LEAST_DISTINCT * x["words"], 100 * x["capitals"].astype(np.int64) > MOST_CAPITALS * x["chars"].astype(np.int64), x["symbols"] > 0]
    return sum(b.astype(np.int32) << i for i, b in enumerate(bad))


def text_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, digest, fails (bits of A to D) of each row of docs."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in slices(b.column(2), SMALL):
                texts = b.column(2)[s]
                data, at = raw_bytes(texts)
                digests = [hashlib.sha256(data[i:j]).digest() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0)[s], b.column(1)[s], pa.array(digests, pa.binary()), pa.array(failed(texts))], ["doc_id", "part", "digest", "fails"])

    return rows.mapInArrow(run, "doc_id long, part string, digest binary, fails int")


def cells(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, fails (bits of A to E), n, good, toxic: at most 32 rows a part. masks: as text_masks gives them; labels: id, quality, toxic."""
    labelled = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("spread"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    labelled = labelled.agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    # rows without an id have no label, and are spread by their texts
    keyed = masks.withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long")))
    rows = keyed.join(labelled, ["doc_id", "spread"], "left").fillna(0, ["good", "toxic"])
    kind = ["digest", "part", "fails", "good", "toxic"]
    once = rows.groupBy("doc_id", "spread", *kind).agg(F.count(F.lit(1)).alias("n"))
    no_id = F.col("doc_id").isNull().alias("no_id")
    # of each kind of row, those with the smallest id apart
    alike = once.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(F.struct(no_id, "doc_id", "n")).alias("first"))
    least = F.min(F.struct("first.no_id", "first.doc_id")).over(W.partitionBy("digest"))
    kept = F.when(F.struct("first.no_id", "first.doc_id").eqNullSafe(F.col("least")), F.when(F.col("least.no_id"), F.col("n")).otherwise(F.col("first.n"))).otherwise(F.lit(0).cast("long"))
    split = alike.withColumn("least", least).withColumn("kept", kept)
    two = F.array(F.struct(F.col("fails"), F.col("kept").alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - F.col("kept")).alias("n")))
    each = split.select("part", "good", "toxic", F.explode(two).alias("c")).filter("c.n > 0")
    return each.groupBy("part", F.col("c.fails").alias("fails")).agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("good")).alias("good"), F.sum(F.col("c.n") * F.col("toxic")).alias("toxic"))


def report(counts: DataFrame) -> DataFrame:
    """Every part, order of the filters and step, from the counts of each mask (cells)."""
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    orders = ",".join("".join(p) for p in permutations(LETTERS))
    rows = parts.select("part", "cells", F.explode(F.split(F.lit(orders), ",")).alias("filter_order"))
    rows = rows.select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    mask = lambda letters: reduce(Column.__add__, [F.when(F.contains(letters, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(LETTERS)])
    rows = rows.withColumns({"own": mask(F.expr("substring(filter_order, step, 1)")), "earlier": mask(F.expr("substring(filter_order, 1, step - 1)"))})
    total = lambda which, what=lambda c: c.n: F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + what(c))
    own, earlier = F.col("own"), F.col("earlier")
    fails, before = (lambda c: c.fails.bitwiseAND(own) != 0), (lambda c: c.fails.bitwiseAND(earlier) != 0)
    here = lambda c: fails(c) & ~before(c)
    return rows.select(
        "part", "filter_order", "step", total(lambda c: ~fails(c) & ~before(c)).alias("kept"), total(here).alias("removed"), total(lambda c: fails(c) & before(c)).alias("redundant"),
        total(lambda c: c.fails == own).alias("unique_fails"), total(here, lambda c: c.good).alias("good_lost"), total(here, lambda c: c.toxic).alias("toxic_lost"),
        # of the orders of what a document fails, each filter comes first in the same share
        total(fails, lambda c: (F.lit(120) / F.bit_count(c.fails)).cast("long") * c.n).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(cells(text_masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


SQL = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by text) as least from t),
l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(ws) < 200 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 50 * len(ws) then 2 else 0 end
    + case when 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 3 * length(text) then 4 else 0 end
    + case when regexp_matches(text, '[#$%&*|]') then 8 else 0 end + case when doc_id > least or (doc_id is null and least is not null) then 16 else 0 end as fails
  from w left join l using (doc_id)),
c as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2),
x as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(ch, bit)),
o as (select a.ch || b.ch || c.ch || d.ch || e.ch as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from x a, x b, x c, x d, x e
  where length(regexp_replace('ABCDE', '[' || a.ch || b.ch || c.ch || d.ch || e.ch || ']', '', 'g')) = 0),
s as (select filter_order, cast(step as int) as step, bits[step] as own, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) as earlier from o, range(1, 6) r(step)),
m as (select part, filter_order, step, own, sum(case when fails & (own + earlier) = 0 then n else 0 end) as kept, sum(case when fails & own <> 0 and fails & earlier = 0 then n else 0 end) as removed,
    sum(case when fails & own <> 0 and fails & earlier <> 0 then n else 0 end) as redundant, sum(case when fails = own then n else 0 end) as unique_fails,
    sum(case when fails & own <> 0 and fails & earlier = 0 then good else 0 end) as good_lost, sum(case when fails & own <> 0 and fails & earlier = 0 then toxic else 0 end) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
  cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from m
"""
