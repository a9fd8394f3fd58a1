"""Exact dedup by progressive refinement, with DataFrame functions only.

Rows are grouped by the length of the normalised text, then by a hash of its first characters, then
by a digest of all of it. Each level reads only what it needs from the rows that the level before left
in groups of two or more; no level moves texts. Surviving keys go to the rows by broadcast, or as a bitmap of bounded size where they are many.

Edge cases: a null text counts as empty; all empty texts are one group. A row repeated with its doc_id
counts in group_size like any copy and has the verdict of its doc_id. A null doc_id stands last when the row to keep is
chosen; of rows that only null ids hold, all have a null keep_id and count as kept, and drop_duplicates leaves one. A doc_id
that several texts share has a verdict for each. An empty table gives no rows. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import small, stored, table
from slidejobs.llm.names import unused

WHITESPACE = " \t\n\x0b\f\r"
PREFIX_CHARS = 64
CELLS = 1 << 28  # of the bitmap that stands for keys too many to broadcast


def normalised(text: Column) -> Column:
    """The text without any character of [\\x20\\x09-\\x0D]; null gives the empty string."""
    out = F.coalesce(text, F.lit(""))
    for ch in WHITESPACE:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text."""
    return F.sha2(normalised(text), 256)


def may_survive(keyed: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows of keyed whose length and prefix may stand in prefixes, by a bitmap of CELLS bits that is broadcast in pieces of 4 KB, 32 MB in all.

    At 100 million keys it still holds back two thirds of the rows that have none.
    """
    cell = F.pmod(F.xxhash64("n_len", "prefix"), F.lit(CELLS))
    bits = prefixes.groupBy(F.bitmap_bucket_number(cell).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits"))
    met = keyed.withColumn("piece", F.bitmap_bucket_number(cell)).withColumn("at", F.bitmap_bit_position(cell)).join(F.broadcast(bits), "piece")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.expr("cast(at div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return met.filter(byte.bitwiseAND(F.expr("shiftleft(1, cast(at % 8 as int))")) != 0).drop("piece", "at", "bits")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Groups of two or more rows with equal normalised texts (text_sha256, keep_id, group_size), and the rows that were digested (doc_id, text_sha256 and more).

    keep_id is the doc_id of the row with the most code points in its original text, then the smallest doc_id, null last.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by_length = rows.select(F.octet_length(normalised(F.col("text"))).alias("n_len"))
    lengths = by_length.groupBy("n_len").count().filter("count > 1").select("n_len")
    norm = rows.select("doc_id", "text", normalised(F.col("text")).alias("norm"))
    short = norm.select(F.octet_length("norm").alias("n_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))
    # counted by both before the join: a length that many rows share is spread over its prefixes, and copies are summed where they are read
    prefixes = short.groupBy("n_len", "prefix").count().join(lengths, "n_len", "left_semi")
    prefixes = stored(prefixes.filter("count > 1").select("n_len", "prefix"), "prefixes")
    n = prefixes.count()
    keyed = norm.select("doc_id", "text", "norm", F.octet_length("norm").alias("n_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix"))
    full = lambda df: df.select("doc_id", "n_len", "prefix", F.sha2("norm", 256).alias("text_sha256"), F.char_length("text").alias("chars"))
    if n <= broadcast_rows:  # the keys go to the rows, and only rows that survive are digested
        last = full(keyed.join(small(prefixes, broadcast_rows, n), ["n_len", "prefix"], "left_semi"))
    else:  # a filter of bounded size goes to the rows; what passes is digested and joined with the keys, so digests are moved, never texts
        last = full(may_survive(keyed, prefixes)).join(prefixes, ["n_len", "prefix"], "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("chars")).alias("less"), "doc_id"))
    groups = last.groupBy("n_len", "prefix", "text_sha256").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
    groups = stored(groups.filter("group_size > 1").select("text_sha256", F.col("first.doc_id").alias("keep_id"), "group_size"), "groups")
    return small(groups), last  # by broadcast, as long as they are few, so that no task gets all rows of one group


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    groups, _ = duplicate_groups(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("text_sha256"))
    keep = F.coalesce("keep_id", "doc_id")
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256",
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without rows whose text another row keeps; repeats of a kept doc_id go as well.

    Only rows that survive the length and the prefix are digested. Rows are matched by id, null ids too, and those that
    match by digest. Those to drop and those that repeat are few beside the rows: they are broadcast while they are counted to be small, and joined
    by a shuffle beyond.
    """
    groups, last = duplicate_groups(docs, id_col, text_col)
    gid = unused(docs.columns, "_group_id")
    sha = unused([*docs.columns, gid], "_group_sha")
    members = last.join(groups, "text_sha256").groupBy("doc_id", "keep_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    members = stored(members, "members")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keys = lambda which: members.filter(which).select(F.col("doc_id").alias(gid), F.col("text_sha256").alias(sha))
    gone, again = keys(~stays), keys(stays & (F.col("n") > 1))
    # not an equality to Spark, so that the digest is taken of rows with a listed id only
    same = F.col(id_col).eqNullSafe(F.col(gid)) & (F.position(F.col(sha), digest(F.col(text_col))) == 1)
    left = docs.join(small(gone), same, "left_anti")
    if (n := again.count()) == 0:
        return left
    again = small(again, count=n)
    repeated = left.join(again, same, "left_semi").withColumn(sha, digest(F.col(text_col))).dropDuplicates([id_col, sha]).drop(sha)
    return left.join(again, same, "left_anti").unionByName(repeated)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents),
g as (select text_sha256, count(*) as group_size, arg_min(doc_id, (-chars, doc_id)) as keep_id from d group by 1)
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept, d.text_sha256 from d join g using (text_sha256)
"""
