"""URL filter: a blocked Bloom filter of listed keys in front of an exact hash join.

A list holds canonical URLs and host/path rules. Its keys set bits in a Bloom filter whose bits for one key all
lie in one block of 512 bits. Pages whose candidate keys may be listed go on to an exact join with the list, which
removes false positives; all other pages have their verdict without being moved. Which rule fits best is found once for
each different host and path that may have one. The exact tables are counted: up to 200,000 rows they are broadcast, longer
ones are hashed after a shuffle of the pages that the filter let through. The filter has a fixed largest
size, so broadcasting it is safe: a longer list raises the share of false positives, never an error.

Edge cases: a url that is null or has no "://" has an empty host and path, fits no rule and is not listed. Repeated
page rows are judged each, rows with a null page_id too. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from slidejobs.functions.storage import BROADCAST_ROWS, stored, table

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BLOCK_WORDS = 8  # of 64 bits
HASHES = 8
MAX_BLOCKS = 1 << 19  # 32 MB


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a final slash or .html; scheme, query and fragment don't count."""
    return F.concat(host, F.regexp_replace(path, r"(\.html|/+)\z", ""))


def _places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each 64-bit hash, and the HASHES bits (0..511) in it."""
    h = h.astype(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)
    low = h & np.uint64(0xFFFFFFFF)
    bits = (low[:, None] + (step | np.uint64(1))[:, None] * np.arange(HASHES, dtype=np.uint64)[None, :]) % np.uint64(BLOCK_WORDS * 64)
    return block, bits.astype(np.int64)


class BlockedBloom:
    """Built from a column of 64-bit hashes by the executors; the driver holds its fixed size only."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, BLOCK_WORDS) of uint64

    @classmethod
    def of(cls, keys: DataFrame, bits_per_key: int = 12, max_blocks: int = MAX_BLOCKS) -> BlockedBloom:
        """keys: one column of distinct longs."""
        n = keys.count()
        blocks = int(min(max_blocks, max(1, -(-n * bits_per_key // (BLOCK_WORDS * 64)))))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = np.zeros((blocks, BLOCK_WORDS), np.uint64)
            for b in batches:
                block, bits = _places(b.column(0).to_numpy(zero_copy_only=False), blocks)
                for j in range(HASHES):
                    np.bitwise_or.at(words, (block, bits[:, j] >> 6), np.uint64(1) << (bits[:, j] & 63).astype(np.uint64))
            at = np.flatnonzero(words.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(at)] + [pa.array(words[at, j].view(np.int64)) for j in range(BLOCK_WORDS)], ["block"] + [f"w{j}" for j in range(BLOCK_WORDS)])

        schema = "block long, " + ", ".join(f"w{j} long" for j in range(BLOCK_WORDS))
        merged = keys.mapInArrow(partial, schema).groupBy("block").agg(*[F.bit_or(f"w{j}").alias(f"w{j}") for j in range(BLOCK_WORDS)]).toArrow().to_pandas()
        words = np.zeros((blocks, BLOCK_WORDS), np.uint64)
        for j in range(BLOCK_WORDS):
            words[merged["block"].to_numpy(np.int64), j] = merged[f"w{j}"].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        block, bits = _places(h, len(self.words))
        hit = np.ones(len(h), bool)
        for j in range(HASHES):
            hit &= (self.words[block, bits[:, j] >> 6] >> (bits[:, j] & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit


def rule_keys(host: Column, path: Column, path_lengths: list[int]) -> Column:
    """Array of the keys host-suffix + path-prefix that a rule for this page can have, for the lengths of listed paths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*[F.substring(path, 1, n) for n in path_lengths]), lambda p: p != "")
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def hashed(df: DataFrame) -> DataFrame:
    """df, a stored table, as the build side of a hash join: broadcast if it is short."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df.hint("shuffle_hash")


def sifted(rows: DataFrame, bloom: BlockedBloom, rule_hash: Callable[[Column], Column], url_hash: Callable[[Column], Column]) -> DataFrame:
    """rows (page_id, host, path, key, keys) with maybe_listed, and of keys those that may be rules."""
    held = rows.sparkSession.sparkContext.broadcast(bloom.words)
    rows = rows.select("page_id", "host", "path", "key", "keys", url_hash(F.col("key")).alias("h"), F.transform("keys", rule_hash).alias("hs"))
    names = ["page_id", "host", "path", "key", "keys", "maybe_listed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = BlockedBloom(held.value)
        for b in batches:
            keys, hs = b.column(4), b.column(6)
            may = bloom.may_hold(hs.flatten().to_numpy(zero_copy_only=False))
            at = np.r_[0, np.cumsum(may)][hs.offsets.to_numpy() - hs.offsets[0].as_py()]
            kept = pa.ListArray.from_arrays(pa.array(at, pa.int32()), keys.flatten().filter(pa.array(may)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], kept, pa.array(bloom.may_hold(b.column(5).to_numpy(zero_copy_only=False)))], names)

    return rows.mapInArrow(run, StructType([*[rows.schema[c] for c in names[:5]], StructField("maybe_listed", BooleanType())]))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, listed for each row of pages.

    rules: host, path, verdict (path begins with "/"); listed: url, canonical URLs to block where no rule fits.
    The longest fitting rule wins. Both lists stand in one Bloom filter, the rules' keys under another seed.
    """
    rule_rows = rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), F.char_length("path").alias("n"))
    lengths = sorted(r[0] for r in rule_rows.select("n").distinct().collect())  # at most the longest listed path
    rule_hash, url_hash = lambda c: F.xxhash64(F.lit("rule"), c), lambda c: F.xxhash64(F.lit("url"), c)
    rule_rows = stored(rule_rows.drop("n"), "rules")
    exact = stored(listed.select(F.col("url").alias("key")).distinct(), "listed")
    bloom = BlockedBloom.of(exact.select(url_hash(F.col("key")).alias("h")).union(rule_rows.select(rule_hash(F.col("rule")))))

    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("key", canonical(F.col("host"), F.col("path"))).withColumn("keys", rule_keys(F.col("host"), F.col("path"), lengths))
    rows = stored(sifted(rows, bloom, rule_hash, url_hash), "urls")

    ruled, free = rows.filter(F.size("keys") > 0), rows.filter(F.size("keys") == 0)
    longest = F.max(F.struct(F.char_length("rule").alias("n"), "rule", "rule_verdict")).alias("best")
    fits = ruled.select("host", "path", F.explode("keys").alias("rule")).distinct().join(hashed(rule_rows), "rule").groupBy("host", "path").agg(longest)
    fits = stored(fits.select("host", "path", "best.rule", "best.rule_verdict"), "fits")
    none = F.lit(None).cast("string")
    rows = ruled.join(hashed(fits), ["host", "path"], "left").unionByName(free.withColumn("rule", none).withColumn("rule_verdict", none)).drop("keys")
    on_list = rows.filter("maybe_listed").join(hashed(exact.withColumn("listed", F.lit(True))), "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    out = on_list.unionByName(rows.filter("not maybe_listed").withColumn("listed", F.lit(False)))
    verdict = F.coalesce("rule_verdict", F.when(F.col("listed"), "block").otherwise(default)).alias("verdict")
    return out.select("page_id", "host", "path", "rule", verdict, "listed")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list of blocked URLs: canonical URLs of the pages whose page_id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    chosen = pages.filter("page_id % 50 = 0")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    listed = chosen.select(canonical(host, path).alias("url"), host.alias("host")).filter("host <> ''").select("url")
    return judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string"), listed)


_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = r"regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1)"
_RULES = " union all ".join(f"select '{h}' as h, '{p}' as p, '{v}' as v" for h, p, v in RULES)
SQL = rf"""
with p as (select page_id, {_HOST} as host, {_PATH} as path from pages),
c as (select *, host || regexp_replace(path, '(\.html|/+)\z', '') as key, row_number() over () as rn from p),
r as ({_RULES}),
f as (select rn, arg_max(h || p, length(h || p)) as rule, arg_max(v, length(h || p)) as v
      from c join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rn),
l as (select distinct key from c where page_id % 50 = 0 and host <> '')
select c.page_id, c.host, c.path, f.rule, c.key in (select key from l) and c.host <> '' as listed,
  coalesce(f.v, case when c.key in (select key from l) then 'block' else 'allow' end) as verdict
from c left join f using (rn)
"""
