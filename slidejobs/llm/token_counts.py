"""Token counts behind a digest cache.

The cache is a Parquet table: tokenizer-version digest, content digest, n_tokens. Every text gets a digest of its
normalised content, where normalising is what the tokenizer itself does before it splits, so equal digests have equal
counts. Digests are joined to the cache; of those that miss, one row each is encoded, and the counts are appended.

A text is counted as the sum of its words where the vocabulary allows that: no piece holds the word mark after
another character, so no merge crosses into a word's mark. Otherwise the whole text is encoded.

Edge cases: a null text counts as empty: 0 tokens. Rows with equal texts are counted each and encoded once (with its
copies, if the very row is repeated with its doc_id). Null ids are counted like others. Empty tables and empty
caches give no rows and no hits. Extra columns are ignored. Parts of the cache that a failed job appended twice hold
equal counts and are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import new_path, stored, table
from slidejobs.llm.bpe import slices

MARK = "▁"
CACHE = "tokenizer binary, digest binary, n_tokens long"

MISSES = 1_000_000  # rows of some 60 bytes that a task may hold to be joined with


class PieceCounter:
    """Counts of a sentencepiece model. One per Python worker."""

    loaded: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.version = hashlib.sha256(f.read() + b"sentencepiece " + sentencepiece.__version__.encode()).digest()
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "a  b ﬁ É\t\n½ 　x"
        plain = self.model.normalize(probe) == MARK + probe.replace(" ", MARK)
        #: The normaliser adds the first mark and turns spaces into marks, nothing else; marks stand at the start of pieces only.
        self.by_word = plain and not any(MARK in p.lstrip(MARK) for p in names)

    @classmethod
    def at(cls, path: str) -> PieceCounter:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def whole(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)] if texts else []

    def count(self, texts: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.array(self.whole(texts.to_pylist()), np.int64)
        # spaces at an end or beside each other, the mark itself and control strings: the whole text
        odd = pc.match_substring_regex(texts, "^ |  | $|[▁\\x00]|<")
        out = np.zeros(len(texts), np.int64)
        mask = odd.to_numpy(zero_copy_only=False)
        out[mask] = self.whole(texts.filter(odd).to_pylist())
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        words = split.flatten().dictionary_encode()
        if len(words):
            each = np.array(self.whole(words.dictionary.to_pylist()), np.int64)
            ends = np.r_[0, np.cumsum(each[words.indices.to_numpy()])]
            out[~mask] = np.diff(ends[split.offsets.to_numpy() - split.offsets[0].as_py()])
        return out


def content_digest(text):
    """SHA-256 of the text as the tokenizer sees it. The model's normaliser keeps every character but the space, which
    becomes the mark, so both are one."""
    return F.unhex(F.sha2(F.replace(text, F.lit(" "), F.lit(MARK)), 256))


def count_tokens(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs. cache: folder of the cache table, made if need be."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    version = PieceCounter.at(path).version
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))  # null ids are spread by their texts
    digests = stored(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), content_digest(F.col("text")).alias("digest")), "digests")

    def known() -> DataFrame:
        held = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == F.lit(version))
        return held.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    first = digests.groupBy("digest").agg(F.min("key").alias("first"))
    misses = stored(first.join(known(), "digest", "left_anti").withColumnRenamed("digest", "wanted"), "misses")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.at(path)
        for b in batches:
            for part in slices(b.column(1)):
                n = counter.count(b.column(1)[part])
                yield pa.RecordBatch.from_arrays([pa.array([version] * len(n), pa.binary()), b.column(0)[part], pa.array(n)], ["tokenizer", "digest", "n_tokens"])

    # texts meet the misses by id, at every size; a hash join need not sort texts, while each task builds a table of a bounded number of misses
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = misses.hint("shuffle_hash") if misses.count() <= MISSES * tasks else misses
    text_of = rows.join(wanted, F.col("key") == F.col("first"))
    text_of = text_of.filter(content_digest(F.col("text")) == F.col("wanted")).select("wanted", "text")
    text_of.mapInArrow(run, CACHE).write.mode("append").parquet(cache)
    counts = stored(known(), "counts")  # apart from the join, so that a digest of many rows can be split there
    return digests.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def piece_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first, so that the whole table is counted."""
    return count_tokens(table(spark, sf_dir, "documents"), piece_bpe(), new_path(spark, "token-cache"))
