"""Cross-entropy difference: loss under a target model less loss under a background model, per word.

Both are bigram models over one vocabulary with the same smoothing; they differ only in the counts: those of the target
documents, and those of all documents. The models hold every word and every bigram of the corpus, however rare, and grow with it.
A document is scored by what the other documents hold: its own counts are taken from both models first.

    p(word) = (count(word) + 1) / (words + V + 1)                     V: different words
    p(word | before) = (count(before, word) + PRIOR p(word)) / (count(before) + PRIOR)

Words are [^\\x20\\x09-\\x0D]+ with A-Z as a-z, known by 64-bit hashes. A boundary stands before and after the words of a document
and counts as one word. A negative score is nearer to the target.

The counts never meet in one place. Documents are dealt to chunks of bounded size. A chunk asks for each of its different words and
bigrams once, with its own counts; what it asks is dealt to buckets by ranges of the hash, so a word of every document costs a bucket one
number a chunk. A bucket sums them up and answers with what the other chunks hold, in the order of the question. The chunk then has all counts that its
documents need. Nothing is broadcast, and no task holds more than a chunk or a bucket.

There is a bucket for every eight chunks, so if each chunk wrote to each bucket, messages would grow with the square of the input. A
node writes to FAN ranges at most: beyond FAN buckets, chunks write in groups to nodes that hold a part of the hash range, sum up what a group asks, and ask
on in finer ranges; answers come back the same way. Messages are then FAN a chunk and level, and levels grow with the logarithm of the input.

Edge cases: a null or empty text, or one of white space, has no words, losses 0 and score 0, and is no part of a model.
Repeated rows are counted and scored each; of a doc_id that stands among the target's, all rows are in the target; null ids never are.
Without target documents the target model is the uniform one. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import stored, table
from slidejobs.llm.bpe import slices

PRIOR = 4.0
CHUNK_BYTES = 3 << 20  # of text in a chunk, about
BOUNDARY = np.int64(0x5DEECE66D1CE4E5B)  # stands for a document's start and end
STEP = np.uint64(0x9E3779B97F4A7C15)
ALL = np.array([0x2545F4914F6CDD1D], np.uint64)  # the key under which all words are counted
FAN = 1024  # ranges that a chunk or node writes to
ASKED = "bucket long, chunk long, keys binary, n binary, t binary"  # chunk: who asks, a chunk or a node
ANSWERED = "chunk long, bucket long, n binary, t binary"
SCORED = "doc_id long, n_words long, loss_target double, loss_background double, score double"


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more than texts)."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    code = words.filter(pa.array(~blank)).dictionary_encode()
    h = pd.util.hash_array(np.array(code.dictionary.to_pylist() or [""], object), categorize=False).view(np.int64)
    return h[code.indices.to_numpy()], at - np.r_[0, np.cumsum(blank)][at]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def planes(x: np.ndarray) -> bytes:
    """Long integers, byte by byte: of small ones seven eighths are a run of zeros."""
    return x.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


class Chunk:
    """The words and bigrams of some documents: of each event its document, bigram, word before and word, as places in `keys`."""

    def __init__(self, rows: pa.Table):
        """rows: doc_id, text and target; rows with target set give only an id that belongs to the target."""
        named = rows.column("target").to_numpy()
        targets = rows.filter(pa.array(named)).column("doc_id").to_numpy()
        docs = rows.filter(pa.array(~named))
        self.ids = pa.concat_arrays([pa.array([], pa.int64()), *docs.column("doc_id").chunks])
        self.target = np.isin(self.ids.fill_null(0).to_numpy(zero_copy_only=False), targets) & self.ids.is_valid().to_numpy(zero_copy_only=False)
        words, sizes = [], []
        for texts in docs.column("text").chunks:
            for part in slices(texts):
                h, at = word_hashes(texts[part])
                words.append(h)
                sizes.append(np.diff(at))
        h, self.n_words = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, sizes))
        events = np.where(self.n_words > 0, self.n_words + 1, 0)
        self.of = np.repeat(np.arange(len(events)), events)  # each event's document
        last = np.cumsum(events)[events > 0] - 1
        is_end = np.zeros(len(self.of), bool)
        is_end[last] = True
        w = np.empty(len(self.of), np.int64)
        w[is_end], w[~is_end] = BOUNDARY, h
        before = np.r_[BOUNDARY, w[:-1]] if len(w) else w  # what stands before a first word is the last document's boundary
        w, before = w.view(np.uint64), before.view(np.uint64)
        word, pair = mix(w), mix(before * STEP + ((w << np.uint64(31)) | (w >> np.uint64(33))))
        self.keys, place = np.unique(np.concatenate([word, pair, ALL]), return_inverse=True)
        self.word, self.pair, self.all = place[: len(w)], place[len(w) : -1], place[-1]
        self.before = np.r_[self.word[last[:1]], self.word[:-1]] if len(w) else self.word

    def prepare(self) -> None:
        self.owned = [self.own(x, y) for x, y in ((self.pair, self.pair), (self.before, self.word), (self.word, self.word))]

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key: how often it is here, and in documents of the target. One key counts all words."""
        of_target = self.target[self.of].astype(float)
        both = lambda x: (np.bincount(x, minlength=len(self.keys)), np.bincount(x, of_target, minlength=len(self.keys)).astype(np.int64))
        (a, at), (b, bt), (c, ct) = both(self.word), both(self.pair), both(np.full(len(self.of), self.all))
        return a + b + c, at + bt + ct

    def own(self, place: np.ndarray, counted: np.ndarray) -> np.ndarray:
        """How often the document of each event holds places[i] among what was counted."""
        wide = np.int64(len(self.keys) + 1)
        held, times = np.unique(self.of * wide + counted, return_counts=True)
        at = np.minimum(np.searchsorted(held, self.of * wide + place), max(len(held) - 1, 0))
        return np.where(held[at] == self.of * wide + place, times[at], 0) if len(held) else np.zeros(0, np.int64)

    def losses(self, n: np.ndarray, member: np.ndarray, size: int) -> np.ndarray:
        """Mean loss of each document under the model with counts n of the keys; member: the document is part of it."""
        less = member[self.of].astype(np.int64)
        pair, before, word = (n[x] - less * own for x, own in zip((self.pair, self.before, self.word), self.owned, strict=True))
        rest = n[self.all] - less * np.bincount(self.of, minlength=len(member))[self.of]
        p = (word + 1) / (rest + size + 1)
        loss = -np.log((pair + PRIOR * p) / (before + PRIOR))
        return np.bincount(self.of, loss, minlength=len(self.n_words)) / (self.n_words + 1)


def spread(docs: DataFrame, target_ids: DataFrame, chunks: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """chunk, doc_id, text, target: the rows of docs (target false), and the ids of the target (true) in the chunk of their documents."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.lit(False).alias("target"))
    ids = target_ids.select(F.col(target_ids.columns[0]).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit(True).alias("target")).filter("doc_id is not null")
    chunk = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(chunks)).cast("long")
    return rows.unionByName(ids).select(chunk.alias("chunk"), "doc_id", "text", "target")


def sizes(docs: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Different words of all documents, the boundary among them (by HyperLogLog, 0.5 %: it stands in the smoothing only), and bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(0)):
                w = pa.array(np.unique(word_hashes(b.column(0)[part])[0]))
                yield pa.RecordBatch.from_arrays([w, pa.array(np.zeros(len(w), np.int64))], ["w", "bytes"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([pc.sum(pc.binary_length(b.column(0)[part])).as_py()])], ["w", "bytes"])

    words = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "w long, bytes long")
    different, total = words.agg(F.approx_count_distinct("w", 0.005), F.sum("bytes")).first()
    return different + 1, total or 0


def levels_of(chunks: int, fan: int = FAN) -> tuple[int, int]:
    """Levels, and ranges that a node writes to on each: together as many buckets as there are chunks for, or a few more."""
    buckets = max(min(chunks, 64), chunks // 8)
    levels = 1
    while fan**levels < buckets:
        levels += 1
    ways = 1
    while ways**levels < buckets:
        ways += 1
    return levels, ways


def questions(who: int, group: int, lane: int, level: int, levels: int, ways: int, keys: np.ndarray, n: np.ndarray, t: np.ndarray) -> pa.Table:
    """What `who` asks on a level (1..): its sorted keys, all in range `lane` of the level before, dealt to finer ranges. On the last level all groups meet."""
    lanes = ways**level
    mine = np.arange(lane * ways, (lane + 1) * ways + 1, dtype=np.uint64)
    ends = np.searchsorted((keys >> np.uint64(32)) * np.uint64(lanes) >> np.uint64(32), mine)
    first = (0 if level == levels else group // ways) * lanes + lane * ways
    parts = [(first + i, slice(a, b)) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if a < b]
    sent = [(i, who, planes(np.diff(keys[s], prepend=np.uint64(0)).view(np.int64)), planes(n[s]), planes(t[s])) for i, s in parts]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, k) for c, k in zip(zip(*sent, strict=True) if sent else [()] * 5, kinds, strict=True)], ["bucket", "chunk", "keys", "n", "t"])


class Asked:
    """The questions that reached one bucket or node, summed up by key."""

    def __init__(self, asked: pa.Table):
        self.asked = asked
        keys = [np.cumsum(unplanes(x.as_buffer()).view(np.uint64)) for x in asked.column("keys")]
        self.keys, self.place = np.unique(np.concatenate(keys), return_inverse=True)
        self.cuts = np.cumsum([len(x) for x in keys])[:-1]
        self.own = [np.concatenate([unplanes(x.as_buffer()) for x in asked.column(c)]) for c in ("n", "t")]
        self.sums = [np.bincount(self.place, x, minlength=len(self.keys)).astype(np.int64) for x in self.own]

    def answers(self, others: list[np.ndarray]) -> pa.Table:
        """What each asker's keys count elsewhere, if all askers of this node together get `others`; mostly nothing."""
        cols = [pa.array([planes(x) for x in np.split((s + o)[self.place] - own, self.cuts)], pa.binary()) for s, o, own in zip(self.sums, others, self.own, strict=True)]
        return pa.table([self.asked.column("chunk"), self.asked.column("bucket"), *cols], ["chunk", "bucket", "n", "t"])


def answered(answers: pa.Table) -> list[np.ndarray]:
    """Counts n and t of a node's keys, in their order."""
    answers = answers.sort_by("bucket")
    return [np.concatenate([unplanes(x.as_buffer()) for x in answers.column(c)]) for c in ("n", "t")]


def exchange(asked: DataFrame, level: int, levels: int, ways: int) -> DataFrame:
    """Answers to the questions of a level."""
    if level == levels:
        return asked.groupBy("bucket").applyInArrow(lambda rows: Asked(rows).answers([0, 0]), ANSWERED)

    def ask_on(rows: pa.Table) -> pa.Table:
        node, a = rows.column("bucket")[0].as_py(), Asked(rows)
        return questions(node, *divmod(node, ways**level), level + 1, levels, ways, a.keys, *a.sums)

    asked = stored(asked, "questions")  # needed on the way there and back
    answers = exchange(asked.groupBy("bucket").applyInArrow(ask_on, ASKED), level + 1, levels, ways)
    return asked.groupBy("bucket").cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, answers: Asked(rows).answers(answered(answers)), ANSWERED)


def scores(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score of each row of docs; target_ids: one column of ids."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    size, total = sizes(docs, text_col)
    chunks = total // chunk_bytes + 1
    levels, ways = levels_of(chunks, fan)
    rows = spread(docs, target_ids, chunks, id_col, text_col)

    def ask(rows: pa.Table) -> pa.Table:
        c, chunk = Chunk(rows), rows.column("chunk")[0].as_py()
        return questions(chunk, chunk, 0, 1, levels, ways, c.keys, *c.counts())

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        c = Chunk(rows)
        n, t = (own + x for own, x in zip(c.counts(), answered(answers), strict=True))
        c.prepare()
        target, background = c.losses(t, c.target, size), c.losses(n, np.ones(len(c.target), bool), size)
        return pa.table([c.ids, pa.array(c.n_words), pa.array(target), pa.array(background), pa.array(target - background)], ["doc_id", "n_words", "loss_target", "loss_background", "score"])

    answers = exchange(rows.groupBy("chunk").applyInArrow(ask, ASKED), 1, levels, ways)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled as good; background: all documents."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
