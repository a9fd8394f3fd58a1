"""Phrases whose words stand together more often than apart: the share of the parts' occurrences that the phrase takes up.

Texts are cut into shards of bounded size. A shard numbers its words and sorts its suffixes by their first words by prefix doubling; suffixes that
share their first n words are an interval of the sorted array, found by the number of words that neighbours share (LCP), and the interval's
length is the count of that phrase. Counts of all shards are summed by phrase and language, as text, so they are exact.

Words and pairs are counted first. For each longer length the texts are read again, and a phrase is counted only if both of its phrases of one word
less can be candidates, as no phrase is more frequent than its parts. Those are known by a bit filter of bounded size (FILTER_BITS, 16 MB); where it is
too full to hold much back, more is counted and summed, and the result is the same.

Edge cases: a null text counts as empty; a null lang as `und`, and is one with texts that have that lang. Repeated rows count each; ids play no part.
Texts without words give nothing, as does an empty table; languages without candidates have no rows. A text is held whole by one task. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slidejobs.functions.storage import stored, table
from slidejobs.llm.bpe import slices
from slidejobs.llm.wordscan import SMALL, Blocks, byte_class, hashes, raw_bytes, words

LEAST, MOST_WORDS, TOP, PERCENT = 10, 3, 2000, 50
SHARD_BYTES = 2 << 20  # of text in a shard, about
AT_ONCE = 1 << 15  # phrases in a batch
PARTS = 64  # of a language when its best are looked for
FILTER_BITS = 27  # the filter has 2 to the power of this many bits
PIECE_BITS = 1 << 15  # in one row of the filter
GAP, END = 1, 2
CLASSES = byte_class(b" \t", GAP) | byte_class(b".,;:!?\n\x0b\x0c\r", END)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Shard:
    """Words of some texts: `word` and `lang` are places in `words` and `langs`, `left` is how many words its piece has from there on."""

    def __init__(self, parts: list[tuple[pa.Array, pa.Array]]):
        """parts: texts and their languages, none null."""
        strings, langs, joined = [], [], []
        code = pa.concat_arrays([x for _, x in parts]).dictionary_encode()
        self.langs, of, n = code.dictionary, code.indices.to_numpy(), 0
        for texts, _ in parts:
            data, at = raw_bytes(texts)
            cls = CLASSES[data]
            starts, sizes, text = words(cls == 0, at)
            offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            strings.append(pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOWER[data[cls == 0]])))
            ends = np.searchsorted(np.flatnonzero(cls & END), starts)
            joined.append(np.r_[(text[1:] == text[:-1]) & (ends[1:] == ends[:-1]), False][: len(starts)])
            langs.append(of[n + text])
            n += len(texts)
        code = pa.concat_arrays(strings).dictionary_encode()
        self.words, self.word = code.dictionary, code.indices.to_numpy()
        self.lang = np.concatenate(langs)
        last = np.flatnonzero(~np.concatenate(joined))
        here = np.arange(len(self.word))
        self.left = last[np.searchsorted(last, here)] - here + 1 if len(here) else here
        self.ids = self.word.astype(np.int64) * len(self.langs) + self.lang

    def suffixes(self, depth: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of the first words of what follows in the piece, `depth` of them at least, and how many of those each shares with the place before."""
        rank, length, n = self.ids, 1, len(self.ids)
        order = np.argsort(rank, kind="stable") if depth == 1 else np.arange(n)
        while length < depth:
            further = np.zeros(n, np.int64)
            more = self.left > length
            further[more] = rank[np.flatnonzero(more) + length] + 1
            key = rank * (rank.max(initial=0) + 2) + further
            length *= 2
            if length >= depth and keep is not None:
                key, order = key[keep], keep[np.argsort(key[keep], kind="stable")]
                break
            order = np.argsort(key, kind="stable")
            ranked = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]][:n])
        shared, open_ = np.zeros(len(order), np.int64), np.arange(1, len(order))
        for d in range(depth):
            a, b = order[open_ - 1], order[open_]
            open_ = open_[(self.left[a] > d) & (self.left[b] > d)]
            open_ = open_[self.ids[order[open_ - 1] + d] == self.ids[order[open_] + d]]
            shared[open_] = d + 1
        return order, shared

    def grams(self, lengths: range, keep: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        """key, n of every phrase with these numbers of words; a key is the phrase, a tab, and the language."""
        order, shared = self.suffixes(lengths[-1], keep)
        for n in lengths:
            begins = np.flatnonzero(shared < n)
            counts = np.diff(np.r_[begins, len(order)])
            first = order[begins]
            whole = self.left[first] >= n
            first, counts = first[whole], counts[whole]
            for i in range(0, len(first), AT_ONCE):
                f = first[i : i + AT_ONCE]
                phrase = [self.words.take(pa.array(self.word[f + d])) for d in range(n)]
                yield self.keyed(pc.binary_join_element_wise(*phrase, " ") if n > 1 else phrase[0], self.lang[f], counts[i : i + AT_ONCE])

    def totals(self) -> pa.RecordBatch:
        """The words of each language, under an empty phrase."""
        n = np.bincount(self.lang, minlength=len(self.langs))
        return self.keyed(pa.array([""] * len(n)), np.arange(len(n)), n)

    def keyed(self, phrase: pa.Array, lang: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.binary_join_element_wise(phrase, self.langs.take(pa.array(lang)), "\t"), pa.array(n.astype(np.int64))], ["key", "n"])

    def may_begin(self, n: int, bits: np.ndarray) -> np.ndarray:
        """Places of phrases of n words whose first and whose last n - 1 words the filter may hold."""
        places = np.flatnonzero(self.left >= n - 1)
        by_word, by_lang = string_hashes(self.words)[self.word], string_hashes(self.langs)[self.lang]
        slot = slots(phrase_hash([by_word[places + d] for d in range(n - 1)], by_lang[places]), 8 * len(bits))
        held = np.zeros(len(self.ids) + 1, bool)
        held[places] = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 != 0
        return np.flatnonzero((self.left >= n) & held[:-1] & held[1:])


def string_hashes(strings: pa.Array) -> np.ndarray:
    data, at = raw_bytes(strings)
    return hashes(Blocks(data), at[:-1], np.diff(at))


def phrase_hash(by_word: list[np.ndarray], by_lang: np.ndarray) -> np.ndarray:
    h = by_lang
    for w in by_word:
        h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def slots(h: np.ndarray, size: int) -> np.ndarray:
    """Places in a filter of `size` bits, a power of two."""
    return (h & np.uint64(size - 1)).astype(np.int64)


def over_shards(rows: DataFrame, count, shard_bytes: int) -> DataFrame:
    """key, n of count(shard) for shards of about that size of rows (text, lang)."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for s in slices(b.column(0), min(SMALL, shard_bytes)):
                held.append((b.column(0)[s], b.column(1)[s]))
                size += pc.sum(pc.binary_length(held[-1][0])).as_py()
                if size >= shard_bytes:
                    yield from count(Shard(held))
                    held, size = [], 0
        if held:
            yield from count(Shard(held))

    return rows.mapInArrow(run, "key string, n long")


def bit_filter(phrases: DataFrame, n: int, size: int) -> np.ndarray:
    """`size` bits, those of the phrases (phrase of n words, lang) set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = string_hashes(pc.split_pattern(b.column(0), " ").flatten()).reshape(-1, n)
            slot = slots(phrase_hash(list(each.T), string_hashes(b.column(1))), size)
            yield pa.RecordBatch.from_arrays([pa.array(slot // PIECE_BITS), pa.array(slot % PIECE_BITS)], ["piece", "at"])

    pieces = phrases.select("phrase", "lang").mapInArrow(run, "piece long, at long").groupBy("piece").agg(F.bitmap_construct_agg("at").alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for piece, bits in zip(*[c.to_pylist() for c in pieces.toArrow().columns], strict=True):  # 4,096 rows at most
        out[piece * (PIECE_BITS // 8) :][: len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, shard_bytes: int = SHARD_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """lang, phrase, words, f of every phrase of up to most_words words that occurs `least` times or more; the phrase without words has the count of all words."""
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    spark = docs.sparkSession

    def summed(grams: DataFrame) -> DataFrame:
        out = grams.groupBy("key").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | F.startswith("key", F.lit("\t")))
        phrase = F.substring_index("key", "\t", 1)
        n = F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))
        return stored(out.select(F.expr("substring(key, locate('\t', key) + 1)").alias("lang"), phrase.alias("phrase"), n.alias("words"), "f"), "phrases")

    def first(shard: Shard) -> Iterator[pa.RecordBatch]:
        yield shard.totals()
        yield from shard.grams(range(1, min(most_words, 2) + 1))

    out = summed(over_shards(rows, first, shard_bytes))
    last = out
    for n in range(3, most_words + 1):
        bits = spark.sparkContext.broadcast(bit_filter(last.filter(F.col("words") == n - 1), n - 1, 1 << filter_bits))
        last = summed(over_shards(rows, lambda s, n=n, bits=bits: s.grams(range(n, n + 1), s.may_begin(n, bits.value)), shard_bytes))
        out = out.unionByName(last)
    return out


def score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)), exactly."""
    d = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * d(a) * d(a), d(l) * d(r))


def collocations(counts: DataFrame, top: int = TOP, percent: int = PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the `top` candidates of each language. counts: as phrase_counts gives them.

    A candidate (two words at least) is cut after each of its words; l and r are the counts of both sides where the score is lowest. It is dropped if a longer
    one holds it that occurs in `percent` of its places or more.
    """
    all_ = counts.filter("words > 0").select("lang", "phrase", "words", F.col("f").alias("a"))
    candidates = all_.filter("words > 1")
    cuts = candidates.withColumn("k", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - words)")})
    side = lambda name, c: all_.select("lang", F.col("phrase").alias(name), F.col("a").alias(c))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    lowest = F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest)
    parts = F.expr("flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    longer = candidates.filter("words > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").filter(f"100 * coalesce(longer, 0) < {percent} * a")
    ranked = lambda rows, *keys: rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")).cast("long")).filter(F.col("rank") <= top)
    # the best of a language are among the best of its parts, so that what meets in the end is bounded
    best = ranked(ranked(kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part"), "lang").drop("part")
    n = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return best.join(n, "lang").select("lang", "rank", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(phrase_counts(table(spark, sf_dir, "documents")))


SQL = r"""
with t as (select row_number() over () as r, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select r, lang, unnest(g) as piece, generate_subscripts(g, 1) as i from (select r, lang, string_split_regex(text, '[.,;:!?\x0A-\x0D]') as g from t)),
w as (select r, lang, i, unnest(ws) as w, generate_subscripts(ws, 1) as j from (select r, lang, i, regexp_extract_all(piece, '[^\x20\x09]+') as ws from p)),
s as (select lang, w as w1, lead(w, 1) over x as w2, lead(w, 2) over x as w3 from w window x as (partition by r, i order by j)),
u as (select lang, w1 as phrase, 1 as words, count(*) as f from s group by 1, 2),
b as (select lang, w1 || ' ' || w2 as phrase, w1, w2, count(*) as f from s where w2 is not null group by all having count(*) >= 10),
c as (select lang, w1 || ' ' || w2 || ' ' || w3 as phrase, w1, w2, w3, count(*) as f from s where w3 is not null group by all having count(*) >= 10),
cuts as (
  select b.lang, b.phrase, b.f as a, 1 as k, l.f as l, r.f as r from b join u l on l.lang = b.lang and l.phrase = w1 join u r on r.lang = b.lang and r.phrase = w2
  union all select c.lang, c.phrase, c.f, 1, l.f, r.f from c join u l on l.lang = c.lang and l.phrase = w1 join b r on r.lang = c.lang and r.w1 = c.w2 and r.w2 = c.w3
  union all select c.lang, c.phrase, c.f, 2, l.f, r.f from c join b l on l.lang = c.lang and l.w1 = c.w1 and l.w2 = c.w2 join u r on r.lang = c.lang and r.phrase = c.w3),
sc as (select *, cast(1000000::hugeint * a * a // (l::hugeint * r) as bigint) as score from cuts),
best as (select lang, phrase, a, arg_min({'k': k, 'l': l, 'r': r}, (score, k)) as x, min(score) as score from sc group by 1, 2, 3),
longer as (select lang, phrase, max(f) as f from (select lang, w1 || ' ' || w2 as phrase, f from c union all select lang, w2 || ' ' || w3, f from c) group by 1, 2),
kept as (select best.* from best left join longer using (lang, phrase) where 100 * coalesce(longer.f, 0) < 50 * a),
n as (select lang, cast(sum(f) as bigint) as n from u group by 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select lang, cast(rank as bigint) as rank, phrase, a, x.l as l, x.r as r, n, score from ranked join n using (lang) where rank <= 2000
"""
