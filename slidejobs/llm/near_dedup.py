"""MinHash near-dedup by a signature-coordinate inverted join.

Every document has a set of word shingles (64-bit hashes) and a signature of COORDS minimal hashes. Documents are posted
under their coordinate-value pairs. Two documents are candidates if at least `match_threshold` coordinates are equal; that
threshold lies so far below the wanted similarity that a true pair misses it with a chance of 1e-7 at most. Two documents with
that many equal pairs share one among the rarest of each (prefix filter, pairs in the order of their frequency), so only those
are posted; pairs that stand alone are skipped, and with them most documents.

A posting list is never expanded into its pairs. Its members meet one leader (the smallest id), and a list whose members are
one component by then is closed. Short lists (PAIRS members at most) that are still open let members of different components meet.
Documents of longer open lists are posted again, under the rarest shingles of their full sets: as many as a partner must share
at least one of. Each posting knows how many shingles of its document are rarer, which bounds the size of any partner from
both sides, so members of the smaller components meet only members of a size that can still reach the similarity. Copies of one
text that differ in words of their own fall out there, since their own words fill the prefix.

Candidates that keep the match threshold and a bound on the size of the difference of both sets (from parity bitmaps, never too
strict) are confirmed on the full sets. Documents with equal sets are one class from the start, and only the class is
posted. Lists that many documents share are joined by broadcast; there are at most HEAVY of them, for each document has a
bounded number of postings.

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with nothing. A text of fewer
words than a shingle is one shingle of all its words. Rows that repeat a doc_id with its text get one row each, with the same
component; a doc_id that several texts share has a component for each text. A null doc_id is linked like any other, but never
names a component unless no other id is in it: then component_id is null and the row is kept. An empty table gives no rows.
Extra columns are ignored, whatever their names; where rows are
returned they keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.components import connected_components
from slidejobs.functions.storage import small, stored, table
from slidejobs.llm.bpe import over_texts, slices
from slidejobs.llm.names import unused

COORDS, BITS = 64, 1024
PAIRS = 16  # members of an open list up to which different components meet directly
HEAVY, LONG = 100_000, 64  # lists that may be broadcast; the shortest that are
BATCH = 1 << 22  # bytes of texts or sets that a task is given at once, or one row
CELL = 1.1  # sizes in one cell differ by this factor at most
NO_ID = 1 << 62  # nodes from here on stand for rows without an id of their own
_rng = np.random.default_rng(20240229)
MULTIPLY = _rng.integers(0, 2**63, COORDS, np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(0, 2**63, COORDS, np.uint64)
STEP, SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA24BAED4963EE407)


def match_threshold(coords: int, percent: int, miss: float = 1e-7) -> int:
    """The most equal coordinates that may be asked for, if a pair of that similarity shall miss them with a chance of `miss` at most."""
    p, chance = percent / 100, 0.0
    for t in range(coords + 1):
        chance += comb(coords, t) * p**t * (1 - p) ** (coords - t)
        if chance > miss:
            return max(t, 1)
    return coords


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    at = split.offsets.to_numpy().astype(np.int64)
    at = at - at[0] if len(at) else np.zeros(1, np.int64)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    at = at - np.r_[0, np.cumsum(blank)][at]
    code = words.filter(pa.array(~blank)).dictionary_encode()
    names = np.array(code.dictionary.to_pylist() or [""], object)
    h = pd.util.hash_array(names, categorize=False)[code.indices.to_numpy()]
    rolled = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = rolled * STEP + h[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif a == b:
            out.append(np.zeros(0, np.uint64))
        else:
            one = SHORT
            for x in h[a:b]:
                one = np.uint64((int(one) * int(STEP) + int(x)) & (2**64 - 1))
            out.append(mix(np.array([one])))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(COORDS, 2**32 - 1, np.uint32)
    for i in range(0, len(s), 1024):
        low = np.minimum(low, ((s[i : i + 1024, None] * MULTIPLY + ADD) >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return low


def parity(s: np.ndarray) -> bytes:
    return np.packbits((np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def bound_batches(spark: SparkSession) -> None:
    """From here on a batch has 1,000 rows at most, and no more than BATCH bytes if it has several: sets of long texts are as large as the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def with_nodes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: the id, or for rows with a null or repeated id a number from id and text."""
    own, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    node = unused(docs.columns, "_node")
    again = unused([*docs.columns, node], "_again")
    twice = stored(docs.select(own.alias(again)).filter(F.col(again).isNotNull()).groupBy(again).count().filter("count > 1").select(again), "repeated-ids")
    named = F.lit(NO_ID) + F.xxhash64(own, text).bitwiseAND(NO_ID // 2 - 1)
    if (n := twice.count()) == 0:
        return docs.withColumn(node, F.coalesce(own, named)), node
    both = docs.join(small(twice, count=n), own == F.col(again), "left")
    return both.withColumn(node, F.when(own.isNull() | F.col(again).isNotNull(), named).otherwise(own)).drop(again), node


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str, node_col: str) -> DataFrame:
    """doc_id, node, n, set_key, sig (COORDS ints), low (their last bytes), parity of each row."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(node_col).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "node", "n", "set_key", "sig", "low", "parity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b.column(2), 1 << 21):
                sets = shingle_sets(b.column(2)[part], k)
                sigs = np.stack([signature(s) for s in sets]).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sigs.size + 1, COORDS), pa.int32()), pa.array(sigs.ravel()))
                binary = lambda x: pa.array(x, pa.binary())
                key, low = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [r.tobytes() for r in sigs.astype(np.uint8)]
                cols = [b.column(0)[part], b.column(1)[part], pa.array([len(s) for s in sets], pa.int64()), binary(key), lists, binary(low), binary([parity(s) for s in sets])]
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, "doc_id long, node long, n long, set_key binary, sig array<int>, low binary, parity binary")


def may_link(n_a, n_b, low_a, low_b, bits_a, bits_b, matches: int, percent: int) -> np.ndarray:
    """Rows that keep the match threshold (by the last bytes of coordinates, which differ only where these do) and can be similar enough: |A xor B| * (100 + percent) <= (|A| + |B|) * (100 - percent)."""
    near = (low_a == low_b).sum(axis=-1) >= matches
    apart = np.bitwise_count(bits_a ^ bits_b).sum(axis=-1).astype(np.int64)
    apart = np.maximum(apart, np.abs(n_a - n_b))
    return near & (apart * (100 + percent) <= (n_a + n_b) * (100 - percent))


def _low(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, COORDS)


def _bits(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint64).reshape(-1, BITS // 64)


class NearDuplicates:
    """The search over one table of documents."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        self.k, self.percent, self.text_col = k, percent, text_col
        self.docs, self.node = with_nodes(docs, id_col, text_col)
        self.matches = match_threshold(COORDS, percent)
        self.rows = stored(sketches(self.docs, k, id_col, text_col, self.node), "sketches")
        self.reps = stored(self.rows.filter("n > 0").groupBy("set_key").agg(F.min("node").alias("rep"), F.min("doc_id").alias("first")), "classes")
        own = self.reps.select("set_key", F.col("rep").alias("node"))
        self.sketch = stored(self.rows.drop("doc_id").join(own, ["set_key", "node"], "left_semi").drop("set_key").dropDuplicates(["node"]), "representatives")
        self.heavy = max(self.sketch.count() * COORDS // HEAVY, LONG)  # no more than HEAVY pairs are held by more documents

    @staticmethod
    def joined(rows: DataFrame, lists: DataFrame, key: str, heavy: int) -> DataFrame:
        """rows with what lists say of their key. Lists of more than `heavy` rows by their count c are few: they are broadcast, and no task gets all rows of one."""
        few = F.broadcast(lists.filter(F.col("c") > heavy))
        on = [x for x in (key, "c") if x in rows.columns]
        if "c" in on:
            return rows.filter(F.col("c") > heavy).join(few, on).unionByName(rows.filter(F.col("c") <= heavy).join(lists.filter(F.col("c") <= heavy), on))
        return rows.join(few, on).unionByName(rows.join(few, on, "left_anti").join(lists.filter(F.col("c") <= heavy), on))

    def postings(self) -> DataFrame:
        """token, c, node: each document under its rarest pairs (held by c documents), as far as the prefix goes; pairs of one document are skipped."""
        pairs = self.sketch.select("node", F.posexplode("sig").alias("i", "v"))
        pairs = pairs.select("node", F.expr("shiftleft(cast(i as bigint), 32) | (cast(v as bigint) & 4294967295L)").alias("token"))
        often = stored(pairs.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "frequencies")
        shared = self.joined(pairs, often, "token", self.heavy).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "token"))).alias("t"))
        prefix = shared.filter(F.size("t") >= self.matches).select("node", F.explode(F.expr(f"slice(t, 1, size(t) - {self.matches - 1})")).alias("t"))
        return prefix.select("t.token", "t.c", "node")

    def screened(self, pairs: DataFrame) -> DataFrame:
        """Of pairs a, b those that may be links."""
        bound_batches(pairs.sparkSession)
        s = self.sketch
        side = lambda x: s.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "low", "parity")])
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "low_a", "low_b", "parity_a", "parity_b")
        matches, percent = self.matches, self.percent

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                c = b.columns
                ok = may_link(c[2].to_numpy(), c[3].to_numpy(), _low(c[4]), _low(c[5]), _bits(c[6]), _bits(c[7]), matches, percent)
                yield pa.RecordBatch.from_arrays(c[:2], ["a", "b"]).filter(pa.array(ok))

        return both.mapInArrow(run, "a long, b long")

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """node, s: the shingle hashes, as bytes, of the documents of nodes (_id)."""
        texts = self.docs.select(F.col(self.node).alias("node"), F.col(self.text_col).alias("text")).join(small(nodes), F.col("node") == F.col("_id"), "left_semi")
        k = self.k
        return stored(over_texts(texts, "node long, s binary", lambda i, t: [i, pa.array([s.tobytes() for s in shingle_sets(t, k)], pa.binary())], "node", "text").dropDuplicates(["node"]), name)

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Of pairs a, b those whose full sets are similar enough."""
        bound_batches(pairs.sparkSession)
        pairs = stored(pairs, "candidates")
        ids = stored(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("_id")), "involved")
        sets, percent = self.sets(ids, "sets"), self.percent
        both = pairs.join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return stored(both.mapInArrow(run, "a long, b long"), "links")

    def labelled(self, posts: DataFrame, links: DataFrame) -> DataFrame:
        """Postings (token, c, node, comp, g) of the lists that still hold several components; g: their length."""
        comp = connected_components(links)
        rows = stored(posts.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "labelled")
        lists = rows.groupBy("token", "c").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("g")).filter("lo <> hi").select("token", "c", "g")
        return stored(self.joined(rows, lists, "token", self.heavy), "open")

    def by_shingles(self, members: DataFrame) -> DataFrame:
        """Candidate pairs of different components among members (node, comp), by the rarest shingles of their full sets."""
        bound_batches(members.sparkSession)
        q = self.percent
        sets = self.sets(members.select(F.col("node").alias("_id")), "member-sets")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for node, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    s = np.frombuffer(s.as_buffer(), np.int64)
                    for i in range(0, len(s), 100_000):
                        part = s[i : i + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), node)), pa.array(np.full(len(part), len(s))), pa.array(part)], ["node", "n", "s"])

        shingles = stored(sets.mapInArrow(spread, "node long, n long, s long"), "shingles")
        often = stored(shingles.groupBy("s").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "frequencies")
        heavy = max(shingles.count() // HEAVY, LONG)
        t = self.joined(shingles, often, "s", heavy).groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("t"))
        # a partner shares one at least of the n - ceil(q n / 100) + 1 rarest; those of this document alone count, but need no posting
        t = t.withColumn("own", F.col("n") - F.size("t")).withColumn("room", F.col("n") - F.ceil(F.col("n") * q / 100) + 1 - F.col("own")).filter("room > 0")
        posts = t.select("node", "n", "own", F.posexplode(F.expr("slice(t, 1, cast(room as int))")).alias("i", "t"))
        posts = posts.select("node", "n", (F.col("own") + F.col("i")).alias("i"), "t.c", "t.s").join(members, "node")
        posts = stored(posts, "shingle-postings")
        # lists of one component are closed; in others all but the members of the largest look for partners
        lists = posts.groupBy("s", "c", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("s", "c").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"))
        posts = stored(self.joined(posts, lists.filter("comps > 1").drop("comps"), "s", heavy), "shingle-lists")
        cell = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(CELL))).cast("int")
        most = F.floor((F.col("n") - F.col("i")) * (100 + q) / q - F.col("n"))
        least = F.greatest(F.ceil(F.col("n") * q / 100), F.lit(1))
        x = posts.filter("comp <> largest").withColumn("most", most).filter(F.col("most") >= least).withColumn("cell", F.explode(F.sequence(cell(least), cell(F.col("most")))))
        x = x.select("s", "cell", F.col("node").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("i").alias("ix"))
        y = posts.select("s", cell(F.col("n")).alias("cell"), F.col("node").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("ny"), F.col("i").alias("iy"))
        fits = F.least(F.col("nx") - F.col("ix"), F.col("ny") - F.col("iy")) * (100 + q) >= (F.col("nx") + F.col("ny")) * q
        met = x.join(y, ["s", "cell"]).filter((F.col("cx") != F.col("cy")) & fits)
        return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def links(self) -> DataFrame:
        """Pairs a < b of class representatives that are similar enough: enough of them to join every component."""
        pair = lambda df: df.select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).filter("a <> b")
        posts = stored(self.postings(), "postings")
        lead = posts.groupBy("token", "c").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("g")).filter("g > 1").drop("g")
        met = pair(self.joined(posts, lead, "token", self.heavy)).groupBy("a", "b").count()  # counts of collisions among the rarest
        found = self.confirmed(self.screened(met.select("a", "b")))
        left = self.labelled(posts, found)
        if not left.take(1):
            return found
        few = left.filter(F.col("g") <= PAIRS).select("token", "node", "comp")
        met = few.join(few.select("token", F.col("node").alias("lead"), F.col("comp").alias("lead_comp")), "token").filter("node < lead and comp <> lead_comp")
        met = pair(met).distinct()
        members = stored(left.filter(F.col("g") > PAIRS).select("node", "comp").distinct(), "members")
        if members.take(1):
            met = met.union(self.by_shingles(members)).distinct()
        return found.union(self.confirmed(self.screened(met)))

    def result(self) -> DataFrame:
        """doc_id, node, n_shingles, component_id, kept for each row."""
        comp = connected_components(self.links())
        rep = self.reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", "first", F.coalesce("comp", "rep").alias("comp"))
        if self.rows.filter(F.col("node") >= NO_ID).take(1):  # a node is not always an id
            rep = stored(rep, "labels")
            smallest = rep.groupBy("comp").agg(F.min("first").alias("id"))
            rep = rep.join(smallest, "comp").select("set_key", F.col("id").alias("comp"))
        found = self.rows.select("doc_id", "node", "n", "set_key").join(rep.select("set_key", "comp"), "set_key", "left")
        smallest = F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id"))
        return found.select("doc_id", "node", F.col("n").alias("n_shingles"), smallest.alias("component_id"), smallest.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return NearDuplicates(docs, k, percent, id_col, text_col).result().drop("node")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one document of each component stays: the one with the smallest id, null last."""
    search = NearDuplicates(docs, k, percent, id_col, text_col)
    gone = stored(search.result().filter("not kept").select(F.col("node").alias(search.node)).distinct(), "near-copies")
    return search.docs.join(small(gone), search.node, "left_anti").drop(search.node)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
