"""Quality scores by Bradley-Terry pairwise ranking.

A document is a vector of shape features (letters, symbols, word lengths, repeats, lines). Preference pairs join a
labelled good document with a labelled bad one; the model is a linear score whose difference gives the log odds that
the first is preferred, fitted by logistic loss on feature differences. The cut is the quantile of the labelled
documents' scores at the labelled share of bad ones; scores are mapped to 0..1 so that the cut falls on the threshold.

The fit reads every labelled row but those of the held-out fold. These rows are dealt by the hash of their doc_id into groups;
a group holds rows of both labels (of the rarer one a part that several groups share), and in it every row meets rows of the other
label. Moments and the sums of each Newton step are taken group by group and added up on the driver, always in the same order. The cut is exact
as well: it stands in the middle between the two labelled scores of which as many lie below as there are bad labels. Features and scores cover all rows and whole texts.

Edge cases: a null or empty text has all features 0 and is scored like any other. Repeated rows are scored each. A label
that is null, or rows without a label, teach nothing; of repeated labels of a doc_id all count. If one of the labels is
missing, all weights are 0 and all scores equal the threshold. A null doc_id has no label and is not held out; its
row is scored like any other. An empty table gives no rows. Extra columns are ignored, whatever their names; accepted() keeps them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidejobs.functions.storage import BROADCAST_ROWS, stored, table
from slidejobs.llm.bpe import over_texts, slices

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7
GROUP, FEW = 4096, 32  # rows that a group has about of the more frequent label; of the other at least
CELLS = 1024  # groups at most, for the sums of each come to the driver; beyond, groups grow
MOST = 100_000  # scores that are ranked on the driver
CLASSES = {
    "letter": [*range(65, 91), *range(97, 123), *range(128, 256)], "upper": range(65, 91), "digit": range(48, 58), "line": [10, 13], "space": [9, 11, 12, 32],
    "stop": b".!?", "comma": b",;:", "bar": b"|", "sign": b"#$%&*+=<>@^~\\/{}[]_", "quote": b"\"'`()-",
}
NAMES = [*CLASSES, "chars", "words", "word_mean", "word_spread", "short", "long", "distinct", "top_word", "repeat", "per_line", "stop_words", "byte_entropy", "rare_bytes"]


def features(texts: pa.Array) -> np.ndarray:
    """One row of len(NAMES) numbers for each text (no nulls)."""
    n = len(texts)
    raw = texts.cast(pa.large_string())
    cuts = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    hist = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]).astype(float) if n else np.zeros((0, 256))
    total = np.maximum(hist.sum(axis=1), 1)
    share = hist / total[:, None]
    out = [share[:, list(c)].sum(axis=1) for c in CLASSES.values()]
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten()
    at = split.offsets.to_numpy().astype(np.int64)
    at -= at[0] if len(at) else 0
    full = words.filter(pc.not_equal(words, ""))
    blank = np.r_[0, np.cumsum(pc.equal(words, "").to_numpy(zero_copy_only=False))] if len(words) else np.zeros(1, np.int64)
    at = at - blank[at]
    k = np.diff(at)
    many = np.maximum(k, 1)
    size = pc.utf8_length(full).to_numpy().astype(float) if len(full) else np.zeros(0)
    each = lambda v: np.diff(np.r_[0, np.cumsum(v)][at]) / many
    mean = each(size)
    code = full.dictionary_encode().indices.to_numpy().astype(np.int64) if len(full) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(n), k)
    pair, times = np.unique(doc << 32 | code, return_counts=True)
    whose = pair >> 32
    top = np.zeros(n)
    np.maximum.at(top, whose, times)
    same = np.r_[False, (code[1:] == code[:-1]) & (doc[1:] == doc[:-1])] if len(code) else np.zeros(0, bool)
    ends = pc.match_substring_regex(full, r"[.!?]$").to_numpy(zero_copy_only=False) if len(full) else np.zeros(0, bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(share > 0, share * np.log(share), 0), axis=1)
    out += [
        np.log1p(hist.sum(axis=1)), np.log1p(k), mean, np.sqrt(np.maximum(each(size**2) - mean**2, 0)), each(size <= 3), each(size > 12), np.bincount(whose, minlength=n) / many,
        top / many, each(same), np.log1p(k / (hist[:, 10] + 1)), each(ends), entropy, share[:, [*range(0, 9), *range(14, 32), 127]].sum(axis=1),
    ]
    return np.stack(out, axis=1) if n else np.zeros((0, len(NAMES)))


def expand(x: np.ndarray) -> np.ndarray:
    """Features with their squares: both too much and too little of one can be bad."""
    return np.concatenate([x, x * x], axis=1)


class Model:
    def __init__(self, centre: np.ndarray, scale: np.ndarray, weights: np.ndarray, cut: float, threshold: float):
        self.centre, self.scale, self.weights, self.cut, self.threshold = centre, scale, weights, cut, threshold

    def expanded(self, x: np.ndarray) -> np.ndarray:
        return expand(np.clip((x - self.centre) / self.scale, -8, 8))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.expanded(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.raw(x) - self.cut + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def pair_sums(good: np.ndarray, bad: np.ndarray, w: np.ndarray, pairs: int, step: int = 1 << 15) -> np.ndarray:
    """Number, gradient and Hessian, in a row, of the logistic loss of preference pairs; row i of either label meets `pairs` rows of the other."""
    out = np.zeros(1 + len(w) + len(w) ** 2)
    n = max(len(good), len(bad)) * pairs if len(good) and len(bad) else 0
    for j in range(0, n, step):
        i = np.arange(j, min(j + step, n))
        diff = good[i % len(good)] - bad[(i * 7919 + i // len(good)) % len(bad)]
        p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))  # of the wrong order
        out += np.concatenate([[len(i)], -(diff.T @ p), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])
    return out


def newton(sums: Callable[[np.ndarray], np.ndarray], rounds: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Weights of the least loss; sums(w) gives pair_sums over all pairs."""
    w = np.zeros(2 * len(NAMES))
    for _ in range(rounds):
        n, grad, hess = np.split(sums(w), [1, 1 + len(w)])
        step = np.linalg.solve(hess.reshape(len(w), -1) / n + ridge * np.eye(len(w)), grad / n + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, good: np.ndarray, pairs: int = 8, rounds: int = 25, ridge: float = 1e-3, threshold: float = THRESHOLD) -> Model:
    """The model of rows that are all here; learn() does the same over a table."""
    model = Model(x.mean(axis=0), x.std(axis=0) + 1e-9, np.zeros(2 * len(NAMES)), 0.0, threshold) if len(x) else flat(threshold)
    if not 0 < (n := int((good == 0).sum())) < len(good):
        return model
    z = model.expanded(x)
    model.weights = newton(lambda w: pair_sums(z[good == 1], z[good == 0], w, pairs), rounds, ridge)
    model.cut = float(np.sort(model.raw(x))[n - 1 : n + 1].mean())
    return model


def flat(threshold: float) -> Model:
    """All scores equal the threshold."""
    return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), np.zeros(2 * len(NAMES)), 0.0, threshold)


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, features binary (doubles) of each row."""
    return over_texts(docs, "doc_id long, features binary", lambda ids, texts: [ids, pa.array([r.tobytes() for r in features(texts)], pa.binary())], id_col, text_col)


def fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def matrix(data) -> np.ndarray:
    return np.frombuffer(data, float).reshape(-1, len(NAMES))


def most_groups(cells: np.ndarray, rows: int) -> int:
    """The largest power of two that the cells (a power of two) fold to, so that groups have `rows` rows on the average and none is empty."""
    n = len(cells)
    while n > 1 and (n * rows > cells.sum() or (cells.reshape(-1, n).sum(axis=0) == 0).any()):
        n //= 2
    return n


def grouped(rows: DataFrame) -> DataFrame | None:
    """group, parts, rarer, good, bad for rows of doc_id, quality, features: the features of a group's rows of either label, one after the other.
    Of the rarer label (its quality is given) group g has part g modulo parts, so that each row is first met in a group below parts. Nothing if a label is missing."""
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(CELLS))
    cells = np.zeros((2, CELLS), np.int64)
    for r in rows.groupBy("quality", cell.alias("cell")).count().collect():
        cells[r["quality"], r["cell"]] = r["count"]
    if not cells.sum(axis=1).all():
        return None
    rarer = int(cells[1].sum() < cells[0].sum())
    groups = most_groups(cells[1 - rarer], GROUP)
    parts = min(groups, most_groups(cells[rarer], FEW))
    own = F.when(F.col("quality") == rarer, F.sequence(cell % parts, F.lit(groups - 1).cast("long"), F.lit(parts).cast("long"))).otherwise(F.array(cell % groups))

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        x, ids, quality = matrix(b"".join(t["features"].to_pylist())), t["doc_id"].to_numpy(), t["quality"].to_numpy()
        order = np.lexsort([*x.T[::-1], ids])  # the same sums in any order of arrival
        x, quality = x[order], quality[order]
        sides = [pa.array([x[quality == q].tobytes()], pa.large_binary()) for q in (1, 0)]
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([parts], pa.int64()), pa.array([rarer], pa.int64()), *[s.cast(pa.binary()) for s in sides]], names)

    names = ["group", "parts", "rarer", "good", "bad"]
    dealt = rows.select("doc_id", F.col("quality").cast("int").alias("quality"), "features", F.explode(own).alias("group"))
    return stored(dealt.groupBy("group").applyInArrow(pack, "group long, parts long, rarer long, good binary, bad binary"), "groups")


def over_groups(groups: DataFrame, make: Callable[[np.ndarray, np.ndarray, bool, int], np.ndarray]) -> np.ndarray:
    """make(good, bad, first, rarer) of each group as a row, by group; first: whether its rows of the rarer label are not in a group before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, parts, rarer, good, bad in zip(*b.columns, strict=True):
                out = make(matrix(good.as_buffer()), matrix(bad.as_buffer()), g.as_py() < parts.as_py(), rarer.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([g.as_py()], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["group", "sums"])

    return np.stack([np.frombuffer(r["sums"], float) for r in sorted(groups.mapInArrow(run, "group long, sums binary").collect())])


def once(good: np.ndarray, bad: np.ndarray, first: bool, rarer: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group's rows those that are counted here."""
    return (good, bad) if first else (good[:0], bad) if rarer else (good, bad[:0])


def nth(values: DataFrame, k: int) -> float:
    """The k-th smallest, from 0, of column v: by counts in ranges, of which that with the place is parted again."""
    v = F.col("v")
    low, high, n = values.agg(F.min(v), F.max(v), F.count(v)).first()
    while n > MOST and low < high:
        place = F.least(F.floor((v - low) / F.lit(high - low) * CELLS), F.lit(CELLS - 1))
        for _, low, high, n in sorted(values.groupBy(place.alias("place")).agg(F.min(v), F.max(v), F.count(v)).collect()):  # noqa: B007
            if k < n:
                break
            k -= n
        values = values.filter(v.between(low, high))
    return low if low == high else sorted(r["v"] for r in values.collect())[k]


def learn(rows: DataFrame, labels: DataFrame, pairs: int = 8, threshold: float = THRESHOLD) -> Model:
    """The model of all labelled rows (doc_id, features) outside the held-out fold."""
    known = labels.filter("quality in (0, 1)").filter(fold() != HELD_OUT).select("doc_id", "quality")
    groups = grouped(stored(rows.join(known, "doc_id").select("doc_id", "quality", "features"), "labelled"))
    model = flat(threshold)
    if groups is None:
        return model
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")  # a row is a group here

    def moments(*group) -> np.ndarray:
        good, bad = once(*group)
        x = np.concatenate([good, bad])
        mean = x.mean(axis=0) if len(x) else np.zeros(len(NAMES))
        return np.concatenate([[len(good), len(bad)], mean, ((x - mean) ** 2).sum(axis=0)])

    count, mean, apart = np.split(over_groups(groups, moments), [2, 2 + len(NAMES)], axis=1)
    n, n_bad = count.sum(axis=1, keepdims=True), int(count[:, 1].sum())
    model.centre = (n * mean).sum(axis=0) / n.sum()
    model.scale = np.sqrt((apart + n * (mean - model.centre) ** 2).sum(axis=0) / n.sum()) + 1e-9

    def step(w: np.ndarray) -> np.ndarray:
        return over_groups(groups, lambda good, bad, first, rarer: pair_sums(model.expanded(good), model.expanded(bad), w, pairs)).sum(axis=0)

    model.weights = newton(step)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g, parts, rarer, good, bad in zip(*b.columns, strict=True):
                for x in once(matrix(good.as_buffer()), matrix(bad.as_buffer()), g.as_py() < parts.as_py(), rarer.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array(model.raw(x), pa.float64())], ["v"])

    values = stored(groups.mapInArrow(raw, "v double"), "labelled-scores")
    high = nth(values, n_bad)
    below = values.filter(F.col("v") < high).agg(F.count("v").alias("n"), F.max("v").alias("low")).first()
    model.cut = (below["low"] + high) / 2 if below["n"] == n_bad else high
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> Model:
    """Texts are read for their features once and stay where they are: labels come to them if these are few, else features go to the labels."""
    known = stored(labels.filter("quality in (0, 1)").filter(fold() != HELD_OUT).select("doc_id", "quality"), "labels")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(fold() != HELD_OUT)
    if known.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(known.select(F.col("doc_id").alias("_id"))), F.col("doc_id") == F.col("_id"), "left_semi")
    return learn(feature_table(rows), known, threshold=threshold)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of each row (doc_id, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(matrix(b"".join(b.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= model.threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return rows.select("doc_id", "features").mapInArrow(run, "doc_id long, score double, predicted int")


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of each row."""
    return scored(feature_table(docs, id_col, text_col), model)


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that the model predicts to be good."""
    model = train(docs, labels, id_col=id_col, text_col=text_col)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    @F.pandas_udf("boolean")
    def good(texts):
        import pandas as pd

        arr = pa.array(texts, pa.string())
        return pd.Series(np.concatenate([model.score(features(arr[p])) >= model.threshold for p in slices(arr)]) if len(arr) else np.zeros(0, bool))

    return docs.filter(good(F.coalesce(F.col(text_col), F.lit(""))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(feature_table(table(spark, sf_dir, "documents")), "features")
    model = learn(rows, table(spark, sf_dir, "labels"))
    return scored(rows, model).select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
