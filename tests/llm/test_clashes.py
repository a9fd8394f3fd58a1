"""Columns of a user's that are named like the operators' helpers, null and repeated ids: rows and columns are kept, and results are those without them."""

import pytest
from pyspark.sql import functions as F

from slidejobs.llm import exact_dedup, near_dedup, packing, quality

HELPERS = ["_id", "_node", "_Again", "_group_id", "_group_sha", "_bucket", "_rank", "_length", "_before", "node", "n", "features", "h", "length", "keep_id"]
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()


@pytest.fixture(scope="module")
def docs(spark):
    texts = [" ".join(WORDS[i % 7 :] + WORDS[: i % 5]) + f" {i // 3}" for i in range(30)]
    texts += [texts[0], texts[0] + " ", None, "", "###### !!!! 1234"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4]), (None, "alone"), (7, "another text of that id")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in HELPERS])


def kept(df):
    return sorted(map(str, df.select("doc_id", "text").collect()))


def labels(spark):
    return spark.createDataFrame([(i, int(i < 20), 0) for i in range(30)] + [(34, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("f", [exact_dedup.drop_duplicates, near_dedup.drop_near_duplicates, lambda d: quality.accepted(d, labels(d.sparkSession))])
def test_rows_are_returned_with_all_columns(docs, clashing, f):
    out = f(clashing)
    assert out.columns == clashing.columns
    assert kept(out) == kept(f(docs))
    assert all(r[c] == f"own {c}" for r in out.collect() for c in HELPERS)
    assert f(clashing.limit(0)).count() == 0


@pytest.mark.parametrize("f", [exact_dedup.exact_dedup, near_dedup.near_duplicates, packing.pack_documents])
def test_results_do_not_change(docs, clashing, f):
    own = lambda d: sorted(str(sorted(r.asDict().items(), key=lambda x: x[0])) for r in f(d).drop("sequence_id", "offset").collect())
    assert own(docs) == own(clashing)


def test_pack_keeps_columns(clashing):
    rows = clashing.filter("doc_id is not null").withColumn("length", F.col("doc_id") % 9 + 1).dropDuplicates(["doc_id"])
    out = packing.pack(rows, ["doc_id"], 16)
    assert out.columns == [*rows.columns, "sequence_id", "offset"]
    got = out.collect()
    assert len(got) == rows.count() and all(r["_bucket"] == "own _bucket" and r["_rank"] == "own _rank" for r in got)


def test_null_ids_are_not_held_out(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op5_quality(spark, str(tmp_path)).collect()
    assert len(got) == docs.count() and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert not any(r.held_out for r in got if r.doc_id is None)
