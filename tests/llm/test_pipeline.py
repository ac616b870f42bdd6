"""The pipeline's rows against the stages done plainly on a small table, and on difficult tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sheetloom.llm import quality
from tests.llm.test_operators import brute_hits, brute_links


def first_of_classes(rows):
    """The smallest id of each near-duplicate class, from all pairs."""
    root = [i for i, _ in rows]
    for a, b in brute_links([t for _, t in rows]):
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    return set(root)


def test_pipeline_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in quality.classify(docs, keep=["doc_id"]).where("keep").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    first = first_of_classes(rows)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, t in rows if i in first and not brute_hits(t, items)[1]}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert len(first) < len(rows) and {r.doc_id for r in got} == clean
    assert all(np.frombuffer(r.ids, "<u4").size == r.n_tokens for r in got)
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5


@pytest.fixture(scope="module")
def difficult(spark, sf_dir, tmp_path_factory):
    """A table with null ids and texts, repeated rows, an empty text, and columns named as those that stages make."""
    path = str(tmp_path_factory.mktemp("difficult"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = docs.where("doc_id = 0")
    odd = one.withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.limit(20)).unionByName(one.withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(9_000_001)))
    odd = odd.unionByName(one.withColumn("text", F.lit("")).withColumn("doc_id", F.lit(9_000_002)))
    more = docs.unionByName(odd).withColumns({c: F.lit("own") for c in ("keep", "blob", "spans", "n_tokens", "row", "class_id", "digest", "score")})
    more.write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_of_a_difficult_table(spark, sf_dir, difficult):
    got = corpus_pipeline.run(spark, difficult)
    assert {"keep", "blob", "spans", "row", "class_id", "digest", "score", "n_chars", "source"} <= set(got.columns)
    rows = got.collect()
    ids = [r.doc_id for r in rows if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and all(r.blob == r.spans == r.keep == "own" for r in rows)
    assert set(ids) - {9_000_001, 9_000_002} <= {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_pipeline_of_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_one_of_each_leaves_no_link(spark):
    """Families of variants around one text: what the stage keeps is one of each class of all pairs, however many texts share a band."""
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for family in range(50):
        mine = list(base)
        for k in rng.choice(60, 4, replace=False):
            mine[k] = f"f{family}x{k}"
        rows += [(len(rows), " ".join(mine)), (len(rows) + 1, " ".join([*mine, "more"]))]
    got = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == first_of_classes(rows)
