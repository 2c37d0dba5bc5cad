import corpus_pipeline
import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from pairloom.llm import decontam, langid, near_copies


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(90001, "12 34 !", "en", "src0", 7), (90002, None, "en", "src0", 0), (90003, docs.first().text, "fr", "src0", 1)], docs.schema)
    docs = docs.unionByName(more)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        out[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out[name].columns == docs.columns
        docs = out[name]
    ids = {n: {r.doc_id for r in d.select("doc_id").collect()} for n, d in out.items()}
    assert not {90001, 90002} & ids["language"] and 90003 in ids["language"]
    assert ids["line_dedup"] == ids["language"] and ids["near_duplicates"] <= ids["line_dedup"]
    assert out["line_dedup"].where(F.char_length("text") != F.col("n_chars")).count() == 0
    rows = out["line_dedup"].collect()
    sets = [set(near_copies.shingles((r.text or "").encode()).tolist()) for r in rows]
    near = np.array([[a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)) for b in sets] for a in sets])
    label = np.array([r.doc_id for r in rows])
    while ((new := np.where(near, label[None, :], 1 << 60).min(1)) != label).any():
        label = new
    assert ids["near_duplicates"] == {r.doc_id for r, at in zip(rows, label) if r.doc_id == at}
    leaks = {r.doc_id for r in decontam.leaks(out["near_duplicates"], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids["decontamination"] == ids["near_duplicates"] - leaks and leaks
    assert ids["packing"] == ids["decontamination"]
    assert langid.NONE == "und"


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100 and corpus_pipeline.ORACLE_SQL is None


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = {"removed": "x", "own": "y", "bad": "z", "a.b": "w", "run_doc": "v"}
    wide = docs.limit(40).select("*", *[F.lit(v).alias(k) for k, v in more.items()])
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", None, 0), (90001, None, "en", "s", None), (90002, "word " * 60_000, "en", "s", 300_000)], docs.schema)
    odd = odd.select("*", *[F.lit(None).cast("string").alias(k) for k in more])
    spark.read.parquet(f"{SMALL}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    wide.unionByName(odd).unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    found = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, found, str(tmp_path))
        assert got.columns == found.columns and {tuple(r) for r in got.select(*[f"`{k}`" for k in more]).distinct().collect()} <= {tuple(more.values()), (None,) * 5}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    docs.where("false").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
