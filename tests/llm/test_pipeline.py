"""The stages of the pipeline against what they must keep."""

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    at = {}
    for i, (name, stage) in enumerate(P.STAGES):
        out = f"{tmp_path}/{i}"
        stage(spark, docs, DIR).write.parquet(out)
        docs = spark.read.parquet(out)
        at[name] = docs.toPandas()
        if name != "packing":
            assert sorted(docs.columns) == sorted(columns)
    assert len(at["quality"]) >= len(at["exact_dedup"]) >= len(at["near_dedup"]) == len(at["passages"]) > 100
    squeezed = at["exact_dedup"]["text"].map(lambda t: "".join(t.split()))
    assert squeezed.is_unique
    assert set(at["packing"]["doc_id"]) == set(at["passages"]["doc_id"])
    assert at["packing"].groupby("sequence_id")["length"].sum().max() <= 4096


def test_empty(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, DIR).count() == 0
