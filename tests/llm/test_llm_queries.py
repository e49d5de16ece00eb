"""Registered queries against DuckDB on the smallest driver tables, and the pipeline's stages."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from feedlake.llm import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()[list(want.columns)]
    want, got = (x.sort_values(list(want.columns)).reset_index(drop=True) for x in (want, got))
    assert (want.astype(str) == got.astype(str)).all().all() and len(want) == len(got)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from feedlake.llm.jaccard import jaccard_classes

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        assert name == "sharding" or docs.columns == columns
    kept = {n: {r["doc_id"] for r in d.select("doc_id").collect()} for n, d in seen.items()}
    assert kept["sharding"] == kept["source_mixing"] == kept["benchmark_decontamination"] < kept["ngram_jaccard_join"] < kept["toxicity"]
    assert jaccard_classes(seen["ngram_jaccard_join"]).where(F.col("n_links") > 0).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]
