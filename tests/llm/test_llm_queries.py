"""Registered queries against their SQL, and the pipeline's stages, on the driver's small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pagelane.llm import catalog, op5_ngram_join, op6_toxicity, op7_language_id
from pagelane.sources.tables import TABLES, table_path
from tools.compare import digest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    df = entry.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(columns)
    assert digest(df.columns, rows) == digest(columns, res.fetchall())


def test_all_queries_and_the_pipeline_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in catalog.queries())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_language_and_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(table_path(SF, "documents"))
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    held = [r for r in op7_language_id.op7_language_id(spark, SF).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held) > 0
    out = op6_toxicity.op6_toxicity(spark, SF).collect()
    assert len(out) == docs.count()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(table_path(SF, "documents"))
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{spark.sparkContext.getCheckpointDir()}/test-{name}-{os.urandom(4).hex()}"
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append(name)
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            groups = op5_ngram_join.similarity_components(before, 5, 80).select("doc_id", "component_id").collect()
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in groups if r.doc_id == r.component_id)
        if name == "packing":
            assert docs.count() == before.count()
    assert seen == ["language_id", "line_dedup", "near_duplicates", "mixing", "packing"]
