"""Every catalogued query against its SQL, on the smallest tables."""

import pytest

from stratalens.plans.catalog import QUERIES
from stratalens.plans.oracles import ORACLES
from tools.check_oracles import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, FOLDER, name) == ""


def test_only_the_document_listing_has_no_sql():
    assert set(QUERIES) - set(ORACLES) == {"result_json"}


def test_entry(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_an_analysis_reads_its_inputs_few_times(spark, tmp_path):
    """Churn table and tree are made once, whatever starts from them: what is left reads the tags twice and the history once."""
    from stratalens.plans import pipelines
    from stratalens.sources import results

    tags = "r, d/a.py, 1, k, def; r, d/b.py, 2, k, ref".split("; ")
    tags = [(r, p, int(n), name, kind) for r, p, n, name, kind in (t.split(", ") for t in tags)]
    columns = "repo_id string, path string, line int, name string, kind string"
    spark.createDataFrame(tags, columns).write.parquet(f"{tmp_path}/tags")
    history = "SELECT 'r' repo_id, 'h' commit_hash, 'm' author_email, timestamp_ntz'2024-05-01' commit_ts, 'd/a.py' path, 3 added, 1 removed"
    spark.sql(history).write.parquet(f"{tmp_path}/history")
    repos = spark.createDataFrame([("r", "u", "r")], "repo_id string, repo_url string, repo_name string")
    read = [spark.read.parquet(f"{tmp_path}/{t}") for t in ("tags", "history")]
    documents = results.result_documents(pipelines.analyze(*read, repos, "2024-06-01"))
    assert {r["section"] for r in documents.collect()} >= {"summary", "ranked_files", "tree", "symbols", "hotspots"}
    lines = documents._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scans = [x for x in lines if "Relation [" in x]
    assert 1 <= sum("commit_hash#" in x for x in scans) <= 1 and 1 <= sum("kind#" in x for x in scans) <= 2
