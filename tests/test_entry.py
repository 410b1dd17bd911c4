import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from cohortspark import queries

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


def test_flagship(spark):
    assert entry_points.entry(spark).count() == 1


PLAIN = ("psi_align", "dp_contingency_cross", "dp_mean_var", "dp_cor", "chisq", "dp_auc", "dp_frequency", "dp_kaplan_meier")
FITTED = ("cox", "ordinal", "multinomial", "gee_ar1", "ipw", "formula_design", "fisher_exact", "vert_pca", "dp_diagnostic2x2_inference", "lmm", "vert_glm_predict", "dp_noisy_contingency", "lmm_slopes", "release_vector", "manifest_difference", "glm_exact", "dp_roc_levels")


@pytest.mark.parametrize("name", PLAIN + FITTED)
def test_queries_match_their_sql(spark, name):
    con, folder = duckdb.connect(), SF if name in PLAIN else SF.replace("0.001", "0.01")
    for t in ("documents", "labels", "orders", "lineitem", "customer", "events"):
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = queries.QUERIES[name](spark, folder)
    want = con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([r[c] for c in cols]) for r in got.collect()) == sorted(repr([r[i] for i in at]) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_imports_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT / "cohortspark", tmp_path / "cohortspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'epi2x2' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_streaming_counts_match_batch(spark, tmp_path):
    from cohortspark.streaming.incremental import windowed_counts

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        assert spark.table("counts").agg({"n": "sum"}).first()[0] == events.count()
    finally:
        q.stop()


