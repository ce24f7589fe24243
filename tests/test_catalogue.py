"""Catalogue queries against their DuckDB oracle on the smallest driver tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"
LLM = {q for q in entry.queries() if q.startswith("op") or q == "pipeline"}
# Checked on small fixtures, as they run many small rounds.
SLOW = {"linkage_average", "linkage_complete", "linkage_single", "clusters_k", "clusters_height",
        "cut_height", "imposters"}
FAST = sorted(set(entry.oracle_sql()) - SLOW - LLM)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = Path(SF) / f"{t}.parquet"
        if p.exists():
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "freq", "mean_prob", "score", "keep"]
    assert df.count() > 0


def test_every_query_has_oracle_or_is_documented():
    qs, sql = entry.queries(), entry.oracle_sql()
    # Iterative or model-fitting queries: no SQL form, checked by row count
    # and by their own tests.
    rows_only = {"feature_groups", "svm_predict", "svm_weights", "svm_weights_top", "svm_cv",
                 "verify_pairs", "pair_logistic", "pca_variance", "svm_pca", "svm_saved", "verify_folds",
                 "verify_fold_scores", "spanning_tree", "single_clusters", "ward_vectors"}
    assert set(qs) - set(sql) - LLM <= rows_only


@pytest.mark.parametrize("name", FAST)
def test_matches_oracle(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    srows, drows = [tuple(r) for r in sdf.collect()], res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(sdf.columns, srows)[0] == digest(dcols, drows)[0]
