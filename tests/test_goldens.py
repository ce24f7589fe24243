"""Golden values printed in the reference's docstrings (FIXTURES.md section 2)."""

import pytest
from pyspark.sql import functions as F

from handprint.operators import features, select


def _grid(df, col="value"):
    return {(r.doc_id, r.feature): r[col] for r in df.collect()}


def test_moisl_golden(mac):
    values, docs = mac
    res = {r.feature: r for r in select.moisl(values, docs, z=1.96, value="value").collect()}
    assert res["a"].freq == 1 and res["b"].freq == 93 and res["c"].freq == 29
    assert res["a"].mean_prob == pytest.approx(0.008621, abs=1e-6)
    assert res["b"].mean_prob == pytest.approx(0.805249, abs=1e-6)
    assert res["c"].mean_prob == pytest.approx(0.186130, abs=1e-6)
    assert res["a"].score == pytest.approx(47.89995, abs=1e-5)
    assert res["b"].score == pytest.approx(8.731698, abs=1e-6)
    assert res["c"].score == pytest.approx(7.856381, abs=1e-6)
    assert [res[f].keep for f in "abc"] == [False, True, True]


def test_relative_golden(mac):
    values, _ = mac
    g = _grid(features.relative(values))
    assert g[("Mac1", "a")] == pytest.approx(0.034483, abs=1e-6)
    assert g[("Mac1", "b")] == pytest.approx(0.862069, abs=1e-6)
    assert g[("Mac2", "c")] == pytest.approx(0.178571, abs=1e-6)
    assert g[("Mac4", "c")] == pytest.approx(0.0625, abs=1e-9)


def test_relative_small_golden(spark):
    v = spark.createDataFrame([("r0", "x", 1.0), ("r0", "z", 3.0), ("r1", "y", 3.0),
                               ("r1", "z", 5.0)], "doc_id string, feature string, value double")
    g = _grid(features.relative(v))
    assert g[("r0", "x")] == 0.25 and g[("r0", "z")] == 0.75
    assert g[("r1", "y")] == 0.375 and g[("r1", "z")] == 0.625


def _zl2(values, docs, normalise):
    rel = features.relative(values)
    idx = features.feature_index(rel)
    vec = features.zscore_vectors(rel, docs, idx)
    if normalise:
        vec = features.l2(vec)
    return _grid(features.vectors_to_long(vec, idx))


def test_zscore_golden(mac):
    values, docs = mac
    g = _zl2(values, docs, False)
    exp = {"a": [1.5, -.5, -.5, -.5],
           "b": [.39175744, .11155163, -1.41514547, .9118364],
           "c": [-.54951155, -.05023463, 1.42140459, -.82165841]}
    for f, col in exp.items():
        for i, v in enumerate(col):
            assert g[(f"Mac{i + 1}", f)] == pytest.approx(v, abs=1e-7)


def test_zscore_l2_golden(mac):
    values, docs = mac
    g = _zl2(values, docs, True)
    exp = {"Mac1": [.911953, .238176, -.334086], "Mac2": [-.971346, .216710, -.097590],
           "Mac3": [-.241881, -.684594, .687622], "Mac4": [-.377257, .687994, -.619953]}
    for d, row in exp.items():
        for f, v in zip("abc", row):
            assert g[(d, f)] == pytest.approx(v, abs=1e-6)
