"""Rounded distances of pair lists, and mining inside the blocks."""

import numpy as np
import pytest

from handprint.operators import metrics, pairs
from handprint.plans import catalogue


def _vectors(n, width, seed):
    rnd = np.random.default_rng(seed)
    x = rnd.normal(size=(n, width))
    x[n // 2:n // 2 + 20] = np.round(x[:20], 2)
    x[-3], x[-2], x[-1] = 0, 7, x[0]  # no direction, no signal, a copy
    return x


@pytest.mark.parametrize("metric", ["cityblock", "euclidean", "sqeuclidean", "snr", "cosine"])
@pytest.mark.parametrize("digits", [2, 6])
def test_rounded_distances_are_the_exact_ones(metric, digits, monkeypatch):
    a, b = _vectors(150, 5, 1), np.r_[_vectors(150, 5, 1)[::2], _vectors(200, 5, 2)]
    # Distances that lie on a boundary of the rounding.
    a, b = np.r_[a, np.round(a, 3)], np.r_[b, np.round(b, 3), np.round(a, 3) + [0.005, 0, 0, 0, 0]]
    looked = []
    exact = pairs._pair_distances
    monkeypatch.setattr(pairs, "_pair_distances",
                        lambda x, y, m: looked.append(len(x)) or exact(x, y, m))
    for scale in (1, 1e-7, 1e5):
        got = pairs.rounded_distances(a * scale, b * scale, metric, digits)
        with np.errstate(invalid="ignore"):
            want = np.round(pairs.distance_matrix(a * scale, b * scale, metric), digits)
        assert np.array_equal(got, want, equal_nan=True)
        if scale == 1 and metric in ("euclidean", "sqeuclidean") and digits == 6:
            assert sum(looked) < got.size / 20
    bad = a.copy()
    bad[0, 0], bad[1, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        assert np.array_equal(pairs.rounded_distances(bad, b, metric, digits),
                              np.round(pairs.distance_matrix(bad, b, metric), digits), equal_nan=True)


def _table(spark, n=90):
    rnd = np.random.default_rng(4)
    x = np.round(rnd.normal(size=(n, 3)), 1)
    rows = [(i, [float(v) for v in x[i]], None if i % 17 == 3 else int(i % 3)) for i in range(n)]
    rows += [(20, rows[5][1], 1), (40, rows[6][1], None), (200, rows[7][1], 99), (220, rows[9][1], None),
             (None, rows[8][1], 1)]  # repeated and null ids, a label of its own, none
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_extremes_mine_like_all_pairs(spark, block_rows):
    e = _table(spark).repartition(5).cache()
    compared = e.filter("vec_id % 20 = 0")
    args = ("vec_id", "embedding")
    every = pairs.compared_pairs(compared, e, *args, ["label"], normalise=True).selectExpr(
        "left_id", "distance", "left_label = right_label AS is_pair").cache()
    few = pairs.extreme_pairs(compared, e, *args, normalise=True, block_rows=block_rows).cache()
    mined = metrics.mine(few, "easy", "easy")
    anchors = compared.join(mined.selectExpr("anchor AS vec_id", "d_ap"), "vec_id")
    beyond = pairs.extreme_pairs(anchors, e, *args, normalise=True, block_rows=block_rows,
                                 beyond="d_ap")
    both = few.unionByName(beyond).cache()
    for got, kinds in ((few, ("easy", "easy")), (few, ("hard", "hard")), (both, ("easy", "semihard"))):
        assert sorted(map(str, metrics.mine(got, *kinds).collect())) == sorted(
            map(str, metrics.mine(every, *kinds).collect()))
    assert few.count() + beyond.count() < every.count() or block_rows == 7


def test_mined_triplets_lists_no_pairs(spark, tmp_path, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("pairs listed")
    _table(spark).write.parquet(str(tmp_path / "embeddings.parquet"))
    p = catalogue.unit_pairs(spark, str(tmp_path))
    want = metrics.mine(p, "easy", "semihard").join(
        metrics.mine(p, "easy", "easy").selectExpr("anchor", "d_an AS d_easy"), "anchor")
    want = sorted(map(str, want.select("anchor", "d_ap", "d_an", "d_easy").collect()))
    monkeypatch.setattr(pairs, "compared_pairs", refuse)
    got = catalogue.mined_triplets(spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == want and len(got) == 7


def test_probabilities_are_rounded_like_decimals(spark, tmp_path):
    _table(spark).write.parquet(str(tmp_path / "embeddings.parquet"))
    rows = catalogue.vector_pairs(spark, str(tmp_path)).collect()
    assert len(rows) > 500 and all(r.Probability == round(1 - r.Distance, 6) for r in rows)
