"""K-fold pair verification and principal components against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handprint.operators import logistic, pca


def _rows(spark, n=60, dims=4, seed=1):
    rnd = np.random.default_rng(seed)
    labels = rnd.integers(0, 3, n)
    x = rnd.normal(size=(n, dims)) + 2.0 * np.eye(dims)[labels]
    x[0] = 0  # a vector without direction
    data = [(i, int(c), [float(v) for v in row]) for i, (c, row) in enumerate(zip(labels, x))]
    return spark.createDataFrame(data, "id bigint, label int, vec array<double>").repartition(5)


def _brute(rows, compared, k, c=1.0):
    """Fold by fold: fit on training pairs by plain Newton steps, score the test pairs."""
    rows = {r.id: r for r in rows}
    unit = {i: np.array(r.vec) / (np.linalg.norm(r.vec) or 1) for i, r in rows.items()}

    def pairs(lefts, rights):
        keys = [(a, b) for a in lefts for b in rights if a != b]
        x = np.array([np.r_[np.abs(unit[a] - unit[b]), 1] for a, b in keys])
        return keys, x, np.array([rows[a].label == rows[b].label for a, b in keys], float)
    out = {}
    for fold in range(k):
        test = [i for i, r in rows.items() if r.chunk == (fold + 1) % k]
        train = [i for i, r in rows.items() if r.chunk not in (fold, (fold + 1) % k)]
        _, x, y = pairs([i for i in train if i in compared], train)
        w, pen = np.zeros(x.shape[1]), np.r_[np.ones(x.shape[1] - 1), 0]
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(np.diag(pen) + c * (x * (p * (1 - p))[:, None]).T @ x,
                                    pen * w + c * x.T @ (p - y))
        keys, x, y = pairs([i for i in test if i in compared], train)
        for key, same, p in zip(keys, y, 1 / (1 + np.exp(-x @ w))):
            out[fold, *key] = (bool(same), p)
    return out


@pytest.mark.parametrize("block_rows", [7, 1024])
def test_folds_equal_separate_fits(spark, monkeypatch, block_rows):
    k = 5
    monkeypatch.setattr(logistic, "PAIRS", 50)
    blocked = logistic.blocked
    monkeypatch.setattr(logistic, "blocked", lambda *a, **b: blocked(*a, **b, block_rows=block_rows))
    e = logistic.fold_chunks(_rows(spark), "label", "id", k).cache()
    compared = e.filter("id % 3 = 0")
    w = logistic.fit_folds(compared, e, "id", "vec", "label", k)
    got = {(r.fold, r.left_id, r.right_id): (r.is_pair, r.p_same) for r in logistic.score_folds(
        w, compared, e, "id", "vec", "label").collect()}
    want = _brute(e.collect(), {i for i in range(60) if i % 3 == 0}, k)
    assert got.keys() == want.keys() and len(want) > 500
    assert all(got[x][0] == want[x][0] and abs(got[x][1] - want[x][1]) < 1e-6 for x in want)
    # Every compared row is scored in one fold, by a model without its chunk.
    chunk = {r.id: r.chunk for r in e.collect()}
    assert all(chunk[a] == (f + 1) % k and chunk[b] not in (f, (f + 1) % k) for f, a, b in got)


def test_no_rows_and_no_training_pairs(spark):
    e = logistic.fold_chunks(_rows(spark, 4), "label", "id", 2).cache()
    none = e.where("false")
    assert logistic.fit_folds(none, e, "id", "vec", "label", 2).shape == (2, 1)
    # Two folds leave nothing to train on.
    w = logistic.fit_folds(e, e, "id", "vec", "label", 2)
    assert not w.any()
    assert logistic.score_folds(w, e, e, "id", "vec", "label").count() == 0


def test_components_equal_numpy(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 6)) @ rnd.normal(size=(6, 6)) + 5
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)],
                                 "id bigint, vec array<double>").repartition(20)
    model = pca.fit_pca(rows, "vec", 3)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    variance = s ** 2 / (len(x) - 1)
    assert np.allclose(model.variance, variance[:3])
    assert np.allclose(model.ratio, variance[:3] / variance.sum())
    assert np.allclose(np.abs((model.components * vt[:3]).sum(axis=1)), 1)
    assert (model.components[np.arange(3), np.abs(model.components).argmax(axis=1)] > 0).all()
    got = {r.id: r.vec for r in pca.project(model, rows, "vec").collect()}
    assert np.allclose([got[i] for i in range(300)], (x - x.mean(axis=0)) @ model.components.T)
    assert [r.component for r in pca.explained(model, rows).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        pca.fit_pca(rows.where("false"), "vec", 2)


def test_held_out_pairs_are_not_written(spark):
    """As Spark's logistic regression on a table of all differences gives it."""
    from handprint.operators import classify, pairs
    rng = np.random.default_rng(9)
    x = rng.normal(size=(40, 4)) + np.arange(40)[:, None] % 3
    rows = spark.createDataFrame([(i, i % 3, i % 5 == 1, v.tolist()) for i, v in enumerate(x)],
                                 "vec_id long, label int, held boolean, vec array<double>")
    few = rows.filter("vec_id % 4 = 0").drop("held")
    got = {(r.left_id, r.right_id): (r.is_pair, r.p_same) for r in logistic.held_out_pairs(
        few, rows, "vec_id", "vec", "label").collect()}
    one = pairs.compared_pairs(few, rows.drop("held"), "vec_id", "vec", ["label"])
    one = one.select("left_id", "right_id", (one.left_label == one.right_label).alias("is_pair"))
    d = classify.pair_difference(one, rows, "vec_id", "vec").cache()
    held = d.right_id % 5 == 1
    p = classify.predict_vector_logistic(classify.fit_vector_logistic(d.filter(~held)),
                                         d.filter(held)).collect()
    assert {(r.left_id, r.right_id): r.is_pair for r in p} == {k: v[0] for k, v in got.items()}
    assert all(abs(r.p_same - got[r.left_id, r.right_id][1]) < 2e-3 for r in p)


def test_start_on_few_comparators_changes_nothing(spark, monkeypatch):
    """Steps on a part of the pairs only find the start: fewer steps on all pairs, same weights."""
    rows = logistic.fold_chunks(_rows(spark, 300), "label", "id", 5).cache()
    compared = rows.filter("id % 3 = 0")
    sizes = []
    blocked = logistic.blocked
    monkeypatch.setattr(logistic, "blocked", lambda *a, **b: sizes.append(a[1].count()) or blocked(*a, **b))
    want = logistic.fit_folds(compared, rows, "id", "vec", "label", 5)
    steps = len(sizes)
    assert set(sizes) == {300}
    monkeypatch.setattr(logistic, "MANY_PAIRS", 1)
    monkeypatch.setattr(logistic, "FEW", 4)
    sizes.clear()
    got = logistic.fit_folds(compared, rows, "id", "vec", "label", 5)
    assert np.abs(got - want).max() < 1e-6
    assert sizes.count(300) < steps and 0 < min(sizes) < 150


def test_all_rows_against_all(spark, monkeypatch):
    """Two tiles meet once, and pairs are counted in their blocks: the same fit and counts."""
    k = 5
    e = logistic.fold_chunks(_rows(spark), "label", "id", k).cache()
    want = _brute(e.collect(), set(range(60)), k)
    blocked = logistic.blocked
    monkeypatch.setattr(logistic, "blocked", lambda *a, **b: blocked(*a, **b, block_rows=7))
    w = logistic.fit_folds(e, e, "id", "vec", "label", k)
    assert np.abs(w - logistic.fit_folds(e, e.filter("true"), "id", "vec", "label", k)).max() < 1e-6
    got = {r.fold: r for r in logistic.count_folds(w, e, e, "id", "vec", "label").collect()}
    for fold in range(k):
        one = [(same, p >= 0.5) for (f, _, _), (same, p) in want.items() if f == fold]
        r = got[fold]
        assert (r.n, r.tp, r.fp, r.fn) == (len(one), *(one.count(x) for x in (
            (True, True), (False, True), (True, False))))


def test_fold_scores_take_every_vector(spark, tmp_path):
    """No id is divisible by 20; each vector of a test chunk meets all training vectors."""
    from handprint.plans.catalogue import QUERIES
    rows = _rows(spark).filter("id % 20 <> 0").select(
        F.col("id").alias("vec_id"), F.col("vec").alias("embedding"), "label")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.fold: r.n for r in QUERIES["verify_fold_scores"](spark, str(tmp_path)).collect()}
    chunks = [r.chunk for r in logistic.fold_chunks(rows, "label", "vec_id", 5).collect()]
    size = [chunks.count(c) for c in range(5)]
    assert got == {f: size[(f + 1) % 5] * (len(chunks) - size[f] - size[(f + 1) % 5])
                   for f in range(5)}
