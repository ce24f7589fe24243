"""Saved models and in-batch mining."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handprint.operators import batches, linear, models, pca


def _rows(spark):
    rnd = np.random.default_rng(2)
    data = [(i, "abc"[i % 3], "train" if i % 5 else "holdout",
             [float(v) for v in rnd.normal(size=4) + 3 * np.eye(4)[i % 3]]) for i in range(90)]
    return spark.createDataFrame(data, "id bigint, who string, split string, vec array<double>")


def test_models_are_read_in_a_fresh_session(spark, tmp_path):
    rows, path = _rows(spark), str(tmp_path / "models")
    assert models.versions(spark, path, "svm") == []
    with pytest.raises(ValueError):
        models.load(spark, path, "svm")
    train = rows.filter("split = 'train'")
    svm = linear.fit(train, "who")
    assert models.save(spark, svm, path, "svm") == 1
    other = linear.fit(rows.filter("id < 60"), "who")
    assert models.save(spark, other, path, "svm") == 2
    assert models.versions(spark, path, "svm") == [1, 2]
    fresh = spark.newSession()
    for version, model in ((1, svm), (2, other), (None, other)):
        back = models.load(fresh, path, "svm", version)
        assert back.labels == model.labels and np.array_equal(back.weights, model.weights)
    want = linear.predict(svm, rows, ["id"]).collect()
    got = linear.predict(models.load(fresh, path, "svm", 1), rows, ["id"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_attributor(spark, tmp_path):
    rows, path = _rows(spark), str(tmp_path / "models")
    fitted = models.Attributor(path, "authors", components=2)
    tested = fitted.fit(rows, "who").collect()
    assert len(tested) == 18 and sum(r.prediction == r.who for r in tested) > 12
    train = rows.filter("split = 'train'")
    reducer = pca.fit_pca(train, "vec", 2)
    svm = linear.fit(pca.project(reducer, train.select("who", "vec"), "vec"), "who")
    want = linear.predict(svm, pca.project(reducer, rows.select("id", "vec"), "vec"), ["id"]).collect()
    later = models.Attributor(path, "authors", components=2).predict(rows, ["id"]).collect()
    assert {r.id: r.prediction for r in later} == {r.id: r.prediction for r in want}
    none = fitted.predict(rows, ["id"], threshold=1e9)
    assert {r.prediction for r in none.collect()} == {"Unattributed"}


def test_what_cannot_be_saved(spark, tmp_path):
    with pytest.raises(ValueError):
        models.save(spark, object(), str(tmp_path), "x")
    with pytest.raises(ValueError):
        models.save(spark, np.zeros((2, 3)), str(tmp_path), "a/b")
    with pytest.raises(ValueError):
        models.save(spark, linear.StackedSVM(["a"], np.zeros((2, 1, 3)), 1), str(tmp_path), "x")
    models.save(spark, np.ones((2, 3)), str(tmp_path), "folds")
    assert np.array_equal(models.load(spark, str(tmp_path), "folds"), np.ones((2, 3)))


def _pairwise(pdf):
    """AUROC and mined means of one batch, pair by pair."""
    rows = [(r.id, r.who, np.array(r.vec) / np.linalg.norm(r.vec)) for r in pdf.itertuples()]
    d = {(a[0], b[0]): round(float(np.linalg.norm(a[2] - b[2])), 6) for a in rows for b in rows}
    who = {r[0]: r[1] for r in rows}
    pos = [d[a, b] for a, b in d if a < b and who[a] == who[b]]
    neg = [d[a, b] for a, b in d if a < b and who[a] != who[b]]
    auc = np.mean([(p < n) + (p == n) / 2 for p in pos for n in neg]) if pos and neg else None
    easy, semi = [], []
    for a in who:
        same = [d[a, b] for b in who if b != a and who[b] == who[a]]
        diff = [d[a, b] for b in who if who[b] != who[a]]
        if same and diff:
            easy.append(min(same))
            semi += [min(x for x in diff if x > min(same))] if max(diff) > min(same) else []
    return auc, len(easy), sum(easy), sum(semi), len(semi)


def test_batches(spark):
    rows = _rows(spark).withColumn("batch", F.when(F.col("id") < 6, 0).when(F.col("id") < 30, 1)
                                   .when(F.col("id") == 30, 2).when(F.col("id") % 3 == 0, 3)
                                   .otherwise(4))
    got = {r.batch: r for r in batches.batch_scores(rows, ["batch"], "vec", "who", "id").collect()}
    for batch, pdf in rows.toPandas().groupby("batch"):
        auc, n, easy, semi, n_semi = _pairwise(pdf)
        r = got[batch]
        assert (r.n_rows, r.n_pairs, r.n_anchors, r.n_semihard) == (
            len(pdf), len(pdf) * (len(pdf) - 1) // 2, n, n_semi)
        assert r.easy_positive == pytest.approx(easy) and r.semihard_negative == pytest.approx(semi)
        assert r.auroc is None if auc is None else r.auroc == pytest.approx(auc)
    assert got[2].n_pairs == 0 and got[2].auroc is None and got[3].auroc is None
