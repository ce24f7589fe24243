"""Pair metrics against direct NumPy computations on a random pair table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handprint.operators import metrics


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 400
    d = np.round(rng.uniform(0.2, 1.8, n), 3)  # rounded: ties on purpose
    y = rng.uniform(size=n) < 0.3
    rows = [(i, i + 1000, float(a), bool(b)) for i, (a, b) in enumerate(zip(d, y))]
    df = spark.createDataFrame(rows, "left_id long, right_id long, distance double, is_pair boolean")
    return df, d, y


def test_threshold_curve(table):
    df, d, y = table
    curve = {round(r.Threshold, 9): r for r in metrics.threshold_curve(df, 0.05).collect()}
    ts = np.arange(0.05, d.max(), 0.05)
    assert len(curve) == len(ts)
    P, N = y.sum(), (~y).sum()
    for t in ts:
        r = curve[round(t, 9)]
        assert r.Sensitivity == pytest.approx(((d <= t) & y).sum() / P)
        assert r.Specificity == pytest.approx(((d > t) & ~y).sum() / N)
        tp, fp = ((d < t) & y).sum(), ((d < t) & ~y).sum()
        f1 = 2 * tp / (2 * tp + fp + (P - tp)) if (2 * tp + fp + (P - tp)) else 0
        assert r.F1 == pytest.approx(f1)
        assert r.AuRoc == pytest.approx((tp / P + (N - fp) / N) / 2)


def test_roc_auc(table):
    df, d, y = table
    pos, neg = d[y], d[~y]
    direct = ((pos[:, None] < neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum())
    direct /= len(pos) * len(neg)
    assert metrics.roc_auc(df).first().auc == pytest.approx(direct)


def test_strong_thresholds(table):
    df, d, y = table
    got = {r.percentile: r.threshold for r in metrics.strong_thresholds(df).collect()}
    for p in (0.25, 0.5, 0.75, 0.9):
        assert got[p] == pytest.approx(np.percentile(d[y], p * 100))


def test_confusion_and_f05u(table):
    df, d, y = table
    c = metrics.confusion(df, 1.0).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (((d <= 1) & y).sum(), ((d <= 1) & ~y).sum(),
                                        ((d > 1) & ~y).sum(), ((d > 1) & y).sum())
    f = metrics.f05u(df, 1.0, 0.01).first()
    u = np.abs(d - 1.0) <= 0.01
    tp = (~u & (d < 1) & y).sum()
    fp = (~u & (d < 1) & ~y).sum()
    fn = (~u & (d >= 1) & y).sum()
    assert f.f05u == pytest.approx(1.25 * tp / (1.25 * tp + 0.25 * (fn + u.sum()) + fp))


def test_asof_rates(table, spark):
    df, d, y = table
    q = spark.createDataFrame([(0.5,), (1.0,), (1.5,)], "distance double")
    got = {r.distance: r for r in metrics.asof_rates(df, q).collect()}
    for t in (0.5, 1.0, 1.5):
        tp, fp = ((d <= t) & y).sum(), ((d <= t) & ~y).sum()
        assert got[t].tpr == pytest.approx(tp / y.sum())
        assert got[t].fpr == pytest.approx(fp / (~y).sum())


def test_counts_parted_by_a_mark(spark):
    """Pairs counted in their blocks by a mark of the comparator, labels null or not."""
    from handprint.operators import pairs
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 7 == 0 else i % 3, i % 4 == 0, rng.normal(size=3).round(1).tolist())
            for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, held boolean, vec array<double>")
    few = df.filter("vec_id % 5 = 0").drop("held")
    got = pairs.pair_counts(few, df, "vec_id", "vec", block_rows=16, by="held").collect()
    one = pairs.compared_pairs(few.withColumn("held", few.vec_id < 0), df, "vec_id", "vec",
                               ["label", "held"])
    want = one.groupBy("distance", (one.left_label == one.right_label).alias("is_pair"),
                       one.right_held.alias("held")).count().collect()
    assert {(r.distance, r.is_pair, r.n, r.held) for r in got} == {
        (r.distance, r.is_pair, r["count"], r.held) for r in want}


def test_asof_rates_compares_all_vectors(spark, tmp_path):
    """Every ordered pair counts, whatever the ids; none of them is divisible by 20 but one."""
    from handprint.plans.catalogue import QUERIES
    rng = np.random.default_rng(12)
    rows = [(i, rng.normal(size=4).tolist(), i % 3) for i in range(1, 41)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    got = QUERIES["asof_rates"](spark, str(tmp_path)).collect()
    from handprint.operators import splits
    e = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    split = splits.holdout_split(e.select("vec_id", "label"), "label", "vec_id", 0.1, 42)
    held = {r.vec_id for r in split.filter("split = 'holdout'").collect()}
    data = {r.vec_id: (np.array(r.embedding, float), r.label) for r in e.collect()}
    unit = {i: x / np.sqrt((x * x).sum()) for i, (x, _) in data.items()}
    pairs = [(np.round(np.sqrt(((unit[a] - unit[b]) ** 2).sum()), 6), data[a][1] == data[b][1], b in held)
             for a in unit for b in unit if a != b]
    assert {r.distance for r in got} == {float(np.floor(d * 100 + 0.5)) / 100 for d, _, h in pairs if h}
    for r in got:
        seen = [(d <= r.distance, same) for d, same, h in pairs if not h]
        assert (r.tp, r.fp, r.tn, r.fn) == tuple(seen.count(x) for x in (
            (True, True), (True, False), (False, False), (False, True)))


def test_counts_of_unit_vectors(spark):
    """Counts kept by steps are those of the listed pairs: equal, opposite and zero vectors too."""
    from handprint.operators import pairs
    rng = np.random.default_rng(7)
    rows = [(i, None if i % 9 == 0 else i % 2, i % 4 == 0,
             [0.0, 0.0] if i % 11 == 0 else rng.integers(-2, 3, 2).astype(float).tolist())
            for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, label int, held boolean, vec array<double>")
    few = df.filter("vec_id % 3 = 0").drop("held")
    one = pairs.compared_pairs(few.withColumn("held", few.vec_id < 0), df, "vec_id", "vec",
                               ["label", "held"], normalise=True)
    same = one.left_label == one.right_label
    for by, keys in (("held", [same.alias("is_pair"), one.right_held.alias("held")]),
                     (None, [F.coalesce(same, F.lit(False)).alias("is_pair")])):
        got = pairs.pair_counts(few, df if by else df.drop("held"), "vec_id", "vec", normalise=True,
                                block_rows=16, by=by)
        want = one.groupBy("distance", *keys).agg(F.count(F.lit(1)).alias("n"))
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(
            map(str, want.collect()))
