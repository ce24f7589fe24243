"""Distributed ranks and prefix sums, including a class that holds a third of the rows."""

import numpy as np
from pyspark.sql import functions as F

from handprint.operators.ranking import global_rank, prefix_sum, rank_within


def _skewed(spark, n=3000):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        g = "hot" if i % 3 == 0 else f"g{rng.integers(0, 50)}"
        rows.append((i, g, float(rng.integers(0, 100))))
    return spark.createDataFrame(rows, "id long, g string, v double"), rows


def test_rank_within_skewed_group(spark):
    df, rows = _skewed(spark)
    r = rank_within(df, ["g"], ["v", "id"]).collect()
    got = {(x.g, x.id): (x.rank, x.group_size) for x in r}
    by = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((v, i))
    for g, items in by.items():
        for k, (v, i) in enumerate(sorted(items), start=1):
            assert got[(g, i)] == (k, len(items))
    assert sum(1 for x in r if x.g == "hot") == 1000


def test_global_rank_and_prefix_sum(spark):
    df, rows = _skewed(spark)
    g = {x.id: x.rank for x in global_rank(df, ["v", "id"], "rank").collect()}
    order = sorted(rows, key=lambda t: (t[2], t[0]))
    assert [g[i] for i, _, _ in order] == list(range(1, len(rows) + 1))
    ps = {x.id: x.v_cum for x in prefix_sum(df, ["v", "id"], ["v"]).collect()}
    run = np.cumsum([v for _, _, v in order])
    assert all(abs(ps[i] - c) < 1e-9 for (i, _, _), c in zip(order, run))
