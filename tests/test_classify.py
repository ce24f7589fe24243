"""Reports, nearest reference, Tomek links and the sequence encoder."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from handprint.operators import classify, encode, pairs


def test_class_scores(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a")]
    df = spark.createDataFrame(rows, "truth string, prediction string")
    got = {r.cls: r for r in classify.class_scores(df).collect()}
    assert got["a"].precision == pytest.approx(0.5) and got["a"].recall == pytest.approx(0.5)
    assert got["b"].precision == pytest.approx(2 / 3) and got["b"].recall == pytest.approx(1.0)
    assert got["c"].precision == 0 and got["c"].recall == 0 and got["c"].f1 == 0
    assert got["b"].f1 == pytest.approx(0.8) and got["b"].support == 2
    conf = {(r.truth, r.prediction): r.n for r in classify.confusion(df).collect()}
    assert conf == {("a", "a"): 1, ("a", "b"): 1, ("b", "b"): 2, ("c", "a"): 1}


def test_nearest_and_tomek(spark):
    points = [(1, 0, [0.0]), (2, 1, [1.0]), (3, 0, [5.0]), (4, 0, [5.5]), (5, 1, [5.5])]
    rows = spark.createDataFrame(points, "vec_id long, label int, vec array<double>")
    for block in (2, 100):
        nn = {r.q: (r.r, r.distance) for r in pairs.nearest(rows, rows, "vec_id", "vec",
                                                            block_rows=block).collect()}
        assert nn == {1: (2, 1.0), 2: (1, 1.0), 3: (4, 0.5), 4: (5, 0.0), 5: (4, 0.0)}
    one = pairs.nearest(rows.filter("vec_id = 3"), rows.filter("vec_id < 3"), "vec_id", "vec", k=2)
    assert [(r.r, r.distance, r["rank"]) for r in one.orderBy("rank").collect()] == [
        (2, 4.0, 1), (1, 5.0, 2)]
    near = pairs.nearest(rows, rows, "vec_id", "vec")
    links = classify.tomek_links(near, rows)
    assert {(x.left_id, x.right_id) for x in links.collect()} == {(1, 2), (4, 5)}
    left = classify.without_links(rows, links, both=True)
    assert {r.vec_id for r in left.collect()} == {3}
    # Class 1 is the minority: its members stay.
    left = classify.without_links(rows, links)
    assert {r.vec_id for r in left.collect()} == {2, 3, 5}


def test_encoder(spark):
    words = ["b", "a", "b", "c", "b", "a", "d"]
    toks = spark.createDataFrame([(1, i, w) for i, w in enumerate(words)],
                                 "doc long, pos long, token string")
    v = encode.build_vocabulary(toks, min_frequency=2)
    assert {r.token: r.id for r in v.collect()} == {"b": 2, "a": 3}
    e = encode.encode(toks, v, ["doc"]).first()
    assert e.ids == [2, 3, 2, 0, 2, 3, 0]
    two = spark.createDataFrame([(1, 0, 0, "b"), (1, 0, 1, "d"), (1, 2, 0, "a"), (2, 5, None, None),
                                 (3, 1, 0, "b"), (3, 1, 1, "a"), (3, 1, 2, "b")],
                                "doc long, sent long, pos long, token string")
    got = {r.doc: (r.n_sentences, r.ids) for r in encode.encode_bilevel(
        two, v, "doc", "sent").collect()}
    assert got == {1: (2, [[2, 0, 1], [3, 1, 1]]), 2: (1, [[1, 1, 1], [1, 1, 1]]),
                   3: (1, [[2, 3, 2], [1, 1, 1]])}
    cut = encode.encode_bilevel(two, v, "doc", "sent", sentences=1, words=2)
    assert {r.doc: r.ids for r in cut.collect()} == {1: [[2, 0]], 2: [[1, 1]], 3: [[2, 3]]}
    assert encode.encode_bilevel(two.where("false"), v, "doc", "sent").count() == 0
    padded = spark.createDataFrame([([2, 3],)], "ids array<bigint>").select(
        encode.pad(F.col("ids"), 4).alias("p")).first().p
    assert padded == [2, 3, 1, 1]


@pytest.mark.parametrize("k", [1, 3])
def test_screened_nearest_is_exact(spark, k):
    """Close ties, equal rows and long vectors: as if every distance were computed."""
    rng = np.random.default_rng(k)
    x = rng.normal(size=(90, 12))
    x[30:60] = x[:30] + rng.choice([0.0, 1e-7, 1e-6, 2e-6], (30, 1))
    x[60:70] *= 1e4
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                 "vec_id long, vec array<double>")
    d = np.round(pairs.distance_matrix(x, x, "euclidean"), 6)
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    truth = {(i, int(j), n + 1) for i in range(90) for n, j in enumerate(order[i])}
    for block in (16, 1024):
        got = pairs.nearest(rows, rows, "vec_id", "vec", k, "euclidean", digits=6, block_rows=block)
        assert {(r.q, r.r, r["rank"]) for r in got.collect()} == truth


def test_shuffled_blocks_grow():
    """Copies of a row: 51 GB of vectors at 60,000 x 540,000 rows of 100 numbers before."""
    size = pairs.shuffle_rows(60_000, 540_000, 1024, 100, 128)
    copies = 60_000 * -(-540_000 // size) + 540_000 * -(-60_000 // size)
    assert copies * 800 < 5e9 and -(-540_000 // size) * -(-60_000 // size) >= 128
    assert pairs.shuffle_rows(1000, 9000, 1024, 100, 128) == 1024
    assert pairs.shuffle_rows(10**9, 10**9, 1024, 100, 128) * 100 <= pairs.BLOCK_NUMBERS


def test_city_block_nearest_of_others(spark, monkeypatch):
    """Queries that are no references are searched without all distances; ties go to the lower id."""
    rnd = np.random.default_rng(4)
    x = rnd.integers(0, 3, (90, 5)) / 2
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)],
                                 "vec_id long, vec array<double>")
    got = {r.q: (r.r, r.distance) for r in pairs.nearest(
        rows.filter("vec_id < 30"), rows.filter("vec_id >= 30"), "vec_id", "vec", block_rows=16).collect()}
    want = np.abs(x[:30, None] - x[None, 30:]).sum(axis=2)
    assert got == {q: (30 + int(d.argmin()), d.min()) for q, d in enumerate(want)}

    all_of = pairs.distance_matrix
    none = np.zeros((30, 60), bool)
    own = none.copy()
    own[0, 0] = True
    assert (pairs.first_distances(x[:30], x[30:], own, "cityblock", 9) == want).all()
    monkeypatch.setattr(pairs, "distance_matrix", None)
    d = pairs.first_distances(x[:30], x[30:], none, "cityblock", 9)
    monkeypatch.setattr(pairs, "distance_matrix", all_of)
    assert (np.isfinite(d).sum(axis=1) == 1).all() and (d.min(axis=1) == want.min(axis=1)).all()
