from collections import Counter, defaultdict

import pytest

from handprint.llm.mixture import mixture, repeated, source_rates
from tests.llm.conftest import make_docs


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share out, cut, share the excess again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), dict.fromkeys(names, 0.0)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100, None: 40}, {"a": 1, "b": 1000, "c": 5, "d": 0},
    {"a": 0, "b": 0}, {"x": 7}, {"a": 10, "b": 4, "c": 2}, {"a": 5, "b": 2, "c": 1, "d": 5, "é": 9}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    got = {r.source: r.target for r in source_rates(frame).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s])


def test_odd_rows(odd_docs, odd_rows):
    got = mixture(odd_docs).collect()
    size = {t: len((t or "").split(" ")) for _, t, _ in odd_rows}
    import re
    size = {t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in size}
    assert Counter((r.doc_id, r.source, r["size"]) for r in got) == Counter(
        (i, s, size[t]) for i, t, s in odd_rows)
    total = defaultdict(int)
    for _, t, s in odd_rows:
        total[s] += size[t]
    target = brute_targets(total)
    for r in got:
        assert r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken == r.copies * r["size"] <= 2 * r["size"]
        assert int(r.rate) <= r.copies <= int(r.rate) + 1
    assert sorted(map(str, got)) == sorted(map(str, mixture(odd_docs.repartition(3)).collect()))


def test_taken_words_come_near_targets(spark):
    rows = [(i, "word " * (1 + i % 17), f"s{i % 6}") for i in range(12000)]
    docs = make_docs(spark, rows)
    taken, target = Counter(), {}
    for r in mixture(docs).collect():
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s in target:
        assert taken[s] == pytest.approx(target[s], rel=0.06)


def test_repeated_emits_the_copies(odd_docs):
    mixed = mixture(odd_docs)
    want = Counter()
    for r in mixed.collect():
        want[(r.doc_id, r.source)] += r.copies
    out = repeated(odd_docs, mixed)
    assert out.columns == odd_docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == +want


def test_empty(no_docs):
    assert mixture(no_docs).count() == 0
    assert repeated(no_docs, mixture(no_docs)).count() == 0
