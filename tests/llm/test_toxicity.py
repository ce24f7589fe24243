import math
import random
from collections import Counter

import numpy as np
import pytest

from handprint.llm import toxicity
from handprint.llm.queries import QUERIES
from handprint.llm.toxicity import BlockMaxIndex, score_toxicity, terms
from tests.llm.conftest import make_docs


def vectors(n, n_terms, seed):
    rnd = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        t = np.unique(rnd.integers(0, n_terms, rnd.integers(0, 12)))
        w = rnd.random(len(t)) + 0.1
        out.append((t, w / np.sqrt(w @ w)) if len(t) else (t, np.zeros(0)))
    return out


@pytest.mark.parametrize("n_terms", [40, 60, 3000])
def test_index_gives_the_exact_nearest(n_terms):
    held, asked = vectors(700, n_terms, 1), vectors(200, n_terms, 2) + vectors(700, n_terms, 1)[:20]
    index = BlockMaxIndex(held, n_terms)
    assert n_terms > 40 or len(index.greatest) > 0
    dense = np.zeros((700, n_terms))
    for i, (t, w) in enumerate(held):
        dense[i, t] = w
    for k in (1, 16, 2000):
        for (t, w), (ids, sims, most) in zip(asked, index.nearest(asked, k), strict=True):
            full = np.zeros(n_terms)
            full[t] = w
            cosine = dense @ full
            assert np.allclose(sims, np.sort(cosine[cosine > 1e-12])[::-1][:k])
            assert np.allclose(cosine[ids], sims)
            assert np.allclose((dense[ids] * full)[:, index.rare].max(axis=1, initial=0), most)
    assert all(i not in ids for i, (ids, _, _) in enumerate(index.nearest(held, 16, skip=0)))


def test_skip_may_name_any_example():
    held = vectors(300, 40, 1)
    index = BlockMaxIndex(held, 40)
    every = list(index.nearest(held, 16, skip=0))
    some = [7, 299, 0, 120]
    for i, (ids, sims, _) in zip(some, index.nearest([held[i] for i in some], 16, some), strict=True):
        assert i not in ids and np.array_equal(ids, every[i][0]) and np.array_equal(sims, every[i][1])


def test_driver_makes_no_index(spark, monkeypatch):
    """The index is many times what it is made of; only workers hold it."""
    def refuse(*_):
        raise AssertionError("index made at the driver")
    monkeypatch.setattr(toxicity.BlockMaxIndex, "__init__", refuse)
    docs, _, labels, _ = labelled(spark)
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and {r.predicted for r in got} == {0, 1}


def test_index_visits_few_blocks_of_other_kinds():
    """Texts of one kind end their search before the blocks of the others."""
    rnd = np.random.default_rng(3)
    held = []
    for i in range(4096):
        t = np.unique(np.r_[np.arange(4), 4 + (i % 4) * 25 + rnd.integers(0, 25, 25)])
        w = np.r_[np.full(4, 0.3), rnd.random(len(t) - 4) + 0.5]
        held.append((t, w / np.sqrt(w @ w)))
    index = BlockMaxIndex(held, 104)
    assert len(index.greatest) > 50
    list(index.nearest(held[:256], 16))
    assert index.visited < 256 * index.blocks / 2


def labelled(spark):
    rnd = random.Random(6)
    clean = [f"wort{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        words = [rnd.choice(clean) for _ in range(rnd.randint(5, 80))]
        bad = i % 8 == 0
        if bad:
            words[rnd.randrange(len(words))] = rnd.choice(["scum", "loser", "schuftig", "schuften"])
            words.append(rnd.choice(["scum", "loser", "schufte"]))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, int(bad)))
    rows += [(10_000, "", "a"), (10_001, None, "a"), (None, "scum loser", "a"), (3, "scum loser", "b"),
             (10_002, "scum " * 50_000, "a")]
    labels += [(None, 1), (5, None), (77_777, 1)]
    return (make_docs(spark, rows), rows,
            spark.createDataFrame(labels, "doc_id bigint, toxic int"), dict(labels[:700]))


def test_scores(spark):
    docs, rows, labels, truth = labelled(spark)
    got = score_toxicity(docs, labels.where("doc_id % 5 <> 0")).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id in truth and r.doc_id % 5 == 0]
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.95
    by_id = {r.doc_id: r for r in got}
    assert by_id[10_000].score == by_id[10_001].score < 0.5 and by_id[10_000].evidence == []
    assert by_id[None].predicted == by_id[10_002].predicted == 1
    assert all(truth[e] or e == 3 for e in by_id[None].evidence)
    assert sorted(map(str, got)) == sorted(map(str, score_toxicity(
        docs.repartition(9), labels.where("doc_id % 5 <> 0")).collect()))


def brute_cosine(rows, sample):
    """(id, text) -> {example id: cosine} over all terms, frequencies over all rows."""
    held = [terms(t) for _, t, _ in rows]
    df = Counter(t for h in held for t in h)

    def vector(text):
        w = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1)
             for t, n in terms(text).items()}
        size = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / size for t, x in w.items()}
    known = {i: vector(t) for i, t in sample.items()}
    return {i: {e: sum(x * v.get(t, 0) for t, x in vector(text).items())
                for e, v in known.items()} for i, text, _ in rows}


def test_cosine_is_of_whole_texts(spark):
    """Copies of clean examples find them; terms no example holds lengthen a text's vector."""
    docs, rows, labels, _ = labelled(spark)
    rows = [r for r in rows if r[0] is not None and r[0] < 700 and r[2] == "a"]
    rows += [(20_000, rows[11][1], "a"), (20_001, rows[13][1] + " never seen by any example", "a"),
             (20_002, "never seen", "a")]
    few = labels.where("doc_id < 60 and toxic is not null")
    got = {r.doc_id: r for r in score_toxicity(make_docs(spark, rows).repartition(5), few).collect()}
    want = brute_cosine(rows, {i: t for i, t, _ in rows if i < 60})
    assert got[20_000].evidence[0] == 11 and abs(got[20_000].similarity[0] - 1) < 1e-9
    assert got[20_001].evidence[0] == 13 and got[20_001].similarity[0] < 0.99
    assert got[20_002].evidence == []
    for i, near in want.items():
        best = sorted((c for c in near.values() if c > 1e-12), reverse=True)[:5]
        assert np.allclose(got[i].similarity, best, atol=1e-8)
        assert np.allclose([near[e] for e in got[i].evidence], best, atol=1e-8)


def test_sample_bound_holds(spark):
    docs, _, labels, _ = labelled(spark)
    got = score_toxicity(docs, labels, examples=64).collect()
    assert len({e for r in got for e in r.evidence}) <= 64


@pytest.mark.parametrize("where", ["false", "toxic = 0", "toxic = 1"])
def test_without_both_labels(spark, where):
    docs, rows, labels, _ = labelled(spark)
    got = score_toxicity(docs, labels.where(where)).collect()
    assert len(got) == len(rows) and len({r.score for r in got}) == 1


def test_empty(no_docs, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert score_toxicity(no_docs, labels).count() == 0


def test_terms():
    assert terms("Scum, scum ab") == Counter({"scum": 2, "scum*": 2, "ab": 1})
    assert terms(None) == Counter()


def test_held_out_accuracy(spark):
    """On the given rows that no fit has seen."""
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in QUERIES["op10_toxicity"](spark, sf).collect()
           if r.held_out and r.doc_id in truth]
    right = sum(r.predicted == truth[r.doc_id] for r in got) / len(got)
    loss = -sum(math.log(r.score if truth[r.doc_id] else 1 - r.score) for r in got) / len(got)
    base = sum(truth.values()) / len(truth)
    assert right >= 1 - base
    assert loss < -(base * math.log(base) + (1 - base) * math.log(1 - base)) + 0.05
    assert toxicity.EXAMPLES == 8192
