"""Affix occurrences in one pass."""

import random
from collections import Counter

import pytest

from handprint.operators import vocab


def test_affix_occurrences(spark):
    rnd = random.Random(1)
    letters = "ab_cé\U0001f600"
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))) for i in range(200)]
    texts += [(900, None), (901, ""), (902, "aaaa"), (903, "ababa_aba")]
    affixes = ["a", "aa", "aaa", "aba", "_ab", "ab_", "é_a", "\U0001f600a", "zzz", "_"]
    frame = spark.createDataFrame(texts, "doc_id bigint, u string").repartition(4)
    got = {(r.doc_id, r.feature): r.n for r in vocab.affix_occurrences(frame, affixes, "doc_id", "u").collect()}
    assert got == {(i, a): t.count(a) for i, t in texts if t for a in affixes if a in t}
    assert vocab.affix_occurrences(frame, [], "doc_id", "u").count() == 0
    with pytest.raises(ValueError):
        vocab.affix_occurrences(frame, ["long"], "doc_id", "u")


def test_tokenising_has_no_exchange(spark):
    """Word and affix counts shuffle counts, never texts."""
    import re
    import __spark_entry__ as entry
    for name in ("author_counts", "affix_counts", "affix_shares", "pos_trigrams"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        exchanges = re.findall(r"Exchange [^\n]*", plan)
        assert not any("REPARTITION" in e for e in exchanges)


def test_affix_totals_of_repeated_documents(spark):
    """Rows of one document share their total; a text moves as one row."""
    texts = [(1, "_ab_ab_"), (1, "_ab_"), (2, "aaaa"), (None, "ab"), (None, "ab"), (3, None), (4, "")]
    frame = spark.createDataFrame(texts, "doc_id bigint, u string")
    per = vocab.affix_occurrences(frame, ["ab", "_", "aa"], "doc_id", "u", total="tot")
    assert sorted(map(str, map(tuple, per.collect()))) == sorted(map(str, [
        (1, "_", 3, 8), (1, "ab", 2, 8), (1, "_", 2, 8), (1, "ab", 1, 8), (2, "aa", 2, 2),
        (None, "ab", 1, 2), (None, "ab", 1, 2)]))


def test_affixes_are_cut_from_different_words(spark):
    """Words are counted before affixes are cut from them."""
    from handprint.plans.catalogue import _affix_totals
    docs = spark.createDataFrame([("The the _the x! 12",), ("the then",), (None,)], "text string")
    docs = docs.selectExpr("1 as doc_id", "text")
    plan = _affix_totals(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2
    words = "the the _the x 12 the then".split()
    want = Counter()
    for w in words:
        want.update([w] if len(w) <= 3 else [w[:3], w[-3:]])
        want.update(["_" + w[:2], w[-2:] + "_"] if len(w) >= 2 else [])
    assert {r.affix: r.n for r in _affix_totals(docs).collect()} == want


def test_top_word_counts_shuffle_top_words_only(spark):
    """Every word's count per document used to be shuffled and written."""
    docs = spark.createDataFrame([(1, "a a b c"), (1, "a b"), (None, "b c c c"), (2, None)],
                                 "doc_id bigint, text string")
    words = vocab.word_table(docs)
    top = vocab.top_terms(words.groupBy("token").agg({"*": "count"}).toDF("token", "n"), 2)
    counts = vocab.term_counts(vocab.restrict(words, top, bounded=True))
    assert "BroadcastHashJoin" in counts._jdf.queryExecution().executedPlan().toString()
    assert set(map(tuple, counts.collect())) == {(1, "a", 3), (1, "c", 1), (None, "c", 3)}
