"""Text scalars, samples, splits and folds: goldens of FIXTURES.md and rules."""

from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.operators import samples, splits


def test_samples_rule(spark):
    # 20 tokens, every 4th is punctuation; samples of 5 words -> 6, 7, 6 tokens.
    toks = []
    for i in range(5):
        toks += [f"w{3 * i}", f"w{3 * i + 1}", f"w{3 * i + 2}", "."]
    docs = spark.createDataFrame([(1, " ".join(toks))], "doc_id long, text string")
    plan = samples.sample_tokens(samples.plan_samples(docs, size=5, max_samples=5, margin=0))
    got = sorted((r.sample, len(r.toks), r.toks[-1]) for r in plan.collect())
    assert [g[1] for g in got] == [6, 7, 6]
    assert [g[0] for g in got] == [0, 1, 2]
    assert got[-1][2] == "w14"  # the final '.' opens an incomplete sample: dropped


def test_texts_too_short_for_a_sample_are_not_tokenised(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b "), (3, "abcdefgh"), (4, None)],
                                 "doc_id long, text string")
    plan = samples.plan_samples(docs, size=3, margin=0)
    assert "length(lower(text" in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r.toks) for r in plan.collect()] == [(1, ["a", "b", "c"])]
    assert samples.plan_samples(docs, size=3, whole=True).count() == 4


def test_sentence_tokens_golden(spark):
    df = spark.createDataFrame([(".Hello... I am James Bond; Junior.",)], "t string")
    got = df.select(T.sentence_tokens(F.col("t")).alias("s")).first().s
    assert got == [["Hello"], ["I", "am", "James", "Bond"], ["Junior"]]


def test_sentence_split_keeps_delimiter(spark):
    df = spark.createDataFrame([("One. Two? Three!",)], "t string")
    assert df.select(T.sentences(F.col("t")).alias("s")).first().s == ["One.", "Two?", "Three!"]


def test_kfold_roles_golden(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(4)], "doc_id long, author string")
    r = splits.kfold_roles(rows, "author", "doc_id", k=4).collect()
    roles = {}
    for x in r:
        roles.setdefault(x.fold, {"train": [], "dev": [], "test": []})[x.role].append(x.doc_id)
    got = [(sorted(roles[f]["train"]), roles[f]["dev"], roles[f]["test"]) for f in range(4)]
    assert got == [([2, 3], [0], [1]), ([0, 3], [1], [2]), ([0, 1], [2], [3]), ([1, 2], [3], [0])]


def test_contiguous_chunks_7_in_3(spark):
    df = spark.range(7).select(splits.chunk_of(F.col("id"), F.lit(7), 3).alias("c"))
    sizes = sorted(r["count"] for r in df.groupBy("c").count().collect())
    assert sorted(sizes, reverse=True) == [3, 2, 2]
    assert [r.c for r in df.orderBy("id").collect()] == [0, 0, 0, 1, 1, 2, 2]


def test_non_overlapping_count(spark):
    df = spark.createDataFrame([("_aaa_a_",)], "t string")
    assert df.select(T.count_non_overlapping(F.col("t"), F.lit("aa")).alias("n")).first().n == 1


def test_affixes_rule(spark):
    df = spark.createDataFrame([("ab",), ("abcde",), ("a",)], "t string")
    got = [r.a for r in df.select(T.affixes(F.col("t")).alias("a")).collect()]
    assert got == [["ab", "_ab", "ab_"], ["_ab", "de_", "abc", "cde"], ["a"]]


def test_holdout_counts_half_even(spark):
    rows = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(20)],
                                 "doc_id long, t string")
    r = splits.holdout_split(rows, "t", "doc_id", 0.1).groupBy("t", "split").count().collect()
    got = {(x.t, x.split): x["count"] for x in r}
    assert got[("a", "train")] == 4  # round(4.5) = 4
    assert got[("b", "train")] == 14 and got[("b", "holdout")] == 1
