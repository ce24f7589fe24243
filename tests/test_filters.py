"""Corpus filters, text clean-up, feature-table selections and resampling."""

import pytest
from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.operators import filters, resample
from handprint.streaming import resume


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize("text, want", [
    ("ﬁne  Ａ\n\nb ", "fine A b"), ("é  x", "é x"), ("plain\ntext", "plain text"),
    ("a  b", "a b"), ("", ""), (None, None)])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_plain_words(spark):
    assert one(spark, "Touʹto, the-End. of $it", T.plain_words) == ["Tou", "to", "the", "End", "of", "it"]


def test_tag_string(spark):
    tags = F.array(*[F.lit(x) for x in "abcdef"])
    got = spark.range(1).select(T.tag_string(tags, 1, 4), T.tag_string(tags), T.tag_string(tags, 4)).first()
    assert tuple(got) == ("bcd", "abcdef", "ef")


def test_author_rules(spark):
    rule = lambda c: filters.any_substring(c, ("fragm", "ps."), (" et",))
    assert [one(spark, a, rule) for a in ("Homerus", "FRAGMenta x", "A et", "Ps. B", None)] == [
        False, True, True, True, False]
    assert one(spark, "Plutarchus Biogr. et Phil.", filters.clean_author) == "Plutarchus"


def test_file_parts(spark):
    got = spark.createDataFrame([("/x/tlg0007-Moralia-III.xml",), ("alone.xml",)], "p string").select(
        *[c.alias(n) for n, c in filters.file_parts(F.col("p")).items()]).collect()
    assert tuple(got[0]) == ("tlg0007-Moralia-III", "tlg0007", "Moralia", "tlg0007")
    assert tuple(got[1]) == ("alone", "alone", None, "alone")


def test_status(spark):
    def rows(*statuses):
        return spark.createDataFrame([(i, s) for i, s in enumerate(statuses)], "id int, status string")
    assert filters.check_status(rows("test", "test")) == ["test"]
    assert filters.check_status(rows("candidate", "impostor", "test")) == ["candidate", "impostor", "test"]
    for bad in (("candidate", "test"), ("impostor",), ("candidate", "impostor", "other")):
        with pytest.raises(ValueError):
            filters.check_status(rows(*bad))
    many = rows(*["candidate"] * 9, "impostor")
    assert filters.status_subset(many, "candidate", "id").count() == 9
    assert filters.status_subset(many, "candidate", "id", fraction=0.5).count() == 4


def test_family_selection(spark):
    v = spark.createDataFrame([(f, 1.0) for f in ("$MFW$a", "$POS$b", "plain")], "feature string, value double")
    names = lambda df: {r.feature for r in df.collect()}
    assert names(filters.by_family(v, ("$MFW$",))) == {"$MFW$a"}
    assert names(filters.by_family(v, ignore=("$POS$",))) == {"$MFW$a", "plain"}
    idx = spark.createDataFrame([("$A$x", 1), ("$A$y", 2), ("$B$x", 3)], "feature string, idx int")
    assert filters.first_family_change(idx).first()[0] == 2
    assert filters.first_family_change(idx.filter("idx < 3")).first()[0] == -1


def test_unpivot_and_complete(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, 3.0, 4.0)], "id int, a double, b double")
    long = filters.unpivot_features(wide, ["id"])
    assert long.count() == 4
    full = filters.complete_features(long, wide)
    assert {r.feature for r in full.collect()} == {"a"}


def test_lexicon_tags(spark):
    lex = spark.createDataFrame([("the", "l"), ("Rome", "p")], "token string, tag string")
    toks = spark.createDataFrame([("The",), ("Rome",), ("rome",), ("x",)], "token string")
    assert {r.token: r.tag for r in resume.lexicon_tags(toks, lex).collect()} == {
        "The": "l", "Rome": "p", "rome": "p", "x": "x"}


def test_smote_grows_classes_inside_them(spark):
    rows = [(i, 0, [float(i), 0.0]) for i in range(12)] + [(20 + i, 1, [0.0, 10.0 + i]) for i in range(4)]
    rows += [(40, 2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>")
    got = resample.smote(df, "id", "label", k=2).collect()
    assert {c: sum(r.label == c for r in got) for c in (0, 1, 2)} == {0: 12, 1: 12, 2: 12}
    for r in got:
        if r.label == 1:
            assert r.vec[0] == 0.0 and 10.0 <= r.vec[1] <= 13.0
        if r.label == 2:
            assert list(r.vec) == [5.0, 5.0]
    assert sorted(map(str, got)) == sorted(map(str, resample.smote(
        df.repartition(5), "id", "label", k=2).collect()))
