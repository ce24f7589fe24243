"""Feature selection: MOISL (E10-E11), corpus ranking (E12), pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moisl(values: DataFrame, docs: DataFrame, z: float = 1.96, doc: str = "doc_id",
          feature: str = "feature", value: str = "n") -> DataFrame:
    """MOISL sample-size test per feature.

    ``values`` is the long count matrix (doc, feature, n) with absent = 0;
    ``docs`` lists every document (row) of the matrix, including those with
    no feature at all.  For each feature with shares x (n / document total,
    0/0 -> 0) over all N documents the reference mirrors the sample about
    m = (max + min) / 2 and takes e = 2 * std(ddof=1) of the 2N points, so

        score = m (1 - m) z^2 (2N - 1) / (8 * sum((x - m)^2))

    One pass over the long table suffices: sum, sum of squares, min, max
    and the row count per feature (min is 0 when a document lacks it).
    keep = score <= the smallest document total.

    Returns (feature, freq, mean_prob, score, keep).
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    w = Window.partitionBy(doc)
    shares = (values.withColumn("tot", F.sum(value).over(w))
              .withColumn("x", F.when(F.col("tot") > 0, F.col(value) / F.col("tot"))
                          .otherwise(F.lit(0.0))))
    totals = values.groupBy(doc).agg(F.sum(value).alias("tot"))
    min_total = totals.select(
        F.when(F.count(F.lit(1)) < n_docs, F.lit(0)).otherwise(F.min("tot"))).scalar()
    stats = shares.groupBy(feature).agg(
        F.sum(value).cast("bigint").alias("freq"),
        F.sum("x").alias("s1"), F.sum(F.col("x") * F.col("x")).alias("s2"),
        F.count(F.lit(1)).alias("rows"), F.max("x").alias("mx"), F.min("x").alias("mn"))
    m = (F.col("mx") + F.when(F.col("rows") < n_docs, F.lit(0.0)).otherwise(F.col("mn"))) / 2
    ss = F.col("s2") - 2 * F.col("m") * F.col("s1") + n_docs * F.col("m") * F.col("m")
    score = F.when(F.col("ss") > 0, F.col("m") * (1 - F.col("m")) * (z * z) * (2 * n_docs - 1)
                   / (8 * F.col("ss")))
    return (stats.withColumn("m", m).withColumn("ss", ss)
            .select(feature, "freq", (F.col("s1") / n_docs).alias("mean_prob"),
                    score.alias("score"))
            .withColumn("keep", F.coalesce(F.col("score") <= min_total, F.lit(False))))


def ranked_features(values: DataFrame, k: int, feature: str = "feature",
                    value: str = "n") -> DataFrame:
    """Top-k features by corpus total (ties by name), with rank."""
    from handprint.operators.vocab import top_terms
    tot = values.groupBy(feature).agg(F.sum(value).alias("n"))
    return top_terms(tot, k, feature)


def drop_low(values: DataFrame, docs: DataFrame, documents_min: float = 1,
             frequency_min: float = 10, doc: str = "doc_id", feature: str = "feature",
             value: str = "value", mode: str = "distinct_values") -> DataFrame:
    """Keep features with corpus sum > frequency_min and enough spread.

    ``mode='distinct_values'`` (reference behaviour): the number of distinct
    values of the feature column (0 counts when some document lacks it) must
    exceed documents_min; a float documents_min is a share of documents,
    rounded.  ``mode='documents'`` counts documents with a non-zero value.
    Returns the surviving rows of ``values``.
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    per = values.groupBy(feature).agg(
        F.sum(value).alias("total"), F.count_distinct(value).alias("nd"),
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) == 0).alias("zeros"))
    if isinstance(documents_min, float):
        need = F.bround(n_docs * F.lit(documents_min))  # Python round: half to even
    else:
        need = F.lit(documents_min)
    if mode == "documents":
        spread = F.col("rows") - F.col("zeros")
    else:
        spread = F.col("nd") + F.when((F.col("rows") < n_docs) & (F.col("zeros") == 0), 1).otherwise(0)
    keep = per.filter((F.col("total") > frequency_min) & (spread > need)).select(feature)
    return values.join(keep, feature, "left_semi")
