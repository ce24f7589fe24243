"""Cluster diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eta2(values: DataFrame, classes: DataFrame, doc: str = "doc_id", feature: str = "feature",
         value: str = "value", cls: str = "cls") -> DataFrame:
    """Correlation ratio of every feature against a class: SS_between / SS_total.

    ``values`` must be dense (every document has every feature), as the
    normalised matrix is.  Per (feature, class) and per feature only
    counts, sums and sums of squares are aggregated.
    """
    v = values.join(classes.select(doc, cls), doc)
    per_c = v.groupBy(feature, cls).agg(F.count(F.lit(1)).alias("nc"), F.sum(value).alias("sc"))
    between = per_c.groupBy(feature).agg(F.sum(F.col("sc") ** 2 / F.col("nc")).alias("b"))
    tot = v.groupBy(feature).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"),
                                 F.sum(F.col(value) ** 2).alias("ss"))
    j = tot.join(between, feature)
    ss_total = F.col("ss") - F.col("s") ** 2 / F.col("n")
    ss_between = F.col("b") - F.col("s") ** 2 / F.col("n")
    return j.select(feature, F.when(ss_total > 0, ss_between / ss_total).alias("eta2"))


def top_eta2(e: DataFrame, n: int, feature: str = "feature") -> DataFrame:
    """The n features with the largest eta2 (a top-k report)."""
    return e.orderBy(F.desc("eta2"), F.asc(feature)).limit(n)


def eta2_to_classes(values: DataFrame, classes: DataFrame, top: DataFrame,
                    doc: str = "doc_id", feature: str = "feature", cls: str = "cls") -> DataFrame:
    """The values of the top features for every document with its class
    (the data behind per-class distribution plots).  ``top`` is a bounded
    top-k table of features, broadcast."""
    t = F.broadcast(top.select(feature).distinct())
    return values.join(t, feature, "left_semi").join(classes.select(doc, cls), doc)
