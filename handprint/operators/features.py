"""Feature tables: shares, z-scores, L2, alignment, merging.

The working representation is long (doc, feature, value) with absent = 0.
Z-scores make absent cells non-zero (-mean/std), so the normalised matrix
is assembled per document as a dense vector over a *bounded* feature list
(ranked, selected features), from the document's own present cells plus a
per-feature default array; no document x feature cross product is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handprint.functions.arrays import bind


def relative(values: DataFrame, doc: str = "doc_id", value: str = "value",
             out: str = "value") -> DataFrame:
    """Value / document total, 0/0 -> 0 (windowed per document)."""
    tot = F.sum(value).over(Window.partitionBy(doc))
    return values.withColumn(out, F.when(tot != 0, F.col(value) / tot).otherwise(F.lit(0.0)))


def feature_index(features: DataFrame, feature: str = "feature",
                  order: Column | None = None) -> DataFrame:
    """Number a bounded feature list 1..K (by ``order``, default name)."""
    w = Window.orderBy(order if order is not None else F.col(feature))
    return features.select(feature).distinct().withColumn("idx", F.row_number().over(w))


def feature_stats(values: DataFrame, n_docs: Column, feature: str = "feature",
                  value: str = "value", ddof: int = 1) -> DataFrame:
    """Per feature mean and std over all n_docs documents (zeros included).

    Two aggregates over the long table: the mean first, then the centred
    sum of squares (absent cells contribute mean^2 each), which avoids the
    cancellation of sum(x^2) - n*mean^2.
    """
    mean = values.groupBy(feature).agg((F.sum(value) / n_docs).alias("mean"),
                                       F.count(F.lit(1)).alias("rows"))
    centred = (values.join(mean, feature)
               .groupBy(feature, "mean", "rows")
               .agg(F.sum((F.col(value) - F.col("mean")) ** 2).alias("ss_present")))
    ss = F.col("ss_present") + (n_docs - F.col("rows")) * F.col("mean") ** 2
    # Too few documents for the divisor: no spread is known, std is null.
    std = F.when(n_docs > ddof, F.sqrt(ss / F.nullif(n_docs - ddof, F.lit(0))))
    return centred.select(feature, "mean", std.alias("std"))


def dense_vectors(values: DataFrame, docs: DataFrame, index: DataFrame,
                  default: DataFrame | None = None, doc: str = "doc_id",
                  feature: str = "feature", value: str = "value") -> DataFrame:
    """(doc, vec): vec[i-1] = value of feature idx i, else the default.

    ``index`` is (feature, idx) with idx = 1..K, K bounded; ``default`` is
    (idx, d) giving the value of absent cells (0 when omitted).  Per
    document only its own present cells are collected (at most K).
    """
    k = index.select(F.max("idx")).scalar()
    if default is None:
        defaults = F.array_repeat(F.lit(0.0), k.cast("int"))
    else:
        defaults = default.select(
            F.transform(F.array_sort(F.collect_list(F.struct("idx", "d"))),
                        lambda s: s["d"])).scalar()
    present = (values.join(index, feature)
               .groupBy(doc).agg(F.map_from_entries(
                   F.collect_list(F.struct(F.col("idx"), F.col(value).cast("double"))))
                   .alias("cells")))
    # Subqueries may not sit inside a lambda: bind them to columns first.
    dflt = F.col("dflt")
    return (docs.select(doc).join(present, doc, "left")
            .withColumn("dflt", defaults)
            .withColumn("ids", F.sequence(F.lit(1), k.cast("int")))
            .select(doc, F.transform("ids", lambda i: F.coalesce(F.col("cells")[i], dflt[i - 1]))
                    .alias("vec")))


def zscore_vectors(values: DataFrame, docs: DataFrame, index: DataFrame,
                   doc: str = "doc_id", feature: str = "feature",
                   value: str = "value", ddof: int = 1) -> DataFrame:
    """(doc, vec) of (x - mean) / std per feature, features of ``index`` only.

    Zero-variance features must be removed beforehand (see ``non_constant``).
    """
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    vals = values.join(index.select(feature), feature, "left_semi")
    st = feature_stats(vals, n_docs, feature, value, ddof)
    z = (vals.join(st, feature)
         .select(doc, feature, ((F.col(value) - F.col("mean")) / F.col("std")).alias(value)))
    default = (st.join(index, feature)
               .select("idx", (-F.col("mean") / F.col("std")).alias("d")))
    return dense_vectors(z, docs, index, default, doc, feature, value)


def non_constant(values: DataFrame, docs: DataFrame, feature: str = "feature",
                 value: str = "value") -> DataFrame:
    """Q5: features whose values are not all equal over all documents."""
    n_docs = docs.select(F.count(F.lit(1))).scalar()
    per = values.groupBy(feature).agg(F.count(F.lit(1)).alias("rows"),
                                      F.min(value).alias("mn"), F.max(value).alias("mx"))
    full = F.col("rows") == n_docs
    constant = (full & (F.col("mn") == F.col("mx"))) | (~full & (F.col("mn") == 0)
                                                        & (F.col("mx") == 0))
    return per.filter(~constant).select(feature)


def l2(vecs: DataFrame, vec: str = "vec") -> DataFrame:
    """E9 second half: divide each vector by its Euclidean norm (0 stays 0).

    The norm is bound once per row, not re-aggregated per element.
    """
    keep = [c for c in vecs.columns if c != vec]
    b = bind(vecs, keep + [vec],
             _norm=F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)))
    return b.select(*keep, F.transform(vec, lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm"))
                                       .otherwise(F.lit(0.0))).alias(vec))


def vectors_to_long(vecs: DataFrame, index: DataFrame, doc: str = "doc_id",
                    feature: str = "feature", value: str = "value",
                    vec: str = "vec") -> DataFrame:
    """Dense vectors back to (doc, feature, value) through the bounded index."""
    cells = vecs.select(doc, F.posexplode(vec).alias("p", value))
    return (cells.join(index, F.col("p") + 1 == F.col("idx"))
            .select(doc, feature, value))


def align(values: DataFrame, vocabulary: DataFrame, feature: str = "feature") -> DataFrame:
    """Restrict a long table to a model's vocabulary (missing = 0 implicitly)."""
    return values.join(vocabulary.select(feature).distinct(), feature, "left_semi")


def missing_features(vocabulary: DataFrame, values: DataFrame,
                     feature: str = "feature") -> DataFrame:
    """H2: features of the vocabulary that the table never has."""
    return vocabulary.select(feature).distinct().join(values.select(feature), feature, "left_anti")


def merge(first: DataFrame, other: DataFrame, feature: str = "feature") -> DataFrame:
    """H1: append ``other`` aligned to ``first``'s features."""
    aligned = align(other, first.select(feature), feature)
    return first.unionByName(aligned, allowMissingColumns=True)


def wide(values: DataFrame, features: list[str], doc: str = "doc_id",
         feature: str = "feature", value: str = "value") -> DataFrame:
    """Pivot to one column per feature (explicit, bounded list), absent = 0."""
    return (values.groupBy(doc).pivot(feature, features).agg(F.first(value))
            .fillna(0.0, subset=features))
