"""Splits, folds and resampling.

Every random choice ranks rows by md5(seed|key) (``functions.hashing``);
ranks inside a class come from ``ranking.rank_within`` so a class holding a
third of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handprint.functions.hashing import hash_key
from handprint.operators.ranking import global_rank, rank_within


def group_split(rows: DataFrame, key: str, seed: int = 42, ratio: int = 10,
                min_rows: int = 2) -> DataFrame:
    """split *keys* (authors, titles) into test / dev / train bands.

    Keys with fewer than ``min_rows`` rows always train.  With n eligible
    keys ranked by md5, the first floor(n * ratio%) are test, the next as
    many dev, the rest train (Q8: n_test = 0 leaves everything in train).
    Rows are joined back by key, so no key straddles two splits.
    """
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    elig = per.filter(F.col("_rows") >= min_rows).select(key)
    ranked = global_rank(elig.withColumn("_h", hash_key(seed, key)), ["_h", key], "_r")
    n = elig.select(F.count(F.lit(1))).scalar()
    n_test = F.floor(n * ratio / 100)
    band = (F.when(F.col("_r") <= n_test, "test")
            .when(F.col("_r") <= 2 * n_test, "dev").otherwise("train"))
    keys = ranked.select(key, band.alias("split"))
    return (rows.join(keys, key, "left")
            .withColumn("split", F.coalesce(F.col("split"), F.lit("train"))))


def holdout_split(rows: DataFrame, target: str, row_id: str, ratio: float = 0.1,
                  seed: int = 42) -> DataFrame:
    """per target class keep round_half_even(n * (1 - ratio)) rows in train."""
    r = rank_within(rows.withColumn("_h", hash_key(seed, row_id)), [target], ["_h", row_id])
    keep = F.bround(F.col("group_size") * (1 - ratio))
    return (r.withColumn("split", F.when(F.col("rank") <= keep, "train").otherwise("holdout"))
            .drop("_h"))


def fraction_sample(rows: DataFrame, row_id: str, frac: float, seed: int = 42) -> DataFrame:
    """Exactly round_half_even(frac * n) rows, repeatable."""
    n = rows.select(F.count(F.lit(1))).scalar()
    r = global_rank(rows.withColumn("_h", hash_key(seed, row_id)), ["_h", row_id], "_r")
    return r.filter(F.col("_r") <= F.bround(n * frac)).drop("_h", "_r")


def chunk_of(rank0, size, k: int):
    """Index of the contiguous chunk (ntile rule: the first n mod k chunks are one longer)."""
    q = F.floor(size / k)
    m = size - q * k
    big = m * (q + 1)
    return F.when(rank0 < big, F.floor(rank0 / (q + 1))).otherwise(
        m + F.floor((rank0 - big) / F.greatest(q, F.lit(1))))


def kfold_roles(rows: DataFrame, target: str, order: str, k: int = 5) -> DataFrame:
    """stratified k folds; fold f: dev = chunk f, test = chunk (f+1) mod k, train = rest.

    Rows are numbered inside their target class in ``order``; one output
    row per (row, fold).
    """
    r = rank_within(rows, [target], [order])
    r = r.withColumn("chunk", chunk_of(F.col("rank") - 1, F.col("group_size"), k).cast("int"))
    f = r.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    role = (F.when(F.col("chunk") == F.col("fold"), "dev")
            .when(F.col("chunk") == (F.col("fold") + 1) % k, "test").otherwise("train"))
    return f.withColumn("role", role).drop("rank", "group_size")


def class_sizes(rows: DataFrame, target: str) -> DataFrame:
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n"))


def under_sample(rows: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """every class cut to the smallest class size (md5 order)."""
    smallest = class_sizes(rows, target).select(F.min("n")).scalar()
    r = rank_within(rows.withColumn("_h", hash_key(seed, row_id)), [target], ["_h", row_id],
                    size=None)
    return r.filter(F.col("rank") <= smallest).drop("_h", "rank")


def over_sample(rows: DataFrame, target: str, row_id: str, seed: int = 42) -> DataFrame:
    """F16: every class grown to the largest class size.

    Each row appears floor(max / n) times, plus once more for the first
    (max mod n) rows in md5 order.  ``copy`` numbers the repetitions.
    """
    largest = class_sizes(rows, target).select(F.max("n")).scalar()
    r = rank_within(rows.withColumn("_h", hash_key(seed, row_id)), [target], ["_h", row_id])
    n = F.col("group_size")
    copies = F.floor(largest / n) + F.when(F.col("rank") <= largest - F.floor(largest / n) * n, 1
                                           ).otherwise(0)
    return (r.withColumn("_c", copies.cast("int"))
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_c"))))
            .drop("_h", "rank", "group_size", "_c"))


def m_per_class(rows: DataFrame, target: str, row_id: str, m: int = 4, epochs: int = 2,
                seed: int = 42) -> DataFrame:
    """per epoch, rows of each class in md5 order cut into groups of m.

    Batch b of an epoch holds rows with per-class rank in [b*m, (b+1)*m).
    """
    e = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    r = rank_within(e.withColumn("_h", hash_key(seed, "epoch", row_id)),
                    ["epoch", target], ["_h", row_id], size=None)
    return r.withColumn("batch", F.floor((F.col("rank") - 1) / m).cast("bigint")).drop("_h", "rank")
