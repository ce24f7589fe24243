"""Exact ranks without one-task windows.

``row_number() over (partition by g order by k)`` puts a whole group in one
task; when one group holds a third of the rows that task holds a third of
the data.  ``rank_within`` instead range-partitions on (g, k) (a hot group
is spread over many partitions), numbers rows inside each partition, adds
the per-partition offsets (a table with one row per partition) and
subtracts the first global rank of each group.  The order must be total:
pass a unique tie-breaker as the last order column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LOW_BITS = (1 << 33) - 1


def _as_cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def global_rank(df: DataFrame, order: list, rank: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based rank of every row in the total order ``order`` (distributed)."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _as_cols(order)
    ranged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = (ranged.withColumn("_pid", F.shiftright(F.col("_mid"), 33))
              .withColumn("_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS))))
    # The ids depend on the physical partitioning; it is read twice below
    # (counts and rows), so pin it in the checkpoint folder.  Both reads then
    # see the same ids, also after a lost executor.
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: a window without partitioning is fine here.
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n"))
                            .alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(rank, (F.col("_off") + F.col("_local") + 1).cast("bigint"))
            .drop("_mid", "_pid", "_local", "_off"))


def rank_within(df: DataFrame, group: list[str], order: list, rank: str = "rank",
                size: str | None = "group_size") -> DataFrame:
    """1-based rank inside each group, plus the group size (optional).

    ``global_rank`` checkpoints its numbered rows, so a recomputation after
    a lost executor yields the same ranks.
    """
    ranked = global_rank(df, list(group) + list(order), "_g")
    firsts = ranked.groupBy(*group).agg(F.min("_g").alias("_first"),
                                        F.count(F.lit(1)).alias("_size"))
    out = (ranked.join(firsts, list(group))
           .withColumn(rank, F.col("_g") - F.col("_first") + 1))
    if size:
        out = out.withColumnRenamed("_size", size)
    else:
        out = out.drop("_size")
    return out.drop("_g", "_first")


def prefix_sum(df: DataFrame, order: list, values: list[str], suffix: str = "_cum",
               partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` in the total order ``order``.

    Two levels: range partitions sum locally (window per partition id),
    then each adds the totals of the partitions before it (a table with one
    row per partition).  No task ever sees more than one range partition.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _as_cols(order)
    ranged = df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)  # partition ids are read twice
    w = (Window.partitionBy("_pid").orderBy(*keys)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.select("*", *[F.sum(v).over(w).alias(f"_l_{v}") for v in values])
    tot = ranged.groupBy("_pid").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    wo = Window.orderBy("_pid")
    off = tot.select("_pid", *[(F.sum(f"_t_{v}").over(wo) - F.col(f"_t_{v}")).alias(f"_o_{v}")
                               for v in values])
    out = local.join(F.broadcast(off), "_pid")
    for v in values:
        out = out.withColumn(v + suffix, F.col(f"_l_{v}") + F.col(f"_o_{v}"))
    return out.drop("_pid", *[f"_l_{v}" for v in values], *[f"_o_{v}" for v in values])
