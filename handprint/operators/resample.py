"""SMOTE and SMOTE with Tomek links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handprint.functions.arrays import materialize
from handprint.functions.hashing import hash_key, hash_unit
from handprint.operators import classify, pairs
from handprint.operators.ranking import rank_within


def class_neighbours(rows: DataFrame, row_id: str, target: str, vec: str, k: int = 5,
                     digits: int = 9, block_rows: int = 1024) -> DataFrame:
    """(q, r, rank): the k nearest rows of the same class (Euclidean, ties by id).

    k rows per query leave a block of rows, whatever the class's size."""
    t = rows.schema[row_id].dataType.simpleString()

    def screened(lhs, rhs, a, b, own):
        other = lhs[target].to_numpy()[:, None] != rhs[target].to_numpy()[None, :]
        return pairs.near_distances(a, b, own | other, k, digits)

    def best(lhs, rhs, d):
        i, j, d = pairs.first_columns(np.round(d, digits), k)
        return pd.DataFrame({"q": lhs[row_id].to_numpy()[i], "r": rhs[row_id].to_numpy()[j],
                             "distance": d})
    near = pairs.blocked(rows, rows, row_id, vec, best, f"q {t}, r {t}, distance double", [target],
                         "euclidean", False, block_rows, screened, pairs.nearest_of(k))
    w = Window.partitionBy("q").orderBy("distance", "r")
    return (near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("q", "r", "rank"))


def smote(rows: DataFrame, row_id: str, target: str, vec: str = "vec", k: int = 5,
          seed: int = 42) -> DataFrame:
    """(id, copy, target, vec): the rows (copy 0) and synthetic ones (copy 1..).

    Every class grows to the largest one.  Rows in md5 order take turns as
    base; a synthetic row lies between its base and one of the base's k
    nearest of the class, both neighbour and place chosen by md5.  A class of
    one row repeats it.
    """
    base = rows.select(row_id, target, F.col(vec).cast("array<double>").alias("vec"))
    largest = base.groupBy(target).count().agg(F.max("count").alias("n")).first()["n"] or 0
    ranked = rank_within(base.withColumn("_h", hash_key(seed, row_id)), [target], ["_h", row_id],
                         rank="_r", size="_n")
    new = F.lit(largest) - F.col("_n")
    turns = F.floor(new / F.col("_n")) + (F.col("_r") <= new % F.col("_n")).cast("int")
    made = (ranked.withColumn("_t", turns.cast("int")).filter("_t > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_t")))))
    choices = F.least(F.lit(k), F.col("_n") - 1)
    digits = F.conv(F.substring(hash_key(seed, row_id, "copy"), 1, 8), 16, 10).cast("bigint")
    made = made.select(
        row_id, "copy", target, "vec",
        F.when(choices > 0, digits % F.greatest(choices, F.lit(1)) + 1).alias("_nb"),
        hash_unit(f"{seed}:place", row_id, "copy").alias("_u"))
    near = class_neighbours(base, row_id, target, "vec", k)
    other = base.select(F.col(row_id).alias("r"), F.col("vec").alias("_v"))
    met = (made.join(near, (made[row_id] == near["q"]) & (made["_nb"] == near["rank"]), "left")
           .join(other, "r", "left"))
    # The place is a column of the row: bound before the arrays are zipped.
    vecs = F.zip_with("vec", F.coalesce("_v", "vec"), lambda a, b: a + F.col("_u") * (b - a))
    grown = met.select(row_id, "copy", target, vecs.alias("vec"))
    return base.select(row_id, F.lit(0).alias("copy"), target, "vec").unionByName(grown)


def smote_tomek(rows: DataFrame, row_id: str, target: str, vec: str = "vec", k: int = 5,
                seed: int = 42) -> DataFrame:
    """SMOTE, then both ends of every Tomek link go."""
    grown = smote(rows, row_id, target, vec, k, seed)
    key = F.concat_ws("#", F.lpad(F.col(row_id).cast("string"), 20, "0"),
                      F.lpad(F.col("copy").cast("string"), 10, "0"))
    grown = materialize(grown.withColumn("_key", key))
    near = pairs.nearest(grown, grown, "_key", "vec", 1, "euclidean", digits=6)
    links = classify.tomek_links(near, grown.select("_key", target), "_key", target)
    return classify.without_links(grown, links, "_key", both=True).drop("_key")
