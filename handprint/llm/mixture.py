"""Mixing sources to target weights.

Sizes are summed per source, every source gets a repetition rate (its target
over its size), and every document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy whose probability is the rate's fraction.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handprint.llm.common import WORD, narrowed, pinned

WEIGHTS = (5, 2, 1)


def draw(seed: str, row_id: Column, text: Column) -> Column:
    """Uniform number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit("null")),
                            F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
                 most: float = 2.0) -> DataFrame:
    """Per source: source_size, weight, target, rate.

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes.  A target stops at ``most`` times its source's
    size and the excess is shared again by weight until no target is above:
    that ends at min(most * size, level * weight) for one level, found from
    running sums over the sources in order of most * size / weight.  Spark
    compares strings by their UTF-8 bytes, which is code-point order.
    A source without words gets target and rate 0.

    The two windows see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turns = F.array(*[F.lit(float(w)) for w in weights])
    ranked = by_source.withColumn(
        "weight", F.element_at(turns, (place % len(weights) + 1).cast("int"))).withColumn(
        "cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("nth", F.row_number().over(fill))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing)
    zero = F.lit(0.0)
    ranked = ranked.withColumn(
        "level", (F.lit(float(share)) * F.sum("source_size").over(every)
                  - F.coalesce(F.sum("cap").over(before), zero))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), zero)))
    # The first source whose cap reaches the level fixes it; beyond it none is capped.
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"),
                         F.struct("nth", "level"))).over(every)["level"]
    ranked = ranked.withColumn("fixed", level)
    target = F.when(F.col("fixed").isNull(), F.col("cap")).otherwise(
        F.least(F.col("cap"), F.col("fixed") * F.col("weight")))
    return ranked.withColumn("target", target).select(
        "source", "source_size", "weight", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))
        .otherwise(zero).alias("rate"))


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5,
            most: float = 2.0, seed: str = "mix") -> DataFrame:
    """One row per document: id, source, size, source_size, target, rate, copies, taken.

    A size is a number of words; ``copies`` says how often the mix emits the
    document and ``taken`` is copies * size.  Null and empty texts have size 0;
    a null source is a source.  The draw depends on seed, id and text, so
    reruns agree, and rows alike in id and text draw alike.  An empty table
    gives an empty result.  Texts are read once and never shuffled; the join
    is on the source with a table of one row per source, which Spark
    broadcasts by its measured size (else it splits skewed sources).
    """
    base = narrowed(docs, id=id_col, text=text_col, source=source_col)
    sized = pinned(base.select(
        "id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0))
        .cast("bigint").alias("size"), draw(seed, F.col("id"), F.col("text")).alias("u")), "sizes")
    rates = pinned(source_rates(sized, weights, share, most), "rates").withColumnRenamed(
        "source", "of")
    copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("bigint")
    return (sized.join(rates, sized["source"].eqNullSafe(rates["of"]))
            .withColumn("copies", copies)
            .select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size",
                    "source_size", "target", "rate", "copies",
                    (F.col("copies") * F.col("size")).alias("taken")))


def repeated(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id",
             text_col: str = "text", seed: str = "mix", source_col: str = "source") -> DataFrame:
    """``docs`` with every row as often as the mix emits it (columns unchanged).

    ``mixed`` is :func:`mixture` of the same documents; its rates are taken
    per source and every row draws again, with the same outcome.
    """
    rates = (mixed.groupBy(F.col(f"`{source_col}`").alias("__mix_source"))
             .agg(F.max("rate").alias("__mix_rate")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    u = draw(seed, docs[f"`{id_col}`"], docs[f"`{text_col}`"])
    rate = rates["__mix_rate"]
    n = (F.floor(rate) + (u < rate - F.floor(rate)).cast("bigint")).cast("int")
    return (docs.join(rates, docs[f"`{source_col}`"].eqNullSafe(rates["__mix_source"]))
            .withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), n)))
            .select(*names))
