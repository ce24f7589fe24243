"""Corpus pipeline: quality rules, exact dedup, near dedup, mixing, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All stages but the last return the columns of ``documents``.
Every stage treats null ids and texts, empty tables, repeated rows and extra
columns as the operator it calls does; rows are known by a 128-bit key of their
id and text, so of rows alike in both the dedup stages keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handprint.llm.common import pinned, read, row_key
from handprint.llm.exact import exact_dedup
from handprint.llm.mixture import mixture, repeated
from handprint.llm.pieces import piece_tokens
from handprint.llm.quality import quality_rules, without_lines
from handprint.llm.simhash import simhash_near_dedup

KEY = "__pipeline_key"


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(KEY, row_key(docs["doc_id"], docs["text"]))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; kept ones lose their lines above the limit.

    ``n_chars`` follows the text where lines were removed.
    """
    keep = quality_rules(docs).where("kept").select(
        F.col("row_key").alias("__row"), F.col("frequent").alias("__frequent"))
    keep = keep.dropDuplicates(["__row"])
    met = _keyed(docs).join(keep, F.col(KEY) == F.col("__row"))
    cut = F.size("__frequent") > 0
    out = met.withColumn("__text", F.when(cut, without_lines(F.col("text"), F.col("__frequent")))
                         .otherwise(F.col("text")))
    changed = {"text": F.col("__text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(cut, F.length("__text").cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays (null and empty texts are equal)."""
    stay = exact_dedup(docs).where("kept").select(F.col("row_key").alias("__row")).distinct()
    met = _keyed(docs).join(stay, F.col(KEY) == F.col("__row"), "left_semi")
    return met.dropDuplicates([KEY]).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the document with the smallest id stays (nulls last).

    Components are told apart by their root, so documents that share an id, or
    have none, but not their component, all stay.
    """
    rows = simhash_near_dedup(docs)
    named = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"),
                     F.col("row_key").alias("k"))
    stay = rows.groupBy("root").agg(F.min(named)["k"].alias("__row")).select("__row")
    met = _keyed(docs).join(stay, F.col(KEY) == F.col("__row"), "left_semi")
    return met.dropDuplicates([KEY]).select(*[F.col(f"`{c}`") for c in docs.columns])


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; empty texts have no words and go."""
    return repeated(docs, mixture(docs))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every emitted document, with the digests of ids and decoded text.

    A null or empty text has no ids.
    """
    return piece_tokens(docs, ids=True)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage),
          ("mixture", mixture_stage), ("tokens", token_stage)]

#: SQL has neither XXH64, the SentencePiece encoder nor the pipeline's seeded draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = pinned(docs, f"stage-{name}")
    return docs
