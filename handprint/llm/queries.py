"""Registered queries of this subpackage: one per operator, on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handprint.llm.audit import filter_audit
from handprint.llm.common import read
from handprint.llm.exact import exact_dedup
from handprint.llm.hosts import judge_urls
from handprint.llm.mixture import mixture
from handprint.llm.pieces import piece_tokens
from handprint.llm.quality import quality_rules
from handprint.llm.repeats import remove_repeats
from handprint.llm.runs import word_runs
from handprint.llm.secrets import find_secrets, listed
from handprint.llm.sharding import jump_shards
from handprint.llm.simhash import simhash_near_dedup
from handprint.llm.sql import SQL  # noqa: F401  (read by the entry)
from handprint.llm.toxicity import score_toxicity
from handprint.llm.walks import edit_fingerprints


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards by key, and in 17."""
    out = jump_shards(read(spark, sf_dir, "documents"), 16, grown=17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                      "grown_shard")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all ``documents``."""
    return exact_dedup(read(spark, sf_dir, "documents")).drop("row_key")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and components of all ``documents``."""
    return simhash_near_dedup(read(spark, sf_dir, "documents")).drop("row_key", "root")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``: counts, digest and list of spans."""
    def count(place: int):
        return F.size(F.filter("found", lambda s: s["kind"] == place)).cast("bigint")
    found = find_secrets(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("found")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all ``documents`` and their decoded texts, as digests."""
    return piece_tokens(read(spark, sf_dir, "documents"))


def op6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each of all ``documents``, in words."""
    return mixture(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated passages removed from all ``documents``."""
    return remove_repeats(read(spark, sf_dir, "documents"))


def op8_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: ``labels`` by page_id = doc_id; bad is quality 0 or toxic 1."""
    outcomes = read(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge_urls(read(spark, sf_dir, "pages"), outcomes).select(
        "page_id", "host", "path", "rule", "verdict")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdicts of all ``documents``."""
    return quality_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all ``documents``, learnt from labels that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels = read(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    scored = score_toxicity(read(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score",
                         "predicted", "evidence", "similarity")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of five filters over ``documents``, by source."""
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return filter_audit(read(spark, sf_dir, "documents"), labels)


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in ``documents``, every tenth of which repeats its words."""
    return word_runs(read(spark, sf_dir, "documents"), plant=True).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        "collapsed_sha256")


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit-embedding fingerprints of all ``documents``, their edited texts and near classes."""
    return edit_fingerprints(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_exact_dedup, op3_simhash, op4_secrets,
                                   op5_pieces, op6_mixture, op7_repeats, op8_hosts,
                                   op9_quality, op10_toxicity, op11_filter_audit, op12_runs,
                                   op13_fingerprints)}
