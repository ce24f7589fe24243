"""Resumable tagging.

The reference tags a corpus file by file and skips files whose output
already exists, so an interrupted run resumes.  Two Spark forms:

* ``tag_new_documents`` (batch): anti-join the input against the document
  ids already present in the output table, tag the rest, append.
* ``tag_stream`` (Structured Streaming): a file source over the text
  folder; the query's checkpoint records which files were processed, so a
  restarted query tags only new files, exactly once, and
  ``trigger(availableNow=True)`` drains the backlog and stops.

The tagger is pluggable: a column function (token -> tag), the stand-in rule
by default; ``lexicon_tags`` tags from a lexicon table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.functions.arrays import materialize


def tag_tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text",
               tagger: Callable[[Column], Column] | None = None) -> DataFrame:
    """(doc, pos, token, tag) in text order; default tagger is the fixed rule."""
    toks = docs.select(doc, F.posexplode(T.tokens(F.col(text), lower=False)).alias("pos", "token"))
    if tagger is None:
        toks = toks.withColumn("is_word", T.is_word(F.col("token")))
        return toks.select(doc, "pos", "token", F.expr(T.POS_RULE_SQL.format(
            t="lower(token)", w="is_word")).alias("tag"))
    return toks.withColumn("tag", tagger(F.col("token")))


def lexicon_tags(tokens: DataFrame, lexicon: DataFrame, token: str = "token",
                 unknown: str = "x") -> DataFrame:
    """Tags from a (token, tag) lexicon, tried as written, then in lower case."""
    exact = lexicon.groupBy(F.col("token").alias("_t")).agg(F.min("tag").alias("_tag"))
    low = lexicon.groupBy(F.lower("token").alias("_l")).agg(F.min("tag").alias("_low"))
    return (tokens.join(exact, F.col(token) == F.col("_t"), "left")
            .join(low, F.lower(token) == F.col("_l"), "left")
            .withColumn("tag", F.coalesce("_tag", "_low", F.lit(unknown)))
            .drop("_t", "_tag", "_l", "_low"))


def tag_new_documents(spark: SparkSession, docs: DataFrame, out_path: str,
                      doc: str = "doc_id", text: str = "text", buckets: int = 64) -> int:
    """Batch resume: tag only documents missing from ``out_path``; returns their count.

    Only a path that isn't there means that nothing is done yet; any other
    failure to read the output rises, so no document is tagged twice.  Output
    is partitioned by a hash of the document id, not by document.
    """
    try:
        done = spark.read.parquet(out_path).select(doc).distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        done = None
    todo = materialize(docs if done is None else docs.join(done, doc, "left_anti"))
    n = todo.count()
    if n:
        bucket = F.pmod(F.xxhash64(doc), F.lit(buckets)).alias("bucket")
        (tag_tokens(todo, doc, text).select("*", bucket)
         .write.mode("append").partitionBy("bucket").parquet(out_path))
    return n


def tag_stream(spark: SparkSession, in_dir: str, out_path: str, checkpoint: str,
               available_now: bool = True):
    """Streaming resume: every new text file in ``in_dir`` is tagged once.

    The file name is the document id.  Returns the started query.
    """
    files = (spark.readStream.format("text").option("wholetext", True).load(in_dir)
             .select(F.input_file_name().alias("file"), F.col("value").alias("text")))
    docs = files.select(F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1).alias("doc"), "text")
    tagged = tag_tokens(docs, "doc", "text")
    w = (tagged.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
