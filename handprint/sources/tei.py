"""TEI XML corpora.

One file is one document.  Files are read whole (``wholetext``) and parsed
with Spark's XPath functions; unprefixed element names match the TEI
default namespace.  Cheap structural filters (verse, fragments) run
before the text is extracted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.operators.filters import file_parts

# XPath of the body text with excluded subtrees (S00/S01: label; S04: label,
# note and head).
BODY_TEXT = "//body//text()[not(ancestor::{excl})]"


def read_tei(spark: SparkSession, path: str, exclude=("label",)) -> DataFrame:
    """(file, stem, title, authors ARRAY, text, is_poetry, has_fragment, tokens)."""
    raw = (spark.read.text(path, wholetext=True)
           .select(F.input_file_name().alias("path"), F.col("value").alias("xml")))
    excl = " or ancestor::".join(exclude)
    body = F.array_join(F.xpath("xml", F.lit(BODY_TEXT.format(excl=excl))), "")
    stem = F.regexp_extract("path", r"([^/]+?)(\.xml)?$", 1)
    out = raw.select(
        F.col("path").alias("file"), stem.alias("stem"),
        F.xpath_string("xml", F.lit("//teiHeader//titleStmt/title[1]")).alias("title"),
        F.xpath("xml", F.lit("//teiHeader//titleStmt/author/text()")).alias("authors"),
        F.xpath_boolean("xml", F.lit("//body//l")).alias("is_poetry"),
        F.xpath_boolean("xml", F.lit("//div[@type='fragment']")).alias("has_fragment"),
        "xml")
    return (out.withColumn("text", T.clean_text(body)).drop("xml")
            .withColumn("tokens", T.word_count(F.col("text"))))


def name_columns(df: DataFrame, stem: str = "stem") -> DataFrame:
    """A4: author = before the first '-', title = the second piece, textgroup = first 7
    characters."""
    parts = file_parts(F.col(stem))
    return df.select("*", parts["author"].alias("file_author"), parts["title"].alias("file_title"),
                     parts["textgroup"].alias("textgroup"))


def one_row_per_author(df: DataFrame) -> DataFrame:
    """A2: every author node becomes its own row."""
    return df.withColumn("author", F.explode_outer("authors"))
