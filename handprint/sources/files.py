"""CSV tables, tagged-token files, ranked vocabularies, stop-word JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A5: CSV with a header; texts may hold newlines and quotes.

    Without a schema all columns are strings, as types would take a second read
    of the file.
    """
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return r.schema(schema).csv(path) if schema else r.csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with a header (no index column exists in a DataFrame)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """A7 + C6: tagged-token files, one 'token<ws>tag' per line; files that are
    gone when they are read are skipped.

    Returns (file, pos, token, tag) with the token lower-cased and the tag
    cut to its first character; the line position keeps text order.
    """
    raw = (spark.read.option("ignoreMissingFiles", True).text(path, wholetext=True)
           .select(F.input_file_name().alias("file"), F.split("value", "\n").alias("lines")))
    lines = raw.select("file", F.posexplode("lines").alias("pos", "line"))
    parts = F.split(F.trim(F.col("line")), r"\s+")
    return (lines.filter(F.trim(F.col("line")) != "")
            .select("file", "pos", F.lower(parts[0]).alias("token"),
                    F.substring(parts[1], 1, 1).alias("tag")))


def write_vocab(vocab: DataFrame, path: str, term: str = "token") -> None:
    """A10: a ranked vocabulary (rank, term, n) as JSON lines."""
    vocab.select("rank", F.col(term).alias("term"), "n").coalesce(1).write.mode(
        "overwrite").json(path)


def read_ranked_json(spark: SparkSession, path: str, nb: int, drop=("'",)) -> DataFrame:
    """A JSON array of [term, count] pairs; drop given terms, keep the first nb.

    The file is one small document (a bounded vocabulary).
    """
    raw = spark.read.text(path, wholetext=True)
    arr = F.from_json("value", "array<array<string>>")
    items = raw.select(F.posexplode(arr).alias("i", "p")).select(
        "i", F.col("p")[0].alias("term"), F.col("p")[1].cast("bigint").alias("n"))
    items = items.filter(~F.col("term").isin(*drop)) if drop else items
    w = Window.orderBy("i")  # over one bounded vocabulary
    return items.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(
        F.col("rank") <= nb).select("rank", "term", "n")


def read_stopword_json(spark: SparkSession, path: str, keep: list[str]) -> DataFrame:
    """Nested category -> (list | object) JSON flattened to the distinct
    words of the kept top-level categories.

    Each level is parsed as a map or an array of raw JSON strings; strings
    that are neither an array nor an object are the words.  Levels are
    checkpointed and the walk stops at the first empty level, so the plan
    never nests.
    """
    from handprint.functions.arrays import materialize

    raw = spark.read.text(path, wholetext=True)
    level = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("category", "j"))
    level = materialize(level.filter(F.col("category").isin(*keep)))
    found = []
    while True:
        j = F.trim(F.col("j"))
        is_arr, is_obj = j.startswith("["), j.startswith("{")
        found.append(materialize(level.filter(~is_arr & ~is_obj).select(F.col("j").alias("word"))))
        arr = level.filter(is_arr).select(
            "category", F.explode(F.from_json("j", "array<string>")).alias("j"))
        obj = level.filter(is_obj).select(
            "category", F.explode(F.from_json("j", "map<string,string>")).alias("k", "j")).select(
            "category", "j")
        level = materialize(arr.unionByName(obj))
        if level.isEmpty():
            break
    words = found[0]
    for w in found[1:]:
        words = words.unionByName(w)
    return words.distinct()
