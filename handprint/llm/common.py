"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from handprint.functions.arrays import write_table
from handprint.session import prepare

#: Inside a character class: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pinned(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage, and fixes values that depend on the physical layout
    (row ids), so that a recomputed task sees what its first run saw.
    """
    prepare(df.sparkSession)
    return write_table(df, name)


def narrowed(docs: DataFrame, **columns: str) -> DataFrame:
    """``docs`` cut to the columns needed, under the operator's own names.

    Every operator starts here, so columns of the caller can never clash
    with working columns.
    """
    return docs.select(*[docs[f"`{old}`"].alias(new) for new, old in columns.items()])


def row_key(row_id: Column, text: Column) -> Column:
    """128-bit key of a row: its id and its text.  Rows alike in both share it."""
    def told(x: Column) -> Column:
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), x.cast("string")))
    return F.unhex(F.md5(F.concat(told(row_id), F.lit("\n"), told(text)).cast("binary")))


def extended(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``df`` with more fields at its end."""
    return StructType(df.schema.fields + StructType.fromDDL(ddl).fields)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut to a few rows, so that the Python objects made of them stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
             schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with one function per task, made by ``make`` on the executor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in sliced(batches):
            step = step or make()
            yield step(batch)
    return df.mapInArrow(run, schema)


def slots(df: DataFrame, group: str, order: list[Column], name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    Rows are range-partitioned on (group, order), so a hot group spreads over
    many partitions; a row's number is its place in its partition plus what
    earlier partitions hold of its group.  That offset table has at most one
    row for each partition plus one for each group.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, F.col(group), *order)
              .sortWithinPartitions(F.col(group), *order)
              .withColumn("_mid", F.monotonically_increasing_id()))
    ranged = pinned(ranged, "slots").withColumn("_pid", F.shiftright("_mid", 33))
    parts = ranged.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"),
                                              F.min("_mid").alias("_first"))
    before = Window.partitionBy(group).orderBy("_pid")
    parts = parts.select("_pid", F.col(group).alias("_group"), "_first",
                         (F.sum("_n").over(before) - F.col("_n")).alias("_off"))
    same = (ranged["_pid"] == parts["_pid"]) & ranged[group].eqNullSafe(parts["_group"])
    return (ranged.join(F.broadcast(parts), same)
            .withColumn(name, (F.col("_mid") - F.col("_first") + F.col("_off")).cast("bigint"))
            .select(*df.columns, name))
