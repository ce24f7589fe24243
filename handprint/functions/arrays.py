"""Array helpers.

``bind`` evaluates expressions once per row.  Catalyst collapses adjacent
projections and may inline a computed column into every place that uses
it — including the body of a lambda, where it is then recomputed for each
array element.  Routing the values through a one-row ``inline`` (a
Generate node) keeps them computed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Whether shuffle files are removed at the end of the execution that wrote them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bind(df: DataFrame, keep: list[str] | None = None, **named: Column) -> DataFrame:
    """Add ``named`` columns, each evaluated exactly once per row."""
    keep = df.columns if keep is None else keep
    keep = [c for c in keep if c not in named]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in named.items()]))))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write ``df`` to the shared checkpoint folder once.

    The frame is cached first so the checkpoint job reads the cache instead
    of recomputing the plan; the cache is released once the checkpoint
    files exist.
    """
    cached = df.persist()
    out = cached.checkpoint(eager=True)
    cached.unpersist()
    return out


def write_table(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint
    folder and reading it back: one job, and the returned frame's plan is a
    plain file scan.  The job's shuffle files go when it has ended, as the
    files hold its result."""
    import uuid

    from handprint.session import checkpoint_dir
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/handprint-tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("error").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.parquet(path)
