"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter of its fingerprints: the
high bits of a fingerprint (the quotient) name a run, the run holds the
sorted remainders with their counts.  Filters merge without loss, run by
run, by merging sorted remainders and adding counts.  Fingerprints counted
more than once route to byte verification; all others are unique.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import extended, map_rows, narrowed, pinned, row_key

_DELETED = b" \t\n\x0b\f\r"
#: A filter segment is emitted after this many fingerprints, which bounds a task's memory.
SEGMENT = 1 << 20
#: Distinct fingerprints expected in one run when filters are merged.
RUN = 1 << 16


def normalised(text: str | None) -> bytes:
    """UTF-8 of the text without the six ASCII white-space characters."""
    return (text or "").encode().translate(None, _DELETED)


def _digests():
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        forms = [normalised(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("row"),
             pa.array([xxhash.xxh64_intdigest(f) - (1 << 63) for f in forms], pa.int64()),
             pa.array([hashlib.sha256(f).hexdigest() for f in forms], pa.string()),
             pa.array([len(t or "") for t in texts], pa.int64())],
            names=["id", "row", "fingerprint", "sha256", "code_points"])
    return step


def build_filters(fingerprints: DataFrame, quotient_bits: int) -> DataFrame:
    """Counting quotient filter of each partition, one row per run.

    ``fingerprints`` has one bigint column.  A row holds the quotient, the
    sorted remainders (unsigned 64-bit, little endian) and their counts
    (unsigned 32-bit).
    """
    low = np.uint64(64 - quotient_bits)
    mask = np.uint64((1 << (64 - quotient_bits)) - 1)

    def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        quotients = (values >> low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(quotients)) + 1
        firsts = np.concatenate([[0], cuts])
        return pa.RecordBatch.from_arrays(
            [pa.array(quotients[firsts].astype(np.int32)),
             pa.array([(r & mask).tobytes() for r in np.split(values, cuts)], pa.binary()),
             pa.array([c.astype(np.uint32).tobytes() for c in np.split(counts, cuts)],
                      pa.binary())], names=["quotient", "remainders", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                        .view(np.uint64) ^ np.uint64(1 << 63))
            size += batch.num_rows
            if size >= SEGMENT:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    return fingerprints.mapInArrow(run, "quotient int, remainders binary, counts binary")


def merge_filters(filters: DataFrame, quotient_bits: int, at_least: int = 1) -> DataFrame:
    """Merge runs of equal quotient; fingerprints with their total counts.

    A copied fingerprint enters at most once per segment, however many rows
    have it, so no copy group makes a run long.
    """
    low = quotient_bits

    def merge(run: pd.DataFrame) -> pd.DataFrame:
        remainders = np.concatenate([np.frombuffer(x, np.uint64) for x in run["remainders"]])
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in run["counts"]])
        order = np.argsort(remainders, kind="stable")
        remainders, counts = remainders[order], counts[order].astype(np.int64)
        firsts = np.flatnonzero(np.concatenate([[True], remainders[1:] != remainders[:-1]]))
        totals = np.add.reduceat(counts, firsts)
        keep = totals >= at_least
        high = np.uint64(int(run["quotient"].iloc[0])) << np.uint64(64 - low)
        whole = (remainders[firsts][keep] | high) ^ np.uint64(1 << 63)
        return pd.DataFrame({"fingerprint": whole.view(np.int64), "copies": totals[keep]})

    return filters.groupBy("quotient").applyInPandas(merge, "fingerprint bigint, copies bigint")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, row_key.

    Texts are equal when identical after deleting ASCII white space; null
    counts as empty.  Of equal texts the row with the most code points in
    its original text stays, then the smallest id (nulls last); of rows alike
    in all that exactly one.  ``row_key`` is the row's key over id and text.

    The one text that moves is that of documents whose fingerprint the merged
    filter counts more than once; it is grouped by its bytes, pre-aggregated
    before the shuffle, so a hot group leaves a partition once.  An empty
    table gives an empty result.
    """
    base = narrowed(docs, id=id_col, text=text_col)
    base = base.withColumn("row", row_key(F.col("id"), F.col("text")))
    schema = extended(base.select("id", "row"),
                      "fingerprint bigint, sha256 string, code_points bigint")
    signed = map_rows(base, _digests, schema).withColumn(
        "ordinal", F.monotonically_increasing_id())
    signed = pinned(signed, "digests")

    bits = min(24, max(8, math.ceil(math.log2(signed.count() / RUN + 1))))
    merged = merge_filters(build_filters(signed.select("fingerprint"), bits), bits, at_least=2)
    repeated = pinned(merged, "repeated").select("fingerprint")

    # Byte verification: group the texts themselves under their fingerprint.
    def forms():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [normalised(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [pa.array([xxhash.xxh64_intdigest(f) - (1 << 63) for f in made], pa.int64()),
                 pa.array(made, pa.binary())], names=["fingerprint", "form"])
        return step
    verified = (map_rows(base.select("text"), forms, "fingerprint bigint, form binary")
                .join(repeated, "fingerprint", "left_semi")
                .groupBy("fingerprint", "form").agg(F.count(F.lit(1)).alias("group_size"))
                .where("group_size > 1")
                .select("fingerprint", F.sha2("form", 256).alias("sha256"), "group_size"))

    best = F.min(F.struct((-F.col("code_points")).alias("c"), F.col("id").isNull().alias("n"),
                          F.col("id").alias("i"), F.col("ordinal").alias("o")))
    firsts = signed.groupBy("fingerprint", "sha256").agg(best.alias("best"))
    # Pinned: the last join is then one of two scans, whose hot keys Spark splits.
    groups = pinned(verified.join(firsts, ["fingerprint", "sha256"]).select(
        "fingerprint", "sha256", "group_size", F.col("best.i").alias("first_id"),
        F.col("best.o").alias("first_ordinal")), "groups")
    whole = signed.join(groups, ["fingerprint", "sha256"], "left")
    alone = F.col("group_size").isNull()
    return whole.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("first_ordinal") == F.col("ordinal"))).alias("kept"),
        F.col("sha256").alias("text_sha256"), F.col("row").alias("row_key"))
