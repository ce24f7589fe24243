"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A key's shard follows from the key and the number of shards alone: no ring,
no table, no state.  When shards are appended, a key either stays or moves
to one of the new shards, so only the necessary fraction moves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import extended, map_rows, narrowed, pinned, slots

_STEP = np.uint64(2862933555777941757)


def key_hash(key: str | None) -> int:
    """Stable unsigned 64-bit hash of a key; a null key hashes like the empty string."""
    return int.from_bytes(hashlib.md5((key or "").encode()).digest()[:8], "big")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys stepped together."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(keys), dtype=np.int64)
    live = np.arange(len(keys))
    at = np.zeros(len(keys), dtype=np.int64)
    while len(live):
        shard[live] = at[live]
        state[live] = state[live] * _STEP + np.uint64(1)
        draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        at[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[at[live] < shards]
    return shard.astype(np.int32)


def jump_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text",
                grown: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, shard, grown_shard, slot.

    ``size`` is the UTF-8 length of the text (null: 0) plus one and
    ``text_crc32`` the unsigned CRC-32 of those bytes.  ``grown_shard`` is the
    shard under ``grown`` shards (default: one more).  ``slot`` numbers the
    rows of a shard from 0, ordered by key (nulls first), then size and CRC.
    Texts never leave the scan: only these narrow rows are shuffled.

    Null keys are one key (one shard); repeated rows get a slot each; an empty
    table gives an empty result; other columns are not read.
    """
    grown = grown or shards + 1
    base = narrowed(docs, key=key, text=text)
    body = F.coalesce(F.col("text"), F.lit("")).cast("string")
    base = base.select("key", F.col("key").cast("string").alias("key_text"),
                       (F.octet_length(body) + 1).cast("bigint").alias("size"),
                       F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    schema = extended(base.drop("key_text"), "shard int, grown_shard int")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            hashes = np.array([key_hash(k) for k in batch.column(1).to_pylist()], dtype=np.uint64)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3),
                 pa.array(jump_hash(hashes, shards)), pa.array(jump_hash(hashes, grown))],
                names=["key", "size", "text_crc32", "shard", "grown_shard"])
        return step

    placed = pinned(map_rows(base, make, schema), "shards")
    out = slots(placed, "shard", [F.col("key"), F.col("size"), F.col("text_crc32")])
    return out.withColumnRenamed("key", key)
