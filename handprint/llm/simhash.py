"""SimHash near-duplicates found with pivot distance tables.

A document's 64-bit fingerprint is the bitwise majority of its shingles'
hashes.  Distinct fingerprints that differ in at most ``max_bits`` bits link.

Candidates: by the pigeonhole principle two such fingerprints agree on
``pieces - max_bits`` of ``pieces`` bit ranges, so they meet in the bucket of
that choice of ranges.  The more fingerprints, the more ranges are chosen, so
that a bucket's bits outgrow them.  Inside a bucket every fingerprint's Hamming
distances to several reference fingerprints (the pivots) are computed first; by the
triangle inequality a pair whose distances to any pivot differ by more than
``max_bits`` cannot link and is discarded; survivors are verified.  Buckets
are cut into tiles, so no bucket is one task, and a tile returns a spanning
forest of its links, not the links: no connection is lost and output stays
linear in the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import extended, map_rows, narrowed, pinned, row_key

SHINGLE = 4
MAX_BITS = 4
#: Bit ranges at least; see :func:`pieces_for`.
PIECES = 6
PIVOTS = 8
#: Fingerprints on one side of a tile.
TILE = 2048
SEED = 42


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: the first n outputs of splitmix64 from 0."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of a text; 0 if it has no words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)],
                      dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # the unpacked bits of a long text stay small
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Component labels (smallest index) after the links (i, j) are added."""
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        label = new[label]
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    return label


def tile_components(tiles: np.ndarray, blocks: np.ndarray, one_block: np.ndarray,
                    fps: np.ndarray, max_bits: int, references: np.ndarray) -> np.ndarray:
    """Smallest linked row of every row; rows link inside their tile only.

    The distance table has a row for each pivot.  Its first row orders the
    fingerprints of a tile, which gives each one a range of partners; the
    other rows discard partners by coordinate difference; what survives is
    verified.  A tile of two blocks forms pairs between the blocks only.
    """
    n = len(fps)
    table = np.bitwise_count(fps[None, :] ^ references[:, None]).astype(np.int8)
    key = tiles.astype(np.int64) * 256 + table[0]
    order = np.argsort(key, kind="stable")
    key = key[order]
    stop = np.searchsorted(key, key + max_bits, "right")
    label = np.arange(n)
    counts = stop - np.arange(n) - 1
    ahead = np.cumsum(counts)
    at = 0
    while at < n:
        # So many rows that about two million pairs are held at a time.
        done = ahead[at] - counts[at]
        to = max(at + 1, int(np.searchsorted(ahead, done + (1 << 21), "right")))
        own = counts[at:to]
        i = np.repeat(np.arange(at, to), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        i, j = order[i], order[j]
        keep = one_block[i] | (blocks[i] != blocks[j])
        i, j = i[keep], j[keep]
        for row in table[1:]:
            if len(i) == 0:
                break
            keep = np.abs(row[i] - row[j]) <= max_bits
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        label = join_labels(label, i[keep], j[keep])
        at = to
    return label


def bit_ranges(pieces: int) -> list[tuple[int, int]]:
    cuts = [round(64 * k / pieces) for k in range(pieces + 1)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def pieces_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest bit ranges whose buckets have over log2(n) bits, so that unlike
    fingerprints meet about once in a choice of ranges, however many there are."""
    pieces = max(PIECES, max_bits + 2)
    while pieces < 64 and 64 * (pieces - max_bits) // pieces <= math.log2(max(2, n)):
        pieces += 1
    return pieces


def bucketed(prints: DataFrame, max_bits: int, pieces: int) -> DataFrame:
    """(bucket, fp): every fingerprint once for each choice of agreeing ranges."""
    if not 0 <= max_bits < pieces <= 64:
        raise ValueError("need 0 <= max_bits < pieces <= 64")
    masks = []
    for chosen in combinations(bit_ranges(pieces), pieces - max_bits):
        mask = sum(((1 << hi) - (1 << lo)) for lo, hi in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    rows = F.posexplode(F.array(*[F.lit(m).cast("bigint") for m in masks]))
    return (prints.select("fp", rows.alias("choice", "mask"))
            .select("choice", F.col("fp").bitwiseAND(F.col("mask")).alias("part"), "fp"))


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS, pieces: int = PIECES,
                      tile: int = TILE) -> DataFrame:
    """(a, b): links that connect the same components as all links do.

    ``prints`` has one bigint column fp of distinct fingerprints.
    """
    rows = bucketed(prints, max_bits, pieces)
    sizes = (rows.groupBy("choice", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    sizes = sizes.withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    met = rows.join(sizes, ["choice", "part"])
    # Tile (x, y), x <= y, holds sub-blocks x and y of the bucket.
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    met = met.withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tile_key = ["choice", "part", "x", "y"]
    met = (met.select("choice", "part", F.least("block", "other").alias("x"),
                      F.greatest("block", "other").alias("y"), "block", "fp")
           .repartition(*tile_key).sortWithinPartitions(*tile_key))
    references = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(rows: np.ndarray, tiles: np.ndarray) -> pa.RecordBatch:
            _, _, x, y, block, fp = rows
            label = tile_components(tiles, block, x == y, fp.view(np.uint64), max_bits,
                                    references)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[label[moved]])],
                                              names=["a", "b"])
        held = np.zeros((6, 0), dtype=np.int64)  # rows of a tile that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64)
                             for c in batch.columns])
            held = np.ascontiguousarray(np.concatenate([held, rows], axis=1))
            tiles = np.concatenate([[0], np.cumsum((np.diff(held[:4]) != 0).any(axis=0))])
            whole = int(np.searchsorted(tiles, tiles[-1], "left"))
            if whole:
                yield linked(np.ascontiguousarray(held[:, :whole]), tiles[:whole])
                held = held[:, whole:]
        if held.shape[1]:
            yield linked(np.ascontiguousarray(held), np.zeros(held.shape[1], np.int64))

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, root): smallest node reachable, for every node with a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until the
    links are stars: no node has two smaller neighbours, or one that has a
    smaller neighbour itself.  Each round is written to the checkpoint folder; so are the
    least neighbours, for then a join meets them alone and Spark can split the
    neighbours of a node that has very many.
    """
    def directed(edges):
        return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(
            "a <> b").distinct()

    edges = pinned(directed(links), name)
    while True:
        forks = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chains = edges.select(F.col("b").alias("u")).distinct().join(
            edges.select(F.col("a").alias("u")).distinct(), "u")
        if forks.select("a").union(chains.select("u")).isEmpty():
            break
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = pinned(both.groupBy(F.col("a").alias("u")).agg(
            F.least(F.min("b"), F.min("a")).alias("m")), f"{name}-least")
        large = (both.where("b > a").join(least, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        edges = pinned(directed(large.unionByName(
            least.where("u <> m").select(F.col("u").alias("a"), F.col("m").alias("b")))), name)
        least = pinned(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")),
                       f"{name}-least")
        small = (edges.join(least, F.col("a") == F.col("u"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        edges = pinned(directed(small), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       shingle: int = SHINGLE, max_bits: int = MAX_BITS,
                       pieces: int | None = None) -> DataFrame:
    """One row per document: id, row_key, fingerprint (16 hex digits), component_id, root.

    ``component_id`` is the smallest id reachable over links, the document
    itself included; ``root`` is the component's own name, one of its
    fingerprints.  ``pieces``: by default chosen from the number of fingerprints.  Texts without words (null, empty, white space) have
    fingerprint zero and link like any other; null ids never become a
    component's id (all ids null: null); repeated rows share fingerprint and
    component; an empty table gives an empty result.

    Equal fingerprints are one node, so copies of a text never meet in pairs.
    """
    base = narrowed(docs, id=id_col, text=text_col).withColumn(
        "row", row_key(F.col("id"), F.col("text")))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()],
                           dtype=np.uint64)
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("row"), pa.array(fps.view(np.int64))],
                names=["id", "row", "fp"])
        return step
    schema = extended(base.select("id", "row"), "fp bigint")
    signed = pinned(map_rows(base, make, schema), "fingerprints")
    nodes = pinned(signed.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    pieces = pieces or pieces_for(nodes.count(), max_bits)
    roots = components(fingerprint_links(nodes.select("fp"), max_bits, pieces))
    # Pinned: a join then has scans on both sides, and Spark can split a large component.
    rooted = pinned(nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = pinned(rooted.groupBy(F.col("root").alias("of")).agg(
        F.min("first").alias("component_id")), "least")
    known = pinned(rooted.join(least, rooted["root"] == least["of"]).select(
        F.col("fp").alias("known"), "component_id", "root"), "known")

    def hexed(fp: str):
        return F.lower(F.lpad(F.hex(fp), 16, "0"))
    return signed.join(known, signed["fp"] == known["known"]).select(
        F.col("id").alias(id_col), F.col("row").alias("row_key"),
        hexed("fp").alias("fingerprint"), "component_id", hexed("root").alias("root"))
