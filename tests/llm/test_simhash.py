import math
import random
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from handprint.llm.simhash import (components, fingerprint, fingerprint_links, pieces_for,
                                   pivots, simhash_near_dedup, tile_components)


def brute_print(text, k=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, bits=4):
    """prints: list of (id, fp); smallest id reachable for each fp."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in fps}


def test_fingerprints(odd_rows):
    for _, text, _ in odd_rows:
        if len(text or "") < 20_000:
            assert fingerprint(text) == brute_print(text)
    assert fingerprint("ÀB c") == brute_print("ÀB c")


def test_odd_rows(odd_docs, odd_rows):
    got = simhash_near_dedup(odd_docs).collect()
    prints = [(i, fingerprint(t)) for i, t, _ in odd_rows]
    known = brute_components(prints)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (i, f"{f:016x}", known[f]) for i, f in prints)


def test_links_of_close_prints_across_tiles(spark):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(40)]
    fps = {0, 2**64 - 1, *seeds}
    for seed in seeds:
        for _ in range(25):
            x = seed
            for _ in range(rnd.randint(1, 7)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    signed = [f - (f >> 63 << 64) for f in fps]
    frame = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(6)
    for pieces, tile in ((6, 2048), (5, 8), (7, 3)):
        roots = {r.node: r.root for r in components(
            fingerprint_links(frame, 4, pieces, tile)).collect()}
        groups = {}
        for f in signed:
            groups.setdefault(roots.get(f, f), set()).add(f % 2**64)
        known = brute_components([(f, f) for f in fps])
        want = {}
        for f in fps:
            want.setdefault(known[f], set()).add(f)
        assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


def test_pieces_grow_with_the_fingerprints():
    assert pieces_for(0) == pieces_for(1 << 20) == 6
    assert pieces_for(30_000_000_000) == 9
    for n in (10, 1 << 22, 1 << 30, 1 << 35):
        p = pieces_for(n)
        assert 64 * (p - 4) // p > math.log2(n)
    assert pieces_for(100, 9) == 11


def test_tile_keeps_pairs_between_blocks_only():
    fps = np.array([0, 1, 3, 1 << 40], np.uint64)
    tiles = np.zeros(4, np.int64)
    label = tile_components(tiles, np.array([0, 0, 1, 1]), np.zeros(4, bool), fps, 1, pivots())
    assert label.tolist() == [0, 1, 1, 0]
    label = tile_components(np.array([0, 0, 1, 1]), tiles, np.ones(4, bool), fps, 4, pivots())
    assert label.tolist() == [0, 0, 2, 2]


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(-30, 30)] + [(100, 200), (200, 300), (7, 7)]
    frame = spark.createDataFrame(chain, "a bigint, b bigint")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {**{i: -30 for i in range(-29, 31)}, 200: 100, 300: 100}


def test_empty(no_docs):
    assert simhash_near_dedup(no_docs).count() == 0
    assert components(no_docs.select(F.lit(1).cast("bigint").alias("a"),
                                     F.lit(2).cast("bigint").alias("b"))).count() == 0
