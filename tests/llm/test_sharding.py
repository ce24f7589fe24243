import zlib
from collections import Counter

import numpy as np

from handprint.llm.sharding import jump_hash, jump_shards, key_hash


def plain_jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash_is_the_published_function():
    keys = [key_hash(str(i)) for i in range(3000)] + [0, 2**64 - 1]
    for shards in (1, 2, 16, 17, 1000):
        got = jump_hash(np.array(keys, np.uint64), shards)
        assert got.tolist() == [plain_jump(k, shards) for k in keys]


def test_growth_moves_rows_only_into_the_new_shard():
    keys = np.array([key_hash(str(i)) for i in range(20000)], np.uint64)
    old, new = jump_hash(keys, 16), jump_hash(keys, 17)
    assert set(new[old != new]) == {16}
    assert abs((old != new).mean() - 1 / 17) < 0.01
    assert max(Counter(old.tolist()).values()) < 1.15 * 20000 / 16


def test_shards_of_odd_rows(odd_docs, odd_rows):
    got = jump_shards(odd_docs, 16).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()),
                    plain_jump(key_hash(None if i is None else str(i)), 16),
                    plain_jump(key_hash(None if i is None else str(i)), 17))
                   for i, t, _ in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got) == want
    for shard in {r.shard for r in got}:
        slots = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in got
                       if r.shard == shard)
        assert [s[0] for s in slots] == list(range(len(slots)))
        assert [s[1:] for s in slots] == sorted(s[1:] for s in slots)


def test_empty(no_docs):
    assert jump_shards(no_docs, 16).count() == 0
