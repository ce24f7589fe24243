import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from handprint.llm import repeats
from handprint.llm.common import row_key
from handprint.llm.repeats import Codes, remove_repeats, sliding_min
from tests.llm.conftest import make_docs
from pyspark.sql import functions as F


def brute(rows, threshold):
    """rows in order: (key, text) -> (n_bytes, n_removed, n_spans, kept)."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - threshold + 1):
            window = data[p:p + threshold]
            if window in seen:
                gone[p:p + threshold] = b"\x01" * threshold
            seen.add(window)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(data)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[key] = (len(data), sum(gone), spans, kept)
    return out


def check(docs, rows, threshold=100, gram=32):
    """Documents are told apart by id and text; rows alike are one document."""
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("k"))
    order = {(r.doc_id, r.text): (r.doc_id is None, r.doc_id or 0, r.k) for r in keyed.collect()}
    want = brute([(key, key[1]) for key in sorted(order, key=order.get)], threshold)
    got = remove_repeats(docs, threshold=threshold, gram=gram, texts=True).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept_bytes))
                   for r in got) == Counter(
        (i, *want[i, t][:3], hashlib.sha256(want[i, t][3]).hexdigest(), want[i, t][3])
        for i, t, _ in rows)


def passages(n, threshold, seed):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randint(threshold // 2, 3 * threshold)))
            for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p = rnd.choice(pool)
            a = rnd.randint(0, len(p) // 3)
            parts += [p[a:a + rnd.randint(threshold // 2, len(p))],
                      "".join(rnd.choice("xyz ") for _ in range(rnd.randint(0, threshold)))]
        rows.append((rnd.randrange(10**6) * n + i, "".join(parts), "a"))
    return rows + [(-1, "a" * 900, "a"), (-2, "ab" * 700, "a"), (10**12, "b" * 99, "a"),
                   (10**12 + 1, "b" * 100, "a"), (10**12 + 2, "b" * 101, "a")]


@pytest.mark.parametrize("threshold, gram, seed", [(100, 48, 1), (100, 20, 2), (40, 8, 3), (100, 99, 4)])
def test_passages(spark, threshold, gram, seed):
    rows = passages(150, threshold, seed)
    check(make_docs(spark, rows).repartition(6), rows, threshold, gram)


def test_chunks_and_small_batches(spark, monkeypatch):
    """Chunk and batch borders anywhere change nothing."""
    monkeypatch.setattr(repeats, "CHUNK", 256)
    monkeypatch.setattr(repeats, "_PLACE", np.uint64(255))
    rows = passages(40, 100, 9)
    found = [repeats.stretches(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]),
                               repeats.Codes(100), 100, 32) for _, t, _ in rows]
    for (_, text, _), (owner, first, last, _, _) in zip(rows, found):
        starts = [w for a, b in zip(first, last) for w in range(a, b + 1)]
        assert sorted(starts) == list(range(max(0, len(text.encode()) - 99)))
    monkeypatch.undo()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        check(make_docs(spark, rows), rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_odd_rows(spark, odd_rows):
    rows = [(i, (t or "")[:3000] if t is not None else None, s) for i, t, s in odd_rows]
    check(make_docs(spark, rows).repartition(4), rows)


def test_repeated_rows_keep_their_text(spark):
    """Rows alike in id and text are one document, however long: it repeats nothing."""
    rnd = random.Random(12)
    own = ["".join(rnd.choice("abcdefgh ") for _ in range(400)) for _ in range(5)]
    rows = ([(1, own[0], "a")] * 3 + [(None, own[1], "a")] * 2 + [(None, own[2], "a")]
            + [(2, own[0] + own[3], "a"), (2, own[4] + own[1][:150], "a")] * 2 + [(3, "b" * 350, "a")] * 2)
    check(make_docs(spark, rows).repartition(3), rows)
    got = {r.n_removed for r in remove_repeats(make_docs(spark, rows[:3])).collect()}
    assert got == {0}


def test_very_long_document(spark):
    rnd = random.Random(8)
    text = "".join(rnd.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, text, "a"), (2, text[1_048_000:1_049_500] + "!", "a"), (3, text[5:1_200_000], "a")]
    got = {r.doc_id: r for r in remove_repeats(make_docs(spark, rows)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 1500, 1_199_995]


def test_sliding_min():
    rnd = np.random.default_rng(0)
    for n, w in ((10, 3), (64, 64), (100, 7), (5, 1)):
        x = rnd.integers(0, 50, n).astype(np.uint64)
        assert sliding_min(x, w).tolist() == [min(x[i:i + w]) for i in range(n - w + 1)]


def test_empty(no_docs):
    assert remove_repeats(no_docs).count() == 0


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_self_similar_texts_are_not_taken_as_equal(spark):
    """Thue and Morse's string and its complement, whose codes meet from 1,024 bytes on."""
    one = thue_morse(2048)
    other = one.translate(str.maketrans("ab", "ba"))
    codes = Codes(4096)
    for size in (64, 128, 256, 512):
        found = [codes.of(codes.sums(np.frombuffer(t[:size].encode(), np.uint8)), np.array([0]),
                          np.array([size]))[0] for t in (one, other)]
        assert found[0] != found[1]
    rows = [(1, one[:700], "a"), (2, other[:700], "a"), (3, thue_morse(90), "a")]
    for threshold in (100, 256):
        check(make_docs(spark, rows), rows, threshold, 32)
    with pytest.raises(ValueError):
        remove_repeats(make_docs(spark, rows), threshold=512)
