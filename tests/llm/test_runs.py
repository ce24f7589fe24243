import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from handprint.llm.runs import Positions, numbered, periodic_runs, word_runs

from tests.llm.conftest import make_docs


def brute(words, exponent=4, min_length=6):
    """Maximal runs, period by period."""
    n, found = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_length, exponent * q):
                run = words[start:start + length]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    found.append((start, length, q))
            i += i == start
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("aabc"), max_size=50), st.integers(1, 9), st.integers(0, 60),
       st.sampled_from([(4, 6), (2, 2), (3, 6), (2, 9)]))
def test_runs_of_words(words, period, tail, shape):
    words = words + [words[-period:][i % len(words[-period:])] for i in range(tail) if words]
    assert periodic_runs(numbered(words), *shape) == brute(words, *shape)


def test_ordered_positions():
    rnd = random.Random(3)
    held = rnd.sample(range(20_000), 6000)
    ordered = Positions(held[0])
    for p in held[1:]:
        ordered.add(p)
    assert list(ordered) == sorted(held)
    listed = sorted(held)
    for k in (0, 1, 2999, 5998, 5999):
        assert ordered.neighbours(listed[k]) == (
            listed[k - 1] if k else -1, listed[k + 1] if k + 1 < len(listed) else -1)


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
           "collapsed_sha256")


def test_documents(spark):
    rnd = random.Random(5)
    rows = [(1, None, "a"), (None, "x " * 30, "a"), (None, None, "b"), (2, "", "a"),
            (3, "a b " * 200 + "c " + "d\n" * 9, None), (4, "x x x x x", "a"), (4, "x x x x x", "a"),
            (5, "x x x x x x", "a"), (6, "a a a a a a b " * 5, "a"),
            (7, " ".join(rnd.choice("ab") for _ in range(400)), "a")]
    rows += [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 90))), "a")
             for i in range(100, 180)]
    out = word_runs(make_docs(spark, rows).repartition(3), plant=True).select(*COLUMNS).collect()
    order = {"key": lambda r: tuple(str(x) for x in r)}
    assert sorted(map(tuple, out), **order) == sorted([expected(i, t) for i, t, _ in rows], **order)
    assert sum(r["n_runs"] > 0 for r in out) > 8


def test_very_long_text(spark):
    words = ["w%d" % (i * i % 9973) for i in range(30_000)] + ["tail", "end"] * 20_000
    row = word_runs(make_docs(spark, [(1, " ".join(words), "a")])).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"]) == (1, 30_000, 40_000, 2)
    assert row["collapsed"] == " ".join(words[:30_002])


def test_empty_table_and_arguments(spark, no_docs):
    assert word_runs(no_docs).count() == 0
    with pytest.raises(ValueError):
        word_runs(no_docs, exponent=1)
