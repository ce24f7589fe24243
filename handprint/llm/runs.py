"""Periodic runs of words by descending-LCP Kruskal.

The suffixes of a text's words are sorted; suffixes that are neighbours in
that order are linked by their longest common prefix (LCP).  Links are taken
from the largest LCP down and unite classes of suffixes, kept as ordered
position sets.  Two positions that become neighbours in a united set have
exactly that LCP; where their distance is within it, a run starts, whose
period is the distance.

Nothing shorter than the least LCP that a run of the wanted exponent and
length can have is ever linked, so most texts only pass a test of whether any
such window occurs twice.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from handprint.llm.common import extended, map_rows, narrowed

MIN_EXPONENT = 4
MIN_LENGTH = 6
#: Positions in one list of an ordered set.
CHUNK = 1024

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Positions:
    """An ordered set of positions, in sorted lists of bounded length."""

    def __init__(self, first: int):
        self.lists, self.heads, self.n = [[first]], [first], 1

    def add(self, position: int) -> None:
        at = max(0, bisect_left(self.heads, position) - 1)
        held = self.lists[at]
        insort(held, position)
        self.heads[at] = held[0]
        self.n += 1
        if len(held) > CHUNK:
            self.lists[at:at + 1] = [held[:CHUNK // 2], held[CHUNK // 2:]]
            self.heads[at:at + 1] = [held[0], held[CHUNK // 2]]

    def neighbours(self, position: int) -> tuple[int, int]:
        """The members before and after a member; -1 where there is none."""
        at = bisect_left(self.heads, position)
        if at == len(self.heads) or self.heads[at] != position:
            at -= 1
        held = self.lists[at]
        k = bisect_left(held, position)
        before = held[k - 1] if k else self.lists[at - 1][-1] if at else -1
        after = (held[k + 1] if k + 1 < len(held) else
                 self.lists[at + 1][0] if at + 1 < len(self.lists) else -1)
        return before, after

    def __iter__(self):
        for held in self.lists:
            yield from held


def window_ranks(words: np.ndarray, length: int) -> np.ndarray:
    """A number for each window of ``length`` words, equal for equal windows."""
    ranks, have = words, 1
    while have < length:
        step = min(have, length - have)
        ranks = np.unique(ranks[:-step] * np.int64(len(words) + 1) + ranks[step:],
                          return_inverse=True)[1]
        have += step
    return ranks


def suffix_lcps(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, LCP): suffixes adjacent in sorted order whose LCP is ``least`` or more.

    Prefix doubling; the ranks of every doubling then give the LCPs from the
    longest length down.
    """
    n = len(words)
    levels = [words.astype(np.int32)]
    while True:
        step = 1 << (len(levels) - 1)
        key = levels[-1].astype(np.int64) * (n + 2)
        key[:-step] += levels[-1][step:] + 1
        _, ranks = np.unique(key, return_inverse=True)
        levels.append(ranks.astype(np.int32))
        if int(ranks.max()) == n - 1 or 2 * step >= n:
            break
    order = np.argsort(levels[-1], kind="stable")
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    lcp = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        i, j, size = a + lcp, b + lcp, 1 << level
        inside = np.flatnonzero(np.maximum(i, j) + size <= n)
        # A rank stands for words up to the end, so whole windows only are compared.
        same = inside[levels[level][i[inside]] == levels[level][j[inside]]]
        lcp[same] += size
    keep = lcp >= least
    return a[keep], b[keep], lcp[keep]


def periodic_runs(words: np.ndarray, exponent: int = MIN_EXPONENT,
                  min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run, by start, then period.

    ``words``: a number below len(words) for each word.  A run's length is at
    least ``min_length`` and ``exponent`` (2 or more) times its smallest period.
    """
    # A run of period q and length L is seeded at LCP L - q.
    least = min(max(min_length, exponent * q) - q for q in range(1, min_length + 1))
    if len(words) < least + 1:
        return []
    windows = window_ranks(words, least)
    if int(windows.max()) == len(windows) - 1:
        return []  # no window occurs twice
    a, b, lcp = suffix_lcps(words, least)
    by = np.argsort(-lcp, kind="stable")
    parent: dict[int, int] = {}
    sets: dict[int, Positions] = {}

    def find(x: int) -> int:
        if x not in parent:
            parent[x], sets[x] = x, Positions(x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for i, j, common in zip(a[by].tolist(), b[by].tolist(), lcp[by].tolist(), strict=True):
        large, small = find(i), find(j)
        if sets[large].n < sets[small].n:
            large, small = small, large
        moved, into = list(sets.pop(small)), sets[large]
        parent[small] = large
        for p in moved:
            into.add(p)
        last = -1  # the moved position before p
        for at, p in enumerate(moved):
            before, after = into.neighbours(p)
            new = [(before, p)] if before >= 0 and before != last else []
            if after >= 0 and not (at + 1 < len(moved) and moved[at + 1] == after):
                new.append((p, after))
            last = p
            for start, other in new:
                period = other - start
                if (common >= (exponent - 1) * period and common + period >= min_length
                        and (start == 0 or words[start - 1] != words[other - 1])):
                    found.append((start, common + period, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(words: list[str], doc_id: int | None) -> list[str]:
    """The words with the repetition that every tenth id gets, see op12_runs."""
    if doc_id is None or not words:
        return words
    g, r = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if r:
        return words
    n = len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def numbered(words: list[str]) -> np.ndarray:
    known: dict[str, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def run_row(words: list[str], exponent: int, min_length: int) -> tuple:
    runs = periodic_runs(numbered(words), exponent, min_length)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = words
    if runs:
        dropped = np.cumsum(gone)
        kept = [w for w, d in zip(words, dropped.tolist(), strict=False) if not d]
    return runs, kept


_RESULT = ("n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, "
           "exponent_milli bigint, runs array<struct<start: bigint, length: bigint, "
           "period: bigint>>, runs_sha256 string, collapsed_sha256 string, collapsed string")


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH,
              plant: bool = False) -> DataFrame:
    """One row per document: id, its runs, the greatest one, and the collapsed text.

    ``runs``: every maximal run (start, length, period) in words, by start, then
    period; ``start``, ``length``, ``period``, ``exponent_milli``: the longest
    run (then smallest start, then period), null without runs; ``collapsed``:
    the words outside all runs' repetitions (a run keeps its first period),
    joined by one space; digests of both.  ``plant`` repeats the words of every
    tenth id first (:func:`planted`).

    Null and empty texts have no words and no runs; a null id plants nothing;
    repeated rows give equal rows; an empty table gives an empty result.  A text
    is worked on whole, in memory that grows with its words times the logarithm
    of their number.
    """
    if exponent < 2 or min_length < 2:
        raise ValueError("need exponent >= 2 and min_length >= 2")
    base = narrowed(docs, id=id_col, text=text_col)
    schema = extended(base.select("id"), _RESULT)

    def digest(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def make():
        def one(doc_id, text) -> dict:
            words = _WORDS.findall(text or "")
            if plant:
                words = planted(words, doc_id)
            runs, kept = run_row(words, exponent, min_length)
            listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            joined = " ".join(kept)
            row = {"n_words": len(words), "n_runs": len(runs), "runs_sha256": digest(listed),
                   "collapsed_sha256": digest(joined), "collapsed": joined,
                   "runs": [dict(zip(("start", "length", "period"), r, strict=True))
                            for r in runs]}
            if runs:
                s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2]))
                row |= {"start": s, "length": n, "period": p, "exponent_milli": 1000 * n // p}
            return row

        run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        kinds = {name: pa.int64() for name in ("n_words", "n_runs", "start", "length", "period",
                                               "exponent_milli")}
        kinds |= {"runs": pa.list_(run), "runs_sha256": pa.string(),
                  "collapsed_sha256": pa.string(), "collapsed": pa.string()}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column("id")
            rows = [one(i, t) for i, t in zip(ids.to_pylist(), batch.column("text").to_pylist(),
                                              strict=True)]
            return pa.RecordBatch.from_arrays(
                [ids] + [pa.array([r.get(name) for r in rows], kind)
                         for name, kind in kinds.items()], names=["id", *kinds])
        return step
    return map_rows(base, make, schema).withColumnRenamed("id", id_col)
