import re
from collections import Counter, defaultdict
from itertools import permutations

from handprint.llm.audit import filter_audit


def brute(rows, labels):
    """(part, order, step) -> counts, by applying the filters document by document."""
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in (0, 1))
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out, removed_by = defaultdict(Counter), Counter()
    parts = {s or "" for _, _, s in rows}
    for i, t, s in rows:
        t, s = t or "", s or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                  "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                  "D": bool(re.search("[#$%&*|]", t)),
                  "E": t in first and (i is None or i > first[t])}
        for order in permutations("ABCDE"):
            alive = True
            for step, letter in enumerate(order, 1):
                cell = out[s, "".join(order), step]
                if failed[letter] and sum(failed.values()) == 1:
                    cell["unique_fails"] += 1
                if failed[letter] and not alive:
                    cell["redundant"] += 1
                if failed[letter] and alive:
                    alive = False
                    cell["removed"] += 1
                    cell["good_lost"] += i in good
                    cell["toxic_lost"] += i in toxic
                    removed_by[s, letter] += 1
                cell["kept"] += alive
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, "".join(o), k): (*(out[p, "".join(o), k][n] for n in names), removed_by[p, o[k - 1]])
            for p in parts for o in permutations("ABCDE") for k in range(1, 6)}


def made(spark, docs, labels):
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:]
            for r in filter_audit(docs, table).collect()}


def test_all_orders(spark, odd_docs, odd_rows):
    labels = [(i, n % 2, n % 3 % 2) for n, (i, _, _) in enumerate(odd_rows)]
    labels += [(None, 1, 1), (50, None, None), (51, 1, 1), (51, 0, 0)]
    rows = made(spark, odd_docs, labels)
    assert rows == brute(odd_rows, labels)
    assert len(rows) == 600 * 4


def test_empty_tables(spark, odd_docs, odd_rows, no_docs):
    assert made(spark, no_docs, [(1, 1, 1)]) == {}
    rows = made(spark, odd_docs, [])
    assert rows == brute(odd_rows, [])
