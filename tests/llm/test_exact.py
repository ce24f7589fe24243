import hashlib
import random
import re
from collections import Counter, defaultdict

from handprint.llm.exact import build_filters, exact_dedup, merge_filters
from tests.llm.conftest import make_docs


def brute(rows):
    """(doc_id, keep_id, group_size, sha) of every row, and kept rows of every text."""
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    out = Counter()
    for form, members in groups.items():
        keep = min(members)[3]
        sha = hashlib.sha256(form.encode()).hexdigest()
        out.update((m[3], keep, len(members), sha) for m in members)
    return out, len(groups)


def check(rows, docs):
    got = exact_dedup(docs).collect()
    want, groups = brute(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_odd_rows(odd_docs, odd_rows):
    check(odd_rows, odd_docs)


def test_hot_group(spark):
    rows = [(i, "copy of one text" + " " * (i % 7), "a") for i in range(3000)]
    rows += [(5000 + i, f"single {i}", "a") for i in range(500)]
    check(rows, make_docs(spark, rows).repartition(16))


def test_filters_merge_without_loss(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(-2**63, 2**63) for _ in range(500)] + [0, -1, 2**63 - 1, -2**63]
    rows = [v for v in values for _ in range(rnd.choice([1, 1, 2, 9]))]
    frame = spark.createDataFrame([(v,) for v in rows], "fingerprint bigint").repartition(7)
    for bits in (8, 13):
        got = merge_filters(build_filters(frame, bits), bits).collect()
        assert {r.fingerprint: r.copies for r in got} == dict(Counter(rows))


def test_empty(no_docs):
    assert exact_dedup(no_docs).count() == 0
