import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from handprint.llm.secrets import (RULES, Rule, find_secrets, listed, postings,
                                   trigram_query)
from tests.llm.conftest import make_docs

BASE = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]"""
                              r"""\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]


def brute(text):
    spans = [(m.start(), place, kind, m.end()) for place, (kind, rule, group, least)
             in enumerate(BASE) for m in rule.finditer(text or "") if len(m[group]) >= least]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_spans(spark, odd_rows, odd_docs):
    got = find_secrets(odd_docs).select("doc_id", listed(F.col("found")).alias("s")).collect()
    assert Counter((r.doc_id, r.s) for r in got) == Counter((i, brute(t)) for i, t, _ in odd_rows)


def test_random_texts(spark):
    rnd = random.Random(11)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "=", ":", " ", "  ", "'",
             '"', "AKIA", "ABCDEFGH", "0123456789abcdef", "deadbeef", "é", "\U0001f600", "\n", "x",
             "hunter2", "token=secret:abcdefghijk", "."]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))), "a")
            for i in range(1500)]
    got = find_secrets(make_docs(spark, rows)).select("doc_id", listed(F.col("found")).alias("s"))
    assert {r.doc_id: r.s for r in got.collect()} == {i: brute(t) for i, t, _ in rows}


@pytest.mark.parametrize("pattern, want", [
    (r"AKIA[A-Z0-9]{12,}", {frozenset({"aki", "kia"})}), (r"[0-9a-f]{32,}", {frozenset()}),
    (r"ab?c(de|fg)+hij", {frozenset({"hij"})}), (r"(abc|xyz)1?", {frozenset({"abc"}), frozenset({"xyz"})}),
    (r"(foo)*bar", {frozenset({"bar"})}), (r"(abcd.*|q)", {frozenset()})])
def test_trigram_queries(pattern, want):
    assert trigram_query(pattern) == want


def test_query_holds_for_every_match():
    rnd = random.Random(2)
    for _ in range(2000):
        key = rnd.choice(["password", "passwd", "secret", "token", "api_key", "apikey"])
        text = "".join(rnd.choice((c, c.upper())) for c in key) + rnd.choice(["=", "': ", '" ="']) + "a"
        held = {text.lower()[i:i + 3] for i in range(len(text))}
        assert any(need <= held for need in trigram_query(RULES[0].pattern))


def test_rules_are_a_parameter(spark):
    docs = make_docs(spark, [(1, "xx ghp_abcdef yy", "a"), (2, "nothing", "a")])
    rule = (Rule("hub", "ghp_[a-z]+", 0, 5),)
    got = find_secrets(docs, rules=rule).select("doc_id", listed(F.col("found"), rule).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {1: "hub:3:13", 2: ""}


def test_postings_of_many_trigrams(spark):
    rnd = random.Random(4)
    alphabet = "abcAB_.^]-\\é\n"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    trigrams = sorted({t.lower()[i:i + 3] for t in texts[:40] for i in range(len(t) - 2)})
    docs = spark.createDataFrame(list(enumerate(texts)), "row bigint, text string")
    got = {(r.trigram, r.row) for r in postings(docs, trigrams).collect()}
    assert got == {(g, i) for i, t in enumerate(texts) for g in trigrams if g in t.lower()}


def test_fifty_rules_find_what_their_regexes_find(spark, odd_docs):
    rules = RULES + tuple(Rule(f"r{i}", f"(?i)w{i}[0-9]? (w[0-9]+) w[0-9]{{2,}}", 1, 3)
                          for i in range(47))
    got = {(r.doc_id, r.s) for r in find_secrets(odd_docs, rules=rules).select(
        "doc_id", listed(F.col("found"), rules).alias("s")).collect()}
    want = set()
    for doc_id, text in {(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()}:
        spans = [(m.start(), place, m.end()) for place, rule in enumerate(rules)
                 for m in re.finditer(rule.pattern, text or "") if len(m[rule.group]) >= rule.least]
        want.add((doc_id, ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in sorted(spans))))
    assert got == want and any("r1" in s for _, s in want)


def test_empty(no_docs):
    assert find_secrets(no_docs).count() == 0
