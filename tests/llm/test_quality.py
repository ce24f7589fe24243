import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from handprint.llm.quality import (MAX_DOCS, MAX_REMOVED, line_hash, quality_rules,
                                   repeated_words, without_lines)
from tests.llm.conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(grams)
    hit = {i + d for i, g in enumerate(grams) if many[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(hit), failed)


def brute(rows):
    plain = {t: [" ".join(WORD.findall(x)).lower() for x in (t or "").split("\n")
                 if WORD.search(x)] for _, t, _ in rows}
    contents = defaultdict(set)
    for _, t, s in rows:
        contents[s].add(tuple(plain[t]))
    counts = {s: Counter(x for c in cs for x in set(c)) for s, cs in contents.items()}
    out = []
    for i, t, s in rows:
        frequent = {x for x in plain[t] if counts[s][x] > MAX_DOCS}
        gone = sum(len(x.split(" ")) for x in plain[t] if x in frequent)
        b = base(t)
        out.append((i, *b, gone, not b[5] and 100 * gone <= MAX_REMOVED * b[0] and b[0] - gone >= 50))
    return Counter(out)


def check(docs, rows):
    got = quality_rules(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                    r.base_failed, r.removed_words, r.kept) for r in got) == brute(rows)


def test_odd_rows(odd_docs, odd_rows):
    check(odd_docs, odd_rows)


def boiler_rows():
    rows = []
    for i in range(120):
        own = " ".join(f"w{i}x{j}" for j in range(60))
        host = "ab"[i % 2] if i % 7 else None
        rows.append((i, f"{own}\nAll  Rights RESERVED $\n{own[:40]} & more", host))
        rows.append((1000 + i, own, host))
        rows.append((2000 + i, "all rights reserved $\n" + " ".join(["only", "lines"] * 4), host))
    many = "\n".join("all rights reserved $" for _ in range(40))
    return rows + [(5000 + i, many + f"\n{i}", "a") for i in range(40)] + [
        (6000 + i, "a copied line with words\n" + " ".join(f"c{j}" for j in range(60)), "c")
        for i in range(300)]


def test_frequent_lines(spark):
    rows = boiler_rows()
    check(make_docs(spark, rows).repartition(7), rows)


def test_copies_are_one_document(spark):
    """Three hundred copies of one text don't make its lines frequent."""
    got = quality_rules(make_docs(spark, boiler_rows())).where("doc_id >= 6000").collect()
    assert len(got) == 300 and all(r.kept and r.removed_words == 0 for r in got)


def test_lines_go(spark):
    docs = spark.createDataFrame([("One  Line\nkeep\none line",), (None,)], "text string")
    out = docs.select(without_lines(F.col("text"), F.array(F.lit(line_hash("one line")))))
    assert [r[0] for r in out.collect()] == ["keep", None]


def test_repeated_words():
    assert repeated_words("a b c a b c".split()) == 6
    assert repeated_words("a b c x a b c".split()) == 6
    assert repeated_words("a a a a".split()) == 4
    assert repeated_words("a a a".split()) == repeated_words([]) == 0


def test_limit_is_the_same_for_hosts_of_any_size(spark):
    """Six documents with a line lose it on a host of six and on one of four hundred."""
    def own(i):
        return " ".join(f"o{i}x{j}" for j in range(100))
    rows = [(i, f"{own(i)}\na line of some", "ab"[i % 2]) for i in range(12)]
    rows += [(100 + i, own(100 + i), "a") for i in range(400)]
    rows += [(600 + i, f"{own(600 + i)}\nfive only", "a") for i in range(5)]
    rows += [(700 + i, "\n".join([own(700 + i)[:300], *(f"many shared lines here {k}"
              for k in range(12))]), "c") for i in range(6)]
    check(make_docs(spark, rows).repartition(5), rows)
    got = {r.doc_id: r for r in quality_rules(make_docs(spark, rows)).collect()}
    assert {got[i].removed_words for i in range(12)} == {4}
    assert {got[600 + i].removed_words for i in range(5)} == {0}
    assert not any(got[700 + i].kept or got[700 + i].base_failed for i in range(6))


def test_the_method_itself_rejects(spark):
    """On the given rows some documents pass the base rules and are rejected as depleted."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert quality_rules(docs).where("not base_failed and not kept").count() > 0


def test_empty(no_docs):
    assert quality_rules(no_docs).count() == 0
