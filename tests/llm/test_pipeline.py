import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import sentencepiece
from handprint.llm.common import row_key
from handprint.llm.mixture import mixture
from handprint.llm.pieces import default_model
from handprint.llm.queries import QUERIES
from handprint.llm.simhash import fingerprint
from tests.llm.test_quality import boiler_rows, brute as quality_brute
from tests.llm.test_simhash import brute_components
from tests.llm.conftest import make_docs


def test_stage_names():
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "mixture", "tokens"]
    assert len([q for q in QUERIES if re.match(r"op\d+_", q)]) == 13


def test_stages_keep_columns_and_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for docs in (odd_docs, no_docs):
        for at, (name, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, "")
            if at < 4:
                assert out.columns == docs.columns, name
            n = out.count()
            assert n <= 2 * docs.count()
            assert (n == 0) == (docs.count() == 0) or name == "quality"


def test_quality_stage(spark):
    rows = boiler_rows()
    out = cp.quality_stage(spark, make_docs(spark, rows), "").collect()
    kept = {r[0] for r in quality_brute(rows) if r[-1]}
    assert {r.doc_id for r in out} == kept
    assert all("rights" not in (r.text or "").lower() or r.source is None for r in out
               if r.doc_id < 1000 and r.source in ("a", "b"))
    assert all(r.n_chars == len(r.text) for r in out)


def test_exact_stage(spark, odd_docs, odd_rows):
    out = cp.exact_stage(spark, odd_docs, "").collect()
    forms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out]
    assert Counter(forms) == Counter({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, _ in odd_rows})


def test_near_stage(spark, odd_docs, odd_rows):
    """One row of every component, counted: also where an id occurs in two of them."""
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    rows = odd_rows + [(1, " ".join(words), "a"), (1, " ".join(reversed(words)), "a"),
                       (None, "alpha beta gamma", "a"), (None, "delta epsilon zeta", "a")]
    out = cp.near_stage(spark, make_docs(spark, rows).repartition(4), "").collect()
    prints = [fingerprint(t) for _, t, _ in rows]
    # Every fingerprint as its own id, so that a component's name is its least fingerprint.
    component = brute_components([(f, f) for f in set(prints)])
    want = {}
    for (i, _, _), f in zip(rows, prints, strict=True):
        least = want.setdefault(component[f], (True, None))
        want[component[f]] = min(least, (i is None, i), key=lambda x: (x[0], x[1] or 0))
    assert len(out) == len(want)
    assert Counter(component[fingerprint(r.text)] for r in out) == Counter(list(want))
    assert all(want[component[fingerprint(r.text)]][1] == r.doc_id for r in out)
    assert sum(r.doc_id == 1 for r in out) == 2 and sum(r.doc_id is None for r in out) >= 2


def test_row_keys_tell_rows_apart(spark):
    rows = [(1, None), (1, ""), (None, "1"), (1, "1"), (None, None), (1, "-"), (1, "x"), (1, "x")]
    frame = spark.createDataFrame(rows, "i bigint, t string")
    keys = [bytes(r[0]) for r in frame.select(row_key(frame["i"], frame["t"])).collect()]
    assert len(set(keys)) == len(set(rows)) and all(len(k) == 16 for k in keys)


def test_mixture_and_token_stage(spark, odd_docs):
    mixed = cp.mixture_stage(spark, odd_docs, "")
    want = Counter()
    for r in mixture(odd_docs).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    texts = defaultdict(set)
    for r in odd_docs.collect():
        texts[r.doc_id].add(tuple(lib.encode(r.text or "")))
    assert all(tuple(r.ids) in texts[r.doc_id]
               for r in cp.token_stage(spark, odd_docs, "").collect())


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert 0 < out.count() <= 400
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
