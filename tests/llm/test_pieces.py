import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

from handprint.llm.pieces import PieceModel, default_model, piece_tokens


@pytest.fixture(scope="module")
def both():
    with open(default_model(), "rb") as f:
        model = f.read()
    return PieceModel(model), sentencepiece.SentencePieceProcessor(model_proto=model)


def test_same_ids_as_the_library(both):
    own, lib = both
    rnd = random.Random(1)
    letters = "abeinrst  ▁\n\t0=_-.,;的é日\U0001f600Ａ\u0000"
    short = [p for p in own.id if len(p) <= 4]
    texts = ["", " ", "   ", " a", "a ", " " * 1001, "x" * 3000, "<s> </s> <unk> <0x0A>", "▁▁ x",
             "   ße", "aaaa " * 50, "______", "\u3000 的 的"]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 60))) for _ in range(4000)]
    texts += ["".join(rnd.choice(short) for _ in range(rnd.randint(1, 25))) for _ in range(4000)]
    for text in texts:
        ids = lib.encode(text)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == lib.decode(ids), text


def test_pair_test_agrees_with_merging(both):
    own, _ = both
    rnd = random.Random(4)
    ids = [i for i in own.halves]
    for _ in range(3000):
        a, b = rnd.choice(ids), rnd.choice(ids)
        if not own.text[b].startswith("▁"):
            assert own.stay_apart(a, b) == (
                own.merge(own.text[a] + own.text[b])[0] == [own.text[a], own.text[b]])


def test_odd_rows(odd_docs, odd_rows, both):
    _, lib = both
    got = piece_tokens(odd_docs, ids=True).collect()
    want = Counter()
    for i, text, _ in odd_rows:
        ids = lib.encode(text or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
              hashlib.sha256(lib.decode(ids).encode()).hexdigest(), tuple(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids))
                   for r in got) == want


def test_empty(no_docs):
    assert piece_tokens(no_docs).count() == 0
