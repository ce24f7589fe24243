"""SentencePiece (merge type) encoding by a table of last tokens, and decoding.

For merge-type vocabularies the encoding of every prefix of a text has one
last token.  The table stores it for each prefix: of the pieces that end at
a position (matches of an Aho-Corasick automaton), it is the one whose pair with the last
token before it is compatible, that is, encodes to exactly these two pieces.
The ids are then recovered backwards from the last entry.

Pieces never span a non-space followed by a space, so a text is encoded word
by word and words are remembered.  Runs of spaces are a case of their own:
their pieces share one score, so ties are broken from the left, which pair
tests can't see; a run is merged directly, once for each length.
"""

from __future__ import annotations

import functools
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from handprint.llm.common import extended, map_rows, narrowed

SPACE = "▁"
#: Words and pairs remembered by a Python worker.  Full words become the older ones,
#: from which those met again return; full pairs are forgotten.
WORDS = 250_000
PAIRS = 1_000_000
#: Steps over failure links that an automaton remembers.
STEPS = 500_000
#: Longer words are encoded but not remembered.
LONG = 64


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Automaton:
    """Strings that end at each position of a text, longest first.

    ``goto[state]`` holds the trie's edges and, as they are met, the steps over
    failure links; ``matches[state]`` the (value, length) of strings that end there.
    """

    def __init__(self, values: dict[str, int]):
        self.goto: list[dict[str, int]] = [{}]
        self.matches: list[tuple[tuple[int, int], ...]] = [()]
        for text, value in values.items():
            state = 0
            for char in text:
                if char not in self.goto[state]:
                    self.goto[state][char] = len(self.goto)
                    self.goto.append({})
                    self.matches.append(())
                state = self.goto[state][char]
            self.matches[state] = ((value, len(text)),)
        self.fail = [0] * len(self.goto)
        self.room = STEPS
        level = list(self.goto[0].values())
        while level:  # breadth first: a state's failure link is shorter than the state
            below = []
            for state in level:
                self.matches[state] += self.matches[self.fail[state]]
                for char, target in self.goto[state].items():
                    at = self.fail[state]
                    while at and char not in self.goto[at]:
                        at = self.fail[at]
                    self.fail[target] = self.goto[at].get(char, 0)
                    below.append(target)
            level = below

    def step(self, state: int, char: str) -> int:
        at = state
        while at and char not in self.goto[at]:
            at = self.fail[at]
        at = self.goto[at].get(char, 0)
        if self.room:
            self.room -= 1
            self.goto[state][char] = at
        return at


class PieceModel:
    """Encoder and decoder for one merge-type model given as bytes.

    Supports models that normalise by identity with a space put in front, and
    whose pieces hold spaces only in front (one, or nothing but spaces).
    Others raise ValueError.
    """

    def __init__(self, model: bytes):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.text: list[str] = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.score = [lib.get_score(i) for i in range(len(self.text))]
        self.bytes_of: dict[int, int] = {}
        self.byte_id: dict[int, int] = {}
        self.id: dict[str, int] = {}
        for i, piece in enumerate(self.text):
            if lib.is_byte(i):
                self.bytes_of[i] = int(piece[3:5], 16)
                self.byte_id[self.bytes_of[i]] = i
            elif lib.is_unused(i):
                raise ValueError("unused pieces are not supported")
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                self.id[piece] = i
        runs = [i for p, i in self.id.items() if len(p) > 1 and not p.strip(SPACE)]
        rest = [i for p, i in self.id.items() if len(p) > 1 and p.strip(SPACE)]
        if (any(SPACE in self.text[i][1:] for i in rest) or len(self.byte_id) != 256
                or max(map(self.score.__getitem__, runs), default=-1e30)
                >= min(map(self.score.__getitem__, rest))
                or lib.normalize(" x  ﬁ\t") != f"{SPACE * 2}x{SPACE * 2}ﬁ\t"):
            raise ValueError("unsupported normalisation or pieces")
        #: Single characters: no match of the automaton, but what is left without one.
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        #: A piece's place in the order of merges (single characters come first of all).
        order = sorted(rest, key=lambda i: -self.score[i])
        self.rank = {i: at for at, i in enumerate(order)}
        #: The two pieces whose merge made a piece.
        self.halves: dict[int, tuple[int, int]] = {}
        whole: dict[str, int] = {}
        for piece, i in self.id.items():
            if len(piece) == 1 or not piece.strip(SPACE):
                continue
            made, last = self.merge(piece)
            if made == [piece]:
                whole[piece] = i
                self.halves[i] = tuple(self.id[p] for p in last)
        self.automaton = Automaton(whole)
        self.digits = [str(i) for i in range(len(self.text))]
        #: Whether pieces left and right stay apart, by left * size + right.
        self.pairs: dict[int, bool] = {}
        #: Ids of words (with their space), joined by commas, and the text decoded
        #: from them where that isn't a space and the word.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.decoded: dict[str, str] = {}
        self.runs: dict[int, list[int]] = {}

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, best score first, ties from the left: pieces and the last merge."""
        last = None
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            if 0 <= left and after[left] < n:
                both = parts[left] + parts[after[left]]
                if both in self.id:
                    heapq.heappush(heap, (-self.score[self.id[both]], left, both))
        for left in range(n - 1):
            offer(left)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left] if parts[left] is not None else n
            if right >= n or parts[left] + parts[right] != both:
                continue
            last = parts[left], parts[right]
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            offer(before[left])
            offer(left)
        return [p for p in parts if p is not None], last

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces' text encodes to exactly these two pieces."""
        key = left * len(self.text) + right
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.stay_apart(left, right)
        return known

    def stay_apart(self, a: int, b: int) -> bool:
        """Take merges back, latest first, and look across the border.

        While a and b stood next to each other, their own merge must not have
        come before the merge that was just taken back.  Of two merges of one
        piece the left one came first.
        """
        bound = len(self.rank)
        while True:
            across = self.id.get(self.text[a] + self.text[b])
            if across is not None and self.rank.get(across, bound) < bound:
                return False
            rank_a, rank_b = self.rank.get(a, -1), self.rank.get(b, -1)
            if rank_a < 0 and rank_b < 0:
                return True
            if rank_a > rank_b:
                bound, a = rank_a, self.halves[a][1]
            else:
                bound, b = rank_b + 1, self.halves[b][0]

    def last_tokens(self, word: str) -> tuple[list[int], list[int]]:
        """Last token of every prefix, as ids and lengths; a character without piece has id -1."""
        single, goto, matches = self.single.get, self.automaton.goto, self.automaton.matches
        pairs, size = self.pairs, len(self.text)
        ids: list[int] = []
        lengths: list[int] = []
        state = 0
        for end, char in enumerate(word):
            follow = goto[state].get(char)
            state = self.automaton.step(state, char) if follow is None else follow
            found, reach = single(char, -1), 1
            for token, length in matches[state]:
                # A start has no token before it; a character without piece joins nothing.
                left = ids[end - length] if length <= end else -1
                if left >= 0:
                    apart = pairs.get(left * size + token)
                    if apart is None:
                        apart = self.compatible(left, token)
                    if not apart:
                        continue
                found, reach = token, length
                break
            ids.append(found)
            lengths.append(reach)
        return ids, lengths

    def encode_word(self, word: str) -> list[int]:
        """Ids of a text in which spaces stand only in front."""
        last, lengths = self.last_tokens(word)
        ids: list[int] = []
        at = len(word) - 1
        while at >= 0:
            if last[at] >= 0:
                ids.append(last[at])
            else:
                ids.extend([self.byte_id[b] for b in reversed(word[at].encode())])
            at -= lengths[at]
        ids.reverse()
        return ids

    def decode_raw(self, ids) -> str:
        """Text of ids with the leading space still there."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.bytes_of:
                held.append(self.bytes_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.text[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids) -> str:
        return self.decode_raw(ids).removeprefix(" ")

    def joined(self, ids: list[int]) -> str:
        digits = self.digits
        return ",".join([digits[i] for i in ids])

    def remembered(self, word: str) -> str:
        """Ids of a word with its space, joined; its decoded text is kept if it differs."""
        found = self.older.get(word)
        if found is None:
            ids = self.encode_word(SPACE + word)
            found = self.joined(ids)
            text = self.text
            if "".join([text[i] for i in ids]) != SPACE + word:
                raw = self.decode_raw(ids)
                if raw != " " + word:
                    self.decoded[word] = raw
        if len(word) <= LONG:
            if len(self.words) >= WORDS:
                self.older, self.words = self.words, {}
            self.words[word] = found
        return found

    def run(self, length: int) -> list[int]:
        ids = self.runs.get(length)
        if ids is None:
            ids = self.runs[length] = [self.id[p] for p in self.merge(SPACE * length)[0]]
        return ids

    def parts(self, text: str) -> tuple[str, str]:
        """Ids of a text joined by commas, and the text decoded from them."""
        if not text:
            return "", ""
        words = text.replace(SPACE, " ").split(" ")
        get, remembered, odd = self.words.get, self.remembered, self.decoded
        if "" not in words:
            found = ",".join([get(w) or remembered(w) for w in words])
            raw = "".join([odd.get(w) or " " + w for w in words]) if odd else " " + " ".join(words)
            return found, raw.removeprefix(" ")
        out, raws, spaces = [], [], 0
        lone = self.digits[self.id[SPACE]]
        for word in words:
            if not word:
                spaces += 1
                continue
            part, raw = get(word) or remembered(word), odd.get(word) or " " + word
            if spaces:
                head, _, tail = part.partition(",")
                if head == lone:  # this space belongs to the run
                    spaces, part, raw = spaces + 1, tail, raw.removeprefix(" ")
                out.append(self.joined(self.run(spaces)))
                raws.append(self.decode_raw(self.run(spaces)))
            spaces = 0
            out.append(part)
            raws.append(raw)
        if spaces:
            out.append(self.joined(self.run(spaces)))
            raws.append(self.decode_raw(self.run(spaces)))
        return ",".join(out), "".join(raws).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        found = self.parts(text)[0]
        return list(map(int, found.split(","))) if found else []


@functools.lru_cache(maxsize=2)
def loaded(model: bytes) -> PieceModel:
    """The model of this Python worker: later tasks find its words again."""
    return PieceModel(model)


def piece_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 model_path: str | None = None, ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256[, ids].

    The digests are of the decimal ids joined by commas and of the text
    decoded from the ids.  Null and empty texts give no ids and the digest of
    nothing; every row is encoded by itself, so repeated rows and null ids
    need no rule; an empty table gives an empty result.  The model file is
    read on the driver and broadcast; it does not grow with the data.
    """
    spark = docs.sparkSession
    with open(model_path or default_model(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    base = narrowed(docs, id=id_col, text=text_col)
    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema = extended(base.select("id"), ddl + (", ids array<int>" if ids else ""))

    def make():
        pieces = loaded(model.value)

        def digest(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            count, of_ids, decoded, lists = [], [], [], []
            for text in batch.column("text").to_pylist():
                found, raw = pieces.parts(text or "")
                count.append(found.count(",") + 1 if found else 0)
                of_ids.append(digest(found))
                decoded.append(digest(raw))
                if ids:
                    lists.append(np.fromstring(found, dtype=np.int32, sep=","))
            made = [batch.column("id"), pa.array(count, pa.int64()), pa.array(of_ids, pa.string()),
                    pa.array(decoded, pa.string())]
            if ids:
                made.append(pa.array(lists, pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(made, names=schema.names)
        return step
    return map_rows(base, make, schema).withColumnRenamed("id", id_col)
