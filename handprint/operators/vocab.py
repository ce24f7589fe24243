"""Token tables, per-document counts and ranked vocabularies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handprint.functions import text as T


def token_table(docs: DataFrame, doc: str = "doc_id", text: str = "text",
                lower: bool = True) -> DataFrame:
    """Long token table (doc, pos, token, is_word) in text order."""
    return (docs.select(doc, F.posexplode(T.tokens(F.col(text), lower)).alias("pos", "token"))
            .withColumn("is_word", T.is_word(F.col("token"))))


def word_table(docs: DataFrame, doc: str = "doc_id", text: str = "text",
               lower: bool = True) -> DataFrame:
    """Long word table (doc, pos, token); pos counts words only."""
    return docs.select(doc, F.posexplode(T.words(F.col(text), lower)).alias("pos", "token"))


def term_counts(long: DataFrame, doc: str = "doc_id", term: str = "token") -> DataFrame:
    """(doc, term, n): occurrences of every term per document.

    Map-side partial aggregation collapses repeats before the shuffle.
    """
    return long.groupBy(doc, term).agg(F.count(F.lit(1)).alias("n"))


def corpus_counts(counts: DataFrame, term: str = "token") -> DataFrame:
    """(term, n): corpus totals of a per-document count table."""
    return counts.groupBy(term).agg(F.sum("n").cast("bigint").alias("n"))


def top_terms(totals: DataFrame, k: int, term: str = "token") -> DataFrame:
    """G1: the k most frequent terms, ties broken by term; adds ``rank`` (1..k).

    ``limit`` after ``orderBy`` plans as a TakeOrderedAndProject, so only k
    rows per partition ever leave the executors.
    """
    top = totals.orderBy(F.desc("n"), F.asc(term)).limit(k)
    w = Window.orderBy(F.desc("n"), F.asc(term))  # over k rows only
    return top.withColumn("rank", F.row_number().over(w).cast("bigint"))


def restrict(long: DataFrame, vocab: DataFrame, term: str = "token",
             vocab_term: str | None = None, bounded: bool = False) -> DataFrame:
    """Keep rows whose term is in a vocabulary (Spark broadcasts it by its size, or always
    if it is ``bounded``, a top-k list)."""
    v = vocab.select(F.col(vocab_term or term).alias(term)).distinct()
    return long.join(F.broadcast(v) if bounded else v, term, "left_semi")


def affix_long(words: DataFrame, doc: str = "doc_id", token: str = "token") -> DataFrame:
    """C9 exploded: (doc, affix) for every word."""
    return words.select(doc, F.explode(T.affixes(F.col(token))).alias("affix"))


#: Longest affix.
AFFIX_CHARS = 3


class AffixTrie:
    """Occurrences of short strings, found for all places of a text at once.

    A node is a prefix of an affix; the table names the node that each node and
    next character lead to (the last node: no affix begins so).
    """

    def __init__(self, affixes: list[str]):
        self.affixes = affixes
        chars = sorted({ord(c) for a in affixes for c in a})
        nodes = {"": 0}
        for a in affixes:
            for i in range(1, len(a) + 1):
                nodes.setdefault(a[:i], len(nodes))
        self.nodes, other = len(nodes) + 1, len(chars)
        self.limit = chars[-1] + 1 if chars else 0
        self.char = np.full(self.limit + 1, other, np.int32)
        self.char[chars] = np.arange(other)
        self.width = other + 1
        table = np.full((self.nodes, self.width), self.nodes - 1, np.int32)
        for prefix, node in nodes.items():
            if prefix:
                table[nodes[prefix[:-1]], self.char[ord(prefix[-1])]] = node
        self.table = table.ravel()
        self.node = np.array([nodes[a] for a in affixes], np.int64)
        self.overlaps = [i for i, a in enumerate(affixes)
                         if any(a[k:] == a[:-k] for k in range(1, len(a)))]

    def counts(self, text: str) -> np.ndarray:
        """Non-overlapping occurrences of each affix."""
        codes = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), self.limit)
        chars = self.char[codes]
        at = np.zeros(len(chars) + 1, np.int32)
        seen = np.zeros(self.nodes, np.int64)
        for step in range(min(AFFIX_CHARS, len(chars))):
            at = self.table[at[:-1] * self.width + chars[step:]]
            seen += np.bincount(at, minlength=self.nodes)
        found = seen[self.node]
        for i in self.overlaps:
            if found[i]:
                found[i] = text.count(self.affixes[i])
        return found


def affix_occurrences(texts: DataFrame, affixes: list[str], doc: str = "doc_id",
                      text: str = "text", total: str | None = None) -> DataFrame:
    """(doc, feature, n) for the affixes (1 to 3 characters) that a text holds.

    The vocabulary, a top-k list, goes to every task; a text is read once,
    however long the list is.  ``total`` names one more column, the sum of n
    over all rows of that doc; a text is one row when it meets its doc's others.
    """
    if any(not 1 <= len(a) <= AFFIX_CHARS for a in affixes):
        raise ValueError(f"affixes have 1 to {AFFIX_CHARS} characters")
    words = sorted(set(affixes))
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kind = texts.schema[doc].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = AffixTrie(shared.value)
        for batch in batches:
            places, counts, bounds, sums = [], [], [0], []
            for value in batch.column(text).to_pylist():
                found = trie.counts(value or "")
                held = np.flatnonzero(found)
                places.append(held.astype(np.int32))
                counts.append(found[held])
                bounds.append(bounds[-1] + len(held))
                sums.append(int(found.sum()))
            lists = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(
                np.concatenate([np.zeros(0, k), *parts])))
                for k, parts in ((np.int32, places), (np.int64, counts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(doc), *lists, pa.array(sums, pa.int64())],
                names=[doc, "_places", "_counts", "_sum"])

    per = texts.select(doc, text).mapInArrow(
        count, f"`{doc}` {kind}, _places array<int>, _counts array<bigint>, _sum bigint")
    if total:
        per = per.withColumn(total, F.sum("_sum").over(Window.partitionBy(doc)))
    names = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    cells = F.transform(F.arrays_zip("_places", "_counts"),
                        lambda c: F.struct(c["_places"].alias("_place"), c["_counts"].alias("n")))
    extra = [total] if total else []
    return (per.select(doc, *extra, F.inline(cells))
            .select(doc, F.get(names, F.col("_place")).alias("feature"), "n", *extra))
