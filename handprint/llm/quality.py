"""Quality rules with cross-document line frequency.

Normalised lines are hashed, the distinct documents that hold a line are
counted per host, lines above the limit are removed, and documents that the
removal depletes are rejected.  A few base rules come before.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import extended, narrowed, pinned, row_key, sliced

#: A line is boilerplate when more than so many distinct documents of its host hold it.
MAX_DOCS = 5
#: A document is depleted when the removal takes more than so many percent of its
#: words, or leaves fewer than MIN_WORDS.
MAX_REMOVED = 25
MIN_WORDS = 50
MAX_REPEATED = 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPACES = " \t\n\x0b\f\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def line_hash(line: str) -> int:
    """Signed 64-bit hash of a line: lower case, white space runs as one space."""
    return xxhash.xxh64_intdigest(" ".join(_WORDS.findall(line)).lower().encode()) - (1 << 63)


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    _, pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)
    _, codes, counts = np.unique(pairs[:-1] * np.int64(len(known)) + ids[2:],
                                 return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[codes] > 1)
    hit = np.zeros(n, dtype=bool)
    for shift in range(3):
        hit[starts + shift] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple:
    """Base figures of a text, the hash of its normalised lines, and these lines.

    Lines are (hash, words) of every line with a word, in order.
    """
    text = text or ""
    words = _WORDS.findall(text)
    lines, seen, dup = [], set(), 0
    for line in text.split("\n"):
        held = _WORDS.findall(line)
        if held:
            lines.append((xxhash.xxh64_intdigest(" ".join(held).lower().encode()) - (1 << 63),
                          len(held)))
            dup += line in seen
            seen.add(line)
    content = xxhash.xxh3_128_digest(np.array([x[0] for x in lines], np.int64).tobytes())
    return (len(words), sum(map(len, words)), len(_SYMBOLS.findall(text)), dup,
            repeated_words(words), content, [x[0] for x in lines], [x[1] for x in lines])


_MEASURED = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
             "n_repeat_words bigint, content binary, lines array<bigint>, sizes array<bigint>")


def measured(docs: DataFrame) -> DataFrame:
    """Base figures and line hashes of (id, host, text, row), without the texts."""
    schema = extended(docs.drop("text"), _MEASURED)
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.list_(pa.int64())] * 2

    def run(batches):
        for batch in sliced(batches):
            rows = [measure(t) for t in batch.column("text").to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "text"] + made,
                names=schema.names)
    return docs.mapInArrow(run, schema)


def distinct_contents(figures: DataFrame) -> DataFrame:
    """(host, content, lines, sizes): copies of one text on a host are one document.

    ``content`` is the hash of a text's normalised lines; copies are put
    together before the shuffle.
    """
    return figures.groupBy("host", "content").agg(F.first("lines").alias("lines"),
                                                  F.first("sizes").alias("sizes"))


def frequent_lines(contents: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(host, line, n_docs) of lines that more than ``max_docs`` contents of a host hold."""
    return (contents.select("host", F.explode(F.array_distinct("lines")).alias("line"))
            .groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
            .where(F.col("n_docs") > max_docs))


def hits(contents: DataFrame, frequent: DataFrame) -> DataFrame:
    """(of_host, of_content, frequent, removed_words) of contents with frequent lines."""
    held = contents.select(F.col("host").alias("of_host"), F.col("content").alias("of_content"),
                           F.explode(F.arrays_zip("lines", "sizes")).alias("one"))
    met = held.join(frequent, held["of_host"].eqNullSafe(frequent["host"])
                    & (held["one.lines"] == frequent["line"]))
    return met.groupBy("of_host", "of_content").agg(
        F.collect_set("line").alias("frequent"), F.sum("one.sizes").alias("removed_words"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  host_col: str = "source", max_docs: int = MAX_DOCS,
                  max_removed: int = MAX_REMOVED) -> DataFrame:
    """One row per document: base figures, verdict and the lines to remove.

    Columns: id, row_key, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words, frequent (hashes of the
    document's lines above the limit, see :func:`without_lines`), kept.

    ``base_failed``: fewer than 50 words, or over half of the words in
    repeated 3-word windows.  ``kept``: passes the base rules, loses at most
    ``max_removed`` percent of its words to the line removal and has 50 left.
    Null and empty texts have no words and fail the base rules; a null host is
    a host; repeated rows count as one document and get the same verdict; an
    empty table gives an empty result.

    The limit is a number of documents, the same for hosts of any size.
    Frequent lines meet documents as rows of (host, line), counted before the
    shuffle; contents and frequent lines are written first, so that Spark can
    split a line that very many documents hold.
    """
    base = narrowed(docs, id=id_col, text=text_col, host=host_col).withColumn(
        "row", row_key(F.col("id"), F.col("text")))
    figures = pinned(measured(base.select("id", "host", "row", "text")), "quality")
    contents = pinned(distinct_contents(figures), "contents")
    found = pinned(hits(contents, pinned(frequent_lines(contents, max_docs), "frequent")), "hits")
    joined = figures.join(found, figures["host"].eqNullSafe(found["of_host"])
                          & (figures["content"] == found["of_content"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    depleted = (100 * removed > max_removed * F.col("n_words")) | (
        F.col("n_words") - removed < MIN_WORDS)
    return joined.select(
        F.col("id").alias(id_col), F.col("row").alias("row_key"), "n_words", "word_chars",
        "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        removed.alias("removed_words"),
        F.coalesce("frequent", F.array().cast("array<bigint>")).alias("frequent"),
        (~failed & ~depleted).alias("kept"))


def without_lines(text: Column, frequent: Column) -> Column:
    """The text without the lines whose hash is in ``frequent``."""
    @F.pandas_udf("string")
    def cut(texts, hashes):
        out = []
        for text, gone in zip(texts, hashes, strict=True):
            if text is not None and gone is not None and len(gone):
                gone = set(gone)
                text = "\n".join(x for x in text.split("\n") if line_hash(x) not in gone)
            out.append(text)
        import pandas as pd
        return pd.Series(out, dtype=object)
    return cut(text, frequent)
