"""Sequence vocabulary and document encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handprint.functions.arrays import materialize
from handprint.operators.ranking import global_rank

UNK, PAD = "<UNK>", "<PAD>"


def build_vocabulary(tokens: DataFrame, min_frequency: int = 5, token: str = "token"
                     ) -> DataFrame:
    """Tokens seen >= min_frequency times; ids 0 = <UNK>, 1 = <PAD>, then
    2.. by decreasing frequency (ties by token).  Ranked with the
    distributed global rank: the vocabulary can be large."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_frequency)
    ranked = global_rank(counts.withColumn("neg", -F.col("n")), ["neg", token], "r")
    return ranked.select(token, (F.col("r") + 1).alias("id"), "n")


def encode(docs: DataFrame, vocab: DataFrame, doc_keys: list[str], token: str = "token",
           pos: str = "pos") -> DataFrame:
    """(keys..., ids ARRAY<BIGINT>) in token order, unknown -> 0.

    ``docs`` is long (keys, pos, token); the vocabulary is joined (AQE picks
    broadcast when it is small) and ids are collected per document in
    position order."""
    j = docs.join(vocab.select(token, "id"), token, "left").withColumn(
        "id", F.coalesce("id", F.lit(0)))
    g = j.groupBy(*doc_keys).agg(F.array_sort(F.collect_list(F.struct(pos, "id"))).alias("s"))
    return g.select(*doc_keys, F.transform("s", lambda x: x["id"]).alias("ids"))


def encode_bilevel(docs: DataFrame, vocab: DataFrame, doc: str, sentence: str,
                   token: str = "token", pos: str = "pos", sentences: int | None = None,
                   words: int | None = None) -> DataFrame:
    """(doc, n_sentences, ids ARRAY<ARRAY<BIGINT>>): a document's sentences in order,
    each of ``words`` ids, ``sentences`` of them, short ones padded with <PAD>.

    ``docs`` is long (doc, sentence, pos, token); a null token marks a sentence
    without words.  By default both sizes are the corpus's largest.
    """
    found = encode(docs.filter(F.col(token).isNotNull()), vocab, [doc, sentence], token, pos)
    every = docs.select(doc, sentence).distinct().join(found, [doc, sentence], "left").withColumn(
        "ids", F.coalesce("ids", F.array().cast("array<bigint>")))
    grouped = every.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(sentence, "ids")))
                                     .alias("s"))
    rows = materialize(grouped.select(doc, F.size("s").cast("bigint").alias("n_sentences"),
                                      F.transform("s", lambda x: x["ids"]).alias("ids")))
    if sentences is None or words is None:
        most = rows.agg(F.max("n_sentences").alias("s"), F.max(F.array_max(F.transform(
            "ids", lambda x: F.size(x)))).alias("w")).first()
        sentences = most["s"] or 0 if sentences is None else sentences
        words = most["w"] or 0 if words is None else words
    blank = F.array_repeat(F.lit(1).cast("bigint"), int(words))
    padded = F.transform("ids", lambda x: pad(x, int(words)))
    return rows.select(doc, "n_sentences", F.slice(F.concat(
        padded, F.array_repeat(blank, int(sentences))), 1, int(sentences)).alias("ids"))


def pad(ids, length: int):
    """Right-pad (or cut) an id array to ``length`` with the <PAD> id 1."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(1).cast("bigint"), length)), 1, length)
