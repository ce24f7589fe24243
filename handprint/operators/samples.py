"""Samples of N words cut from each text.

All of it happens inside the document's row with array functions: the
token array, the positions of its words, the head margin and the
boundaries of every complete sample are computed without exploding the
text or shuffling tokens.  A sample is a contiguous token slice: it starts
right after the last word of the previous sample (or at the margin) and
ends on its N-th word, so punctuation after a sample's last word opens the
next one and an incomplete tail is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.functions.arrays import bind
from handprint.functions.hashing import hash_key

# Fixed values of the reference's sampling plan.
SAMPLE_SIZE = 1000
MAX_NB_SAMPLE = 5
MARGIN = SAMPLE_SIZE // 2


def plan_samples(docs: DataFrame, size: int = SAMPLE_SIZE, max_samples: int = MAX_NB_SAMPLE,
                 margin: int = MARGIN, seed: int = 42, doc: str = "doc_id",
                 text: str = "text", whole: bool = False) -> DataFrame:
    """(doc, sample, start_pos, end_pos, toks) for the chosen samples.

    F2: margin is ``margin``, or (n - size) // 2 when n < 2 * margin + size
    (never below 0: shorter texts cannot hold a sample anyway); the number
    kept is min((n - 2 * margin) // size, max_samples) when that exceeds 1,
    else 1.  F3: samples are chosen by md5(seed|doc|sample) order.
    F4 (``whole=True``): one sample 0 spanning the whole text.

    Words stand apart, so ``size`` of them take 2 * size - 1 characters at least;
    shorter texts hold no sample and are not tokenised.
    """
    if not whole:
        docs = docs.filter(F.length(F.lower(text)) >= 2 * size - 1)
    d = bind(docs.select(doc, text), [doc], toks=T.tokens(F.col(text)))
    if whole:
        return d.select(doc, F.lit(0).cast("bigint").alias("sample"),
                        F.lit(0).cast("bigint").alias("start_pos"),
                        (F.size("toks") - 1).cast("bigint").alias("end_pos"), "toks")
    n = F.size("toks")
    is_w = T.IS_WORD_RE
    short = n < 2 * margin + size
    potential = F.floor((n - 2 * margin) / size)
    d = bind(d, wpos=F.filter(
        F.transform("toks", lambda t, i: F.when(t.rlike(is_w), i).otherwise(F.lit(-1))),
        lambda x: x >= 0),
        margin=F.when(short, F.greatest(F.floor((n - size) / 2), F.lit(0)))
        .otherwise(F.lit(margin)).cast("int"),
        nsel=F.when(~short & (potential > 1), F.least(potential, F.lit(max_samples)))
        .otherwise(F.lit(1)).cast("int"))
    d = bind(d, k0=F.size(F.filter("wpos", lambda x: x < F.col("margin"))))
    d = bind(d, ncomplete=F.floor((F.size("wpos") - F.col("k0")) / size).cast("int"))
    # 0-based bounds; wpos[k] (SQL subscript) is 0-based.
    bounds = F.transform(
        F.sequence(F.lit(0), F.col("ncomplete") - 1),
        lambda s: F.struct(
            hash_key(seed, F.col(doc), s).alias("h"),
            s.alias("sample"),
            F.when(s == 0, F.col("margin"))
             .otherwise(F.col("wpos")[F.col("k0") + s * size - 1] + 1).alias("start_pos"),
            F.col("wpos")[F.col("k0") + (s + 1) * size - 1].alias("end_pos")))
    chosen = F.slice(F.array_sort(bounds), 1, F.col("nsel"))
    d = d.withColumn("chosen", F.when(F.col("ncomplete") > 0, chosen))
    return (d.select(doc, "toks", F.explode("chosen").alias("c"))
            .select(doc, F.col("c.sample").cast("bigint").alias("sample"),
                    F.col("c.start_pos").cast("bigint").alias("start_pos"),
                    F.col("c.end_pos").cast("bigint").alias("end_pos"), "toks"))


def sample_tokens(plan: DataFrame) -> DataFrame:
    """Replace the document tokens by the sample's own token slice."""
    return plan.withColumn(
        "toks", F.slice("toks", (F.col("start_pos") + 1).cast("int"),
                        (F.col("end_pos") - F.col("start_pos") + 1).cast("int")))


def sample_shares(samples: DataFrame, terms: DataFrame, family: str, term: str = "token",
                  doc: str = "doc_id") -> DataFrame:
    """E5: share of each vocabulary term among the sample's vocabulary terms.

    ``samples`` has (doc, sample, items ARRAY<STRING>) — the words, or the
    tag trigrams, of each sample; ``terms`` the bounded vocabulary, probed
    through a broadcast hash semi-join.  Counts are partially aggregated
    before the shuffle; the denominator is a window over the count rows.
    """
    items = samples.select(doc, "sample", F.explode("items").alias("term"))
    hits = items.join(F.broadcast(terms.select(F.col(term).alias("term")).distinct()),
                      "term", "left_semi")
    c = hits.groupBy(doc, "sample", "term").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(doc, "sample"))
    return c.select(doc, "sample", F.concat(F.lit(f"${family}$"), F.col("term")).alias("feature"),
                    (F.col("n") / tot).alias("value"))
