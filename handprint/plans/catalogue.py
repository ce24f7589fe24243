"""The query catalogue: each entry reads the driver tables at ``sf_dir``.

Stand-ins (see FIXTURES.md): ``documents`` is the corpus (doc_id = file,
source = author, lang = genre), ``labels`` a second target, ``embeddings``
the document vectors, ``conversations`` short texts with a role.

Every float that leaves a query is rounded to 6 places so the SQL oracle
can be compared value by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from handprint.functions import text as T
from handprint.functions.arrays import bind, materialize, write_table
from handprint.functions.text import round6
from handprint.operators import (clusters, features, linkage, metrics, pairs, ranking, samples,
                                 ppm, select, splits, vocab)
from handprint.operators import imposters as imp_op
from handprint.operators import (batches, classify, encode, filters, linear, logistic, models,
                                 pca, resample, spanning, ward)
from handprint.functions.hashing import hash_key
from handprint.session import checkpoint_dir
from handprint.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed parameters of the catalogue.
MIN_WORDS = 300          # length limit of the reject report (B1)
N_MFW = 100              # vocabulary of the minimum slice
MOISL_Z = 1.91           # z used by apply_moisl in the reference


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their whole texts, as they are read: texts are never shuffled."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("author"),
                                                    "text")


def _mfw_counts(spark, sf_dir, k=N_MFW):
    """(corpus, top-k word counts per document, top-k vocabulary).

    The long count table feeds many aggregates and scalar subqueries
    downstream, so it is checkpointed once (with the document ids) instead
    of re-tokenising the corpus for each of them.  Texts are read twice, for
    the corpus totals and for the counts of the top words, so that no row for
    every word of every document is shuffled or written.
    """
    docs = corpus(spark, sf_dir)
    words = vocab.word_table(docs)
    totals = vocab.corpus_counts(words.select("token", F.lit(1).alias("n")))
    top = materialize(vocab.top_terms(totals, k))
    return docs, materialize(vocab.term_counts(vocab.restrict(words, top, bounded=True))), top


def _doc_ids(docs):
    return materialize(docs.select("doc_id", "author"))


def _profiles(spark, sf_dir, k=N_MFW):
    """(authors, top-k word counts per author): every author's whole texts as one row."""
    docs, fc, _ = _mfw_counts(spark, sf_dir, k)
    ids = _doc_ids(docs)
    counts = (fc.join(ids, "doc_id").groupBy("author", F.col("token").alias("feature"))
              .agg(F.sum("n").alias("n")))
    return ids.select("author").distinct(), materialize(counts)


@query
def moisl_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimum slice: top-100 words -> counts per author -> MOISL z=1.91."""
    authors, counts = _profiles(spark, sf_dir)
    res = select.moisl(counts, authors, z=MOISL_Z, doc="author")
    return res.select("feature", "freq", round6(F.col("mean_prob")).alias("mean_prob"),
                      round6(F.col("score")).alias("score"), "keep")


# ---------------------------------------------------------------------------
# Step 1: corpus filters and counts
# ---------------------------------------------------------------------------

# Fixed values of the stand-in block lists.
BLOCKED_AUTHORS = ("src7", "src13")
ALLOWED_GENRES = ("en",)


@query
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C2 over the whole table: words per document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.col("source").alias("author"),
                    T.word_count(F.col("text")).alias("n_words"))


@query
def author_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and words per author."""
    d = corpus(spark, sf_dir)
    return d.groupBy("author").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.sum(T.word_count(F.col("text"))).alias("n_words"))


@query
def reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching rejection reason per document, then a report."""
    d = table(spark, sf_dir, "documents")
    reason = (F.when(F.col("source").isin(*BLOCKED_AUTHORS), "author")
              .when(~F.col("lang").isin(*ALLOWED_GENRES), "genre")
              .when(T.word_count(F.col("text")) < MIN_WORDS, "short")
              .otherwise("kept"))
    return (d.select(reason.alias("reason"), "source")
            .groupBy("reason").agg(F.count(F.lit(1)).alias("n_docs"),
                                   F.count_distinct("source").alias("n_authors")))


# ---------------------------------------------------------------------------
# Step 2: token features
# ---------------------------------------------------------------------------

N_TOP_TOKENS = 200
N_MFT = 1000


@query
def function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function-word counts per document."""
    d = corpus(spark, sf_dir)
    w = vocab.word_table(d).filter(F.col("token").isin(*T.FUNCTION_WORDS))
    return vocab.term_counts(w).withColumnRenamed("token", "feature")


@query
def pos_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus counts of tag trigrams (punctuation removed first)."""
    d = corpus(spark, sf_dir)
    tags = F.expr(f"transform(words, w -> {T.pos_rule_lambda('w')})")
    # Tags are bound to a column once; n-grams then index into it.
    grams = (bind(bind(d, [], words=T.words(F.col("text"))), [], tags=tags)
             .select(F.explode(T.ngrams(F.col("tags"), 3)).alias("trigram")))
    return grams.groupBy("trigram").agg(F.count(F.lit(1)).alias("n"))


@query
def affix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus counts of word affixes."""
    return _affix_totals(corpus(spark, sf_dir))


@query
def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2 + G1: most frequent tokens, tags u and n excluded (a top-k report)."""
    d = corpus(spark, sf_dir)
    t = vocab.token_table(d).filter(~T.pos_rule().isin("u", "n"))
    top = vocab.top_terms(t.groupBy("token").agg(F.count(F.lit(1)).alias("n")), N_TOP_TOKENS)
    return top.select("rank", "token", "n")


def _affix_totals(d):
    """(affix, n): words are counted first, so that affixes are cut from different words only."""
    totals = vocab.word_table(d).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return vocab.affix_long(totals, "n").groupBy("affix").agg(F.sum("n").alias("n"))


def _affix_vocab(d):
    return vocab.top_terms(_affix_totals(d), N_MFT, "affix")


@query
def affix_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each top affix in the document's ``_`` text.

    The bounded vocabulary goes to every task and texts are read once: no join,
    no shuffle of tokens.
    """
    d = corpus(spark, sf_dir)
    top = [r["affix"] for r in _affix_vocab(d).select("affix").collect()]  # N_MFT rows
    u = T.underscore_text(F.array_join(T.tokens(F.col("text")), " "))
    per = vocab.affix_occurrences(d.select("doc_id", u.alias("u")), top, "doc_id", "u", total="tot")
    return per.select("doc_id", "feature", "n", round6(F.col("n") / F.col("tot")).alias("value"))


@query
def masked_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: tokens outside the top-100 words (and not punctuation) become their tag."""
    docs, _, top = _mfw_counts(spark, sf_dir)
    arr = top.select(F.collect_list("token")).scalar()
    rule = T.pos_rule_lambda("t")
    masked = F.expr(
        f"array_join(transform(toks, t -> CASE WHEN NOT (t rlike '{T.sql_literal(T.IS_WORD_RE)}') "
        f"OR array_contains(mfw, t) THEN t ELSE {rule} END), ' ')")
    return (docs.select("doc_id", T.tokens(F.col("text")).alias("toks"))
            .withColumn("mfw", arr).select("doc_id", masked.alias("masked")))


# ---------------------------------------------------------------------------
# Step 4: normalise and prune
# ---------------------------------------------------------------------------

DROP_LOW_DOCS = 0.01     # share of documents (rounded half to even)
DROP_LOW_FREQ = 10
N_RANKED = 10


def _mfw_values(spark, sf_dir, k=N_MFW):
    docs, fc, top = _mfw_counts(spark, sf_dir, k)
    return _doc_ids(docs), fc.select("doc_id", F.col("token").alias("feature"),
                           F.col("n").cast("double").alias("value")), top


@query
def relative_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7 on the top-100 word counts."""
    _, v, _ = _mfw_values(spark, sf_dir)
    r = features.relative(v)
    return r.select("doc_id", "feature", round6(F.col("value")).alias("value"))


def _normalised(values, ids, unit):
    """E7 -> B8 -> E8 -> E9 on a bounded feature list: (vectors, index)."""
    rel = materialize(features.relative(values, doc=unit))
    idx = features.feature_index(features.non_constant(rel, ids))
    idx = materialize(idx)
    return features.l2(features.zscore_vectors(rel, ids, idx, doc=unit)), idx


def normalised_vectors(spark, sf_dir):
    """Top-100 words -> relative -> drop constant -> z -> L2, one vector per document."""
    docs, v, _ = _mfw_values(spark, sf_dir)
    vec, idx = _normalised(v, docs.select("doc_id"), "doc_id")
    return vec, idx, docs


def author_vectors(spark, sf_dir):
    """I10 preprocessing: author profiles, MOISL keep -> relative -> drop constant -> z -> L2."""
    authors, counts = _profiles(spark, sf_dir)
    v = counts.select("author", "feature", F.col("n").cast("double").alias("value"))
    kept = select.moisl(v, authors, z=MOISL_Z, doc="author", value="value").filter("keep")
    vec, idx = _normalised(features.align(v, kept.select("feature")), authors, "author")
    return vec, idx, authors


@query
def zscore_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense normalised matrix as (doc, feature, value)."""
    vec, idx, _ = normalised_vectors(spark, sf_dir)
    out = features.vectors_to_long(vec, idx)
    return out.select("doc_id", "feature", round6(F.col("value")).alias("value"))


@query
def drop_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B12 on the top-1000 word counts: surviving features with their totals."""
    docs, v, _ = _mfw_values(spark, sf_dir, 1000)
    kept = select.drop_low(v, docs.select("doc_id"), DROP_LOW_DOCS, DROP_LOW_FREQ)
    return kept.groupBy("feature").agg(F.sum("value").cast("bigint").alias("total"))


@query
def ranked_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words ranked by corpus total."""
    fw = function_words(spark, sf_dir)
    return select.ranked_features(fw, N_RANKED).select("rank", "feature", "n")


def _turn_counts(spark, sf_dir):
    c = vocab.term_counts(vocab.word_table(_turns(spark, sf_dir), "doc"), "doc")
    return c.select(F.col("doc").alias("doc_id"), F.col("token").alias("feature"),
                    F.col("n").cast("double").alias("value"))


@query
def align_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns aligned to the top-100 vocabulary of the documents."""
    _, _, top = _mfw_values(spark, sf_dir)
    return features.align(_turn_counts(spark, sf_dir),
                          top.select(F.col("token").alias("feature")))


@query
def missing_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: words of the documents' top 1000 that no conversation turn has."""
    _, _, top = _mfw_values(spark, sf_dir, 1000)
    return features.missing_features(top.select(F.col("token").alias("feature")),
                                     _turn_counts(spark, sf_dir))


@query
def merge_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: document counts plus turn counts aligned to them; totals per corpus."""
    _, docs, _ = _mfw_values(spark, sf_dir)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    m = features.merge(docs.withColumn("corpus", F.lit("documents")),
                       _turn_counts(spark, sf_dir).withColumn("corpus", F.lit("turns")))
    return m.groupBy("corpus", "feature").agg(F.sum("value").cast("bigint").alias("n"),
                                              F.count(F.lit(1)).alias("n_docs"))


# ---------------------------------------------------------------------------
# Step 3: samples, splits, folds
# ---------------------------------------------------------------------------

SEED = 42
N_SAMPLE_MFW = 1000
N_SAMPLE_MFP = 100


def _all_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _chosen_samples(spark, sf_dir):
    return samples.sample_tokens(samples.plan_samples(_all_docs(spark, sf_dir), seed=SEED))


@query
def text_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of 1000 words (margin 500, at most 5 per text, md5 choice)."""
    s = _chosen_samples(spark, sf_dir)
    return s.select("doc_id", "sample", "start_pos", "end_pos",
                    (F.col("end_pos") - F.col("start_pos") + 1).alias("n_tokens"),
                    F.size(F.filter("toks", lambda t: T.is_word(t))).cast("bigint").alias("length"),
                    F.array_join("toks", " ").alias("tokens"))


def _tag_array(col: str = "words"):
    return F.expr(f"transform({col}, w -> {T.pos_rule_lambda('w')})")


@query
def sample_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E5: per-sample shares of the top words ($MFW$) and tag trigrams ($POS$)."""
    docs = _all_docs(spark, sf_dir)
    wt = vocab.word_table(docs).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    mfw = vocab.top_terms(wt.filter(T.pos_rule(is_word="true") != "n"), N_SAMPLE_MFW)
    tri = (bind(bind(docs, [], words=T.words(F.col("text"))), [], tags=_tag_array())
           .select(F.explode(T.ngrams(F.col("tags"), 3)).alias("token")))
    mfp = vocab.top_terms(tri.groupBy("token").agg(F.count(F.lit(1)).alias("n")), N_SAMPLE_MFP)
    # Both families read the samples, so they are cut once.
    s = write_table(bind(_chosen_samples(spark, sf_dir), ["doc_id", "sample"],
                         words=F.filter("toks", lambda t: T.is_word(t))), "samples")
    w_items = s.select("doc_id", "sample", F.col("words").alias("items"))
    p_items = (bind(s, ["doc_id", "sample"], tags=_tag_array())
               .select("doc_id", "sample", T.ngrams(F.col("tags"), 3).alias("items")))
    out = samples.sample_shares(w_items, mfw, "MFW").unionByName(
        samples.sample_shares(p_items, mfp, "POS"))
    return out.select("doc_id", "sample", "feature", round6(F.col("value")).alias("value"))


def _author_rows(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", "author")


def _label_rows(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", "quality")


@query
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """authors with > 1 document split 10% test / 10% dev / rest train."""
    r = splits.group_split(_author_rows(spark, sf_dir), "author", seed=SEED, ratio=10)
    return r.select("doc_id", "author", "split")


@query
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """10% held out per quality class."""
    r = splits.holdout_split(_label_rows(spark, sf_dir), "quality", "doc_id", 0.1, SEED)
    return r.select("doc_id", "quality", "split")


@query
def kfold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 stratified contiguous folds by author in doc_id order."""
    r = splits.kfold_roles(_author_rows(spark, sf_dir), "author", "doc_id", 5)
    return r.select("doc_id", "author", F.col("fold").cast("bigint").alias("fold"), "role")


@query
def under_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality classes cut to the smallest."""
    return splits.under_sample(_label_rows(spark, sf_dir), "quality", "doc_id", SEED).select(
        "doc_id", "quality")


@query
def over_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: quality classes grown to the largest."""
    r = splits.over_sample(_label_rows(spark, sf_dir), "quality", "doc_id", SEED)
    return r.select("doc_id", "quality", F.col("copy").cast("bigint").alias("copy"))


@query
def m_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two epochs of batches with 4 rows per author."""
    r = splits.m_per_class(_author_rows(spark, sf_dir), "author", "doc_id", m=4, epochs=2,
                           seed=SEED)
    return r.select("doc_id", "author", F.col("epoch").cast("bigint").alias("epoch"), "batch")


# ---------------------------------------------------------------------------
# Step 5: distances, pairs, metrics
# ---------------------------------------------------------------------------

PAIR_THRESHOLD = 1.4     # attribution threshold on unit-vector Euclidean distance
CURVE_STEP = 0.005
F05U_RADIUS = 0.01
HARD_PAIRS = 20


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")


#: The stated query set of searches and verification: every row whose id is divisible by this.
QUERY_STEP = 20


def _compared(vecs, id_col="vec_id"):
    return vecs.filter(F.col(id_col) % QUERY_STEP == 0)


def _known(vecs, id_col="vec_id"):
    """All rows that can be told from others."""
    return vecs.filter(F.col(id_col).isNotNull())


def _pairs(spark, sf_dir, metric, normalise):
    e = _embeddings(spark, sf_dir)
    return pairs.compared_pairs(_compared(e), e, "vec_id", "embedding", ["label"], metric,
                                normalise)


@query
def manhattan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City-block distance of the query vectors to every other vector."""
    p = _pairs(spark, sf_dir, "cityblock", False)
    return p.select("left_id", "right_id", "distance",
                    (F.col("left_label") == F.col("right_label")).alias("is_pair"))


def unit_pairs(spark, sf_dir):
    """Euclidean distance of unit vectors, query vectors against all others."""
    p = _pairs(spark, sf_dir, "euclidean", True)
    return p.withColumn("is_pair", F.col("left_label") == F.col("right_label"))


def unit_counts(spark, sf_dir):
    """The same pairs as counts per distance, reduced inside the blocks."""
    e = _embeddings(spark, sf_dir)
    return pairs.pair_counts(_compared(e), e, "vec_id", "embedding", "label", "euclidean", True)


@query
def snr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal-to-noise distance var(a-b)/var(a) of query vectors to all others."""
    return _pairs(spark, sf_dir, "snr", True).select("left_id", "right_id", "distance")


@query
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine distance of the query vectors to every other vector."""
    return _pairs(spark, sf_dir, "cosine", False).select("left_id", "right_id", "distance")


@query
def sqeuclidean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared Euclidean distance of the query vectors to every other vector."""
    return _pairs(spark, sf_dir, "sqeuclidean", False)


def _frame(spark, sf_dir):
    return pairs.pairs_frame(unit_pairs(spark, sf_dir), PAIR_THRESHOLD)


@query
def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair table (classes, labels, Distance, Probability, Attribution, IsAPair, K)."""
    f = _frame(spark, sf_dir)
    # 1 - d is a whole number of millionths but for its last bits: round's decimals aren't needed.
    return f.withColumn("Probability", F.rint(F.col("Probability") * 1e6) / 1e6)


@query
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class shares of correct attributions."""
    s = metrics.pair_scores(_frame(spark, sf_dir))
    return s.select("Class", *[round6(F.col(c)).alias(c) for c in ("Accuracy", "Precision",
                                                                   "Recall")], "K")


def _curve(spark, sf_dir):
    return metrics.threshold_curve(unit_counts(spark, sf_dir), CURVE_STEP)


_CURVE_COLS = ("Threshold", "Sensitivity", "Specificity", "F1", "AuRoc")


@query
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: sensitivity / specificity / F1 / AUC for thresholds 0.005 apart."""
    c = _curve(spark, sf_dir)
    return c.select(*[round6(F.col(x)).alias(x) for x in _CURVE_COLS], "K")


@query
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold maximising sensitivity + 2 * specificity."""
    b = metrics.best_threshold(_curve(spark, sf_dir), 1.0, 2.0)
    return b.select(*[round6(F.col(x)).alias(x) for x in _CURVE_COLS], "K")


@query
def threshold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: true and false positives and negatives at the attribution threshold."""
    return metrics.confusion(unit_counts(spark, sf_dir), PAIR_THRESHOLD)


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: tie-aware ROC AUC of -distance against IsAPair."""
    return metrics.roc_auc(unit_counts(spark, sf_dir)).select(round6(F.col("auc")).alias("auc"))


@query
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: ROC points at every distinct distance."""
    r = metrics.roc_points(unit_counts(spark, sf_dir))
    return r.select("threshold", round6(F.col("fpr")).alias("fpr"),
                    round6(F.col("tpr")).alias("tpr"))


@query
def roc_thinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: every 10th ROC point at which the sensitivity has changed."""
    r = metrics.roc_thinned(metrics.roc_points(unit_counts(spark, sf_dir)), 10)
    return r.select("threshold", round6(F.col("fpr")).alias("fpr"),
                    round6(F.col("tpr")).alias("tpr"))


@query
def strong_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25/50/75/90th percentiles of distance among true pairs."""
    s = metrics.strong_thresholds(unit_counts(spark, sf_dir))
    return s.select("percentile", F.round("threshold", 9).alias("threshold"))


@query
def f05u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: F0.5u with a non-answer band of +-0.01 around the threshold."""
    s = metrics.f05u(unit_counts(spark, sf_dir), PAIR_THRESHOLD, F05U_RADIUS)
    return s.select(round6(F.col("f05u")).alias("f05u"), "n_tp", "n_fp", "n_fn", "n_u")


@query
def hard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 closest false pairs (a top-k report)."""
    e = _embeddings(spark, sf_dir)
    return pairs.closest_false(_compared(e), e, "vec_id", "embedding", HARD_PAIRS, "label",
                               "euclidean", True)


@query
def pair_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrastive loss and hardest-triplet margin loss."""
    s = metrics.pair_losses(unit_pairs(spark, sf_dir))
    return s.select(*[round6(F.col(c)).alias(c) for c in ("pos_loss", "neg_loss",
                                                          "contrastive_loss", "triplet_loss")],
                    "n_anchors")


@query
def mined_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor the easy positive with its semihard and easy negatives.

    What can be mined is found inside the blocks, in two passes: the ends of each anchor's
    distances, then the nearest negative beyond the mined positive.
    """
    e = _embeddings(spark, sf_dir)
    p = materialize(pairs.extreme_pairs(_compared(e), e, "vec_id", "embedding", "label",
                                        "euclidean", True))
    mined = metrics.mine(p, "easy", "easy")
    anchors = _compared(e).join(mined.select(F.col("anchor").alias("vec_id"), "d_ap"), "vec_id")
    beyond = pairs.extreme_pairs(anchors, e, "vec_id", "embedding", "label", "euclidean", True,
                                 beyond="d_ap")
    semi = metrics.mine(materialize(p.unionByName(beyond)), "easy", "semihard")
    easy = mined.select("anchor", F.col("d_an").alias("d_easy"))
    return semi.join(easy, "anchor").select("anchor", "d_ap", "d_an", "d_easy")


@query
def batch_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of 4 vectors per label over two epochs, each forming, scoring and
    mining its own pairs."""
    e = _embeddings(spark, sf_dir)
    plan = splits.m_per_class(e.select("vec_id", "label"), "label", "vec_id", m=4, epochs=2,
                              seed=SEED).select("vec_id", F.col("epoch").cast("bigint").alias("epoch"),
                                                "batch")
    s = batches.batch_scores(plan.join(e, "vec_id"), ["epoch", "batch"], "embedding", "label",
                             "vec_id")
    return s.select("epoch", "batch", "n_rows", "n_pairs", "n_true", "n_anchors", "n_semihard",
                    F.round("auroc", 5).alias("auroc"),
                    *[round6(F.col(c)).alias(c) for c in batches.MINED])


@query
def asof_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and counts of the training comparators attached to each new distance.

    Vectors are split per label (10% held out, md5 order); every vector is compared with all
    others, and pairs with a held-out comparator are new, their distances rounded to 2 places.
    """
    e = _embeddings(spark, sf_dir)
    split = splits.holdout_split(e.select("vec_id", "label"), "label", "vec_id", 0.1, SEED).select(
        "vec_id", (F.col("split") == "holdout").alias("held"))
    marked = materialize(e.join(split, "vec_id"))
    p = materialize(pairs.pair_counts(_known(e), marked, "vec_id", "embedding", "label",
                                      "euclidean", True, by="held"))
    new = p.filter("held").select(F.round("distance", 2).alias("distance"))
    r = metrics.asof_rates(p.filter(~F.col("held")), new)
    return r.select("distance", *[round6(F.col(c)).alias(c) for c in ("tpr", "precision", "fpr")],
                    "tp", "fp", "tn", "fn")


# ---------------------------------------------------------------------------
# Step 6: clustering
# ---------------------------------------------------------------------------

N_CLUSTERS = 9
CUT_HEIGHT = 8.0


def _author_tree(spark, sf_dir, method="ward"):
    """MOISL -> relative -> z + L2 on author profiles -> city-block pairs -> linkage."""
    vec, _, authors = author_vectors(spark, sf_dir)
    p = pairs.all_pairs(vec, "author", "vec", None, "cityblock")
    return linkage.linkage(p, authors, method, id_col="author"), authors


def _tree_out(tree):
    return tree.select("step", "left", "right", round6(F.col("height")).alias("height"), "size")


def _leaf_clusters(tree, authors, **how):
    leaves = ranking.global_rank(authors, ["author"], "r").select(
        "author", (F.col("r") - 1).alias("leaf"))
    return leaves.join(linkage.cut(tree, leaves.count(), **how), "leaf").select("author", "cluster")


@query
def ward_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward linkage on city-block distances of the author profiles."""
    return _tree_out(_author_tree(spark, sf_dir)[0])


@query
def linkage_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: average linkage on the same distances."""
    return _tree_out(_author_tree(spark, sf_dir, "average")[0])


@query
def linkage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: complete linkage on the same distances."""
    return _tree_out(_author_tree(spark, sf_dir, "complete")[0])


@query
def linkage_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: single linkage on the same distances."""
    return _tree_out(_author_tree(spark, sf_dir, "single")[0])


@query
def clusters_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Ward tree cut into 9 clusters; (author, cluster)."""
    return _leaf_clusters(*_author_tree(spark, sf_dir), k=N_CLUSTERS)


@query
def clusters_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average tree cut at a height; (author, cluster)."""
    return _leaf_clusters(*_author_tree(spark, sf_dir, "average"), height=CUT_HEIGHT)


@query
def cut_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I8: the height that cuts the Ward tree into 9 clusters."""
    tree, authors = _author_tree(spark, sf_dir)
    return linkage.height_for(tree, authors.count(), N_CLUSTERS).select(
        F.col("k").cast("bigint").alias("k"), round6(F.col("height")).alias("height"))


@query
def spanning_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: the edges of the minimum spanning tree of all vectors (single linkage)."""
    tree = spanning.spanning_tree(_embeddings(spark, sf_dir), "vec_id", "embedding")
    return tree.withColumn("distance", round6(F.col("distance")))


@query
def single_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 9 single-linkage clusters, named by their smallest id."""
    e = _embeddings(spark, sf_dir)
    tree = spanning.spanning_tree(e, "vec_id", "embedding")
    return spanning.tree_clusters(tree, e.select("vec_id"), k=N_CLUSTERS)


@query
def ward_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward's tree of all vectors by Euclidean distance."""
    return _tree_out(ward.ward_tree(_embeddings(spark, sf_dir), "vec_id", "embedding"))


@query
def eta2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation ratio of each normalised feature against the author."""
    vec, idx, docs = normalised_vectors(spark, sf_dir)
    long = features.vectors_to_long(vec, idx)
    e = clusters.eta2(long, docs.select("doc_id", F.col("author").alias("cls")))
    return e.select("feature", round6(F.col("eta2")).alias("eta2"))


# ---------------------------------------------------------------------------
# Step 7: compression models
# ---------------------------------------------------------------------------

PPM_ORDER = 5
TURN_GAPS = (1, 2)       # verification pairs: a turn and the turns so many places later


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return c.withColumn("doc", F.concat_ws("-", "conv_id", "turn"))


def _turn_pairs(turns):
    """The pair table to score: each turn with those TURN_GAPS places later."""
    a = turns.select("conv_id", F.col("turn").alias("turn_a"), F.col("doc").alias("a"),
                     F.col("role").alias("role_a"))
    b = turns.select("conv_id", F.col("turn").alias("turn_b"), F.col("doc").alias("b"),
                     F.col("role").alias("role_b"))
    out = None
    for gap in TURN_GAPS:
        j = a.withColumn("turn_b", F.col("turn_a") + gap).join(b, ["conv_id", "turn_b"])
        out = j if out is None else out.unionByName(j)
    return out.withColumn("is_pair", F.col("role_a") == F.col("role_b"))


@query
def char_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn and context length, distinct contexts, grams and characters."""
    t = _turns(spark, sf_dir)
    m = ppm.char_model(t.select("doc", "text"), "doc", "text", PPM_ORDER, first=True)
    return (m.groupBy("doc", F.length("ctx").cast("bigint").alias("k"))
            .agg(F.count_if("first").alias("n_contexts"), F.count(F.lit(1)).alias("n_grams"),
                 F.sum("n").alias("n_chars")))


@query
def cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of each turn under the other's order-5 model, both ways."""
    t = _turns(spark, sf_dir)
    docs = t.select("doc", "text")
    v = ppm.alphabet_size(docs).select("v").scalar()
    tp = _turn_pairs(t)
    both = tp.select("a", "b").unionByName(tp.select(F.col("b").alias("a"), F.col("a").alias("b")))
    h = materialize(ppm.cross_entropy(docs.withColumnRenamed("doc", "a"),
                                      docs.withColumnRenamed("doc", "b"), both, v,
                                      order=PPM_ORDER))
    ab = h.select("a", "b", F.col("h").alias("h_ab"))
    ba = h.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("h").alias("h_ba"))
    return (tp.join(ab, ["a", "b"]).join(ba, ["a", "b"])
            .select("conv_id", "turn_a", "turn_b", F.round("h_ab", 4).alias("h_ab"),
                    F.round("h_ba", 4).alias("h_ba"), "is_pair"))


# ---------------------------------------------------------------------------
# Step 8: imposters
# ---------------------------------------------------------------------------

IMP_ITERATIONS = 100


def _held_out(spark, sf_dir):
    """(doc_id, author, split): 10% of each author's texts are held out."""
    ids = _author_rows(spark, sf_dir)
    return splits.holdout_split(ids, "author", "doc_id", 0.1, SEED).select("doc_id", "author", "split")


def imposter_docs(spark, sf_dir):
    """(texts, candidates): held-out texts are tests, the others train: candidates for their
    own author, impostors for the rest.  Every author of two or more of these is verified."""
    docs, fc, top = _mfw_counts(spark, sf_dir)
    index = top.select(F.col("token").alias("feature"), F.col("rank").alias("idx"))
    vec = features.dense_vectors(fc.select("doc_id", F.col("token").alias("feature"),
                                           F.col("n").cast("double").alias("value")),
                                 _doc_ids(docs), index)
    held = materialize(_held_out(spark, sf_dir))
    role = F.when(F.col("split") == "holdout", "test").otherwise("train")
    d = held.join(vec, "doc_id").select("doc_id", "author", role.alias("role"), "vec")
    cands = (held.filter("split = 'train'").groupBy("author").agg(F.count(F.lit(1)).alias("n"))
             .filter("n >= 2").select("author"))
    return d, cands


@query
def imposters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imposters tally of all authors over 100 iterations (impostor and feature ratio 0.5)."""
    d, cands = imposter_docs(spark, sf_dir)
    t = imp_op.imposters(d, cands, IMP_ITERATIONS, 0.5, 0.5, SEED)
    return t.select("Text", "Candidate", "Proposal", "Proposed", "Total-Iterations",
                    round6(F.col("Percent")).alias("Percent"))


# ---------------------------------------------------------------------------
# Step 9: attribution, linear models, encoders
# ---------------------------------------------------------------------------


def _nearest_predictions(spark, sf_dir):
    """Each held-out text takes the author of its nearest training text
    (city-block on the normalised matrix, rounded to 9 places; ties -> lower id)."""
    vec, _, docs = normalised_vectors(spark, sf_dir)
    split = splits.holdout_split(docs.select("doc_id", "author"), "author", "doc_id", 0.1, SEED)
    v = materialize(vec.join(split.select("doc_id", "split"), "doc_id"))
    nn = pairs.nearest(v.filter(F.col("split") == "holdout"), v.filter(F.col("split") == "train"),
                       "doc_id", "vec")
    a = docs.select(F.col("doc_id").alias("q"), F.col("author").alias("truth"))
    b = docs.select(F.col("doc_id").alias("r"), F.col("author").alias("prediction"))
    return nn.join(a, "q").join(b, "r").select(F.col("q").alias("doc_id"), "truth", "prediction",
                                               F.col("r").alias("nearest"), "distance")


@query
def nearest_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-NN attribution of held-out texts."""
    p = _nearest_predictions(spark, sf_dir)
    return p.select("doc_id", "truth", "prediction", "nearest", round6(F.col("distance"))
                    .alias("distance"))


@query
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of the 1-NN attribution (long form)."""
    return classify.confusion(_nearest_predictions(spark, sf_dir))


@query
def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-author precision, recall, F1 and support of the 1-NN attribution."""
    s = classify.class_scores(_nearest_predictions(spark, sf_dir))
    return s.select("cls", *[round6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")],
                    "support")


def _tomek(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    nn = pairs.nearest(e, e, "vec_id", "embedding", 1, "euclidean", True, digits=6)
    return classify.tomek_links(nn, e.select("vec_id", "label"))


@query
def tomek_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mutual nearest vectors with different labels."""
    return _tomek(spark, sf_dir)


@query
def tomek_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the vectors that stay when the ends of Tomek links go, but for the minority class."""
    e = _embeddings(spark, sf_dir).select("vec_id", "label")
    return classify.without_links(e, _tomek(spark, sf_dir), "vec_id")


ENCODER_MIN_FREQ = 5


@query
def encode_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as id sequences (<UNK> 0, <PAD> 1, then by frequency)."""
    t = _turns(spark, sf_dir)
    toks = t.select("conv_id", "turn", F.posexplode(T.words(F.col("text"))).alias("pos", "token"))
    v = encode.build_vocabulary(toks, ENCODER_MIN_FREQ)
    e = t.select("conv_id", "turn").join(encode.encode(toks, v, ["conv_id", "turn"]),
                                         ["conv_id", "turn"], "left")
    e = e.withColumn("ids", F.coalesce("ids", F.array().cast("array<bigint>")))  # no words
    return e.select("conv_id", "turn", F.size("ids").cast("bigint").alias("n_tokens"),
                    F.size(F.filter("ids", lambda x: x == 0)).cast("bigint").alias("n_unk"),
                    F.array_join("ids", " ").alias("ids"))


@query
def encode_bilevel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as turns x words of ids, both padded to the longest."""
    t = _turns(spark, sf_dir)
    words = F.posexplode_outer(T.words(F.col("text"))).alias("pos", "token")
    toks = materialize(t.select("conv_id", "turn", words))
    v = encode.build_vocabulary(toks.filter("token is not null"), ENCODER_MIN_FREQ)
    e = encode.encode_bilevel(toks, v, "conv_id", "turn")
    longest = toks.groupBy("conv_id", "turn").agg(F.count("token").alias("n")).groupBy(
        "conv_id").agg(F.max("n").alias("longest"))
    return e.join(longest, "conv_id").select(
        "conv_id", "n_sentences", "longest",
        F.array_join(F.transform("ids", lambda s: F.array_join(s, " ")), "/").alias("ids"))


SVM_FOLDS = 5
SVM_TOP = 5
N_COMPONENTS = 20


@query
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance explained by the first 20 components of the normalised documents."""
    vec, _, _ = normalised_vectors(spark, sf_dir)
    rows = materialize(vec.select("doc_id", "vec"))
    p = pca.explained(pca.fit_pca(rows, "vec", N_COMPONENTS), rows)
    return p.select("component", round6(F.col("variance")).alias("variance"),
                    round6(F.col("ratio")).alias("ratio"))


@query
def svm_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SVM on 20 components, fitted on the training texts only, predicting the others."""
    d, _ = _svm_rows(spark, sf_dir)
    d = d.select("doc_id", "author", "split", "vec")
    model = pca.fit_pca(d.filter(F.col("split") == "train"), "vec", N_COMPONENTS)
    d = materialize(pca.project(model, d, "vec"))
    svm = linear.fit(d.filter(F.col("split") == "train"), "author")
    p = linear.predict(svm, d.filter(F.col("split") == "holdout"), ["doc_id", "author"])
    return p.select("doc_id", F.col("author").alias("truth"), "prediction",
                    F.round("score", 6).alias("score"))


VERIFY_FOLDS = 5


def _verify_rows(spark, sf_dir):
    return materialize(logistic.fold_chunks(_embeddings(spark, sf_dir), "label", "vec_id",
                                            VERIFY_FOLDS))


@query
def verify_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(same label) of every fold's test pairs: the query vectors of its test
    chunk against its training vectors, by a model fitted on training pairs only."""
    e = _verify_rows(spark, sf_dir)
    w = logistic.fit_folds(_compared(e), e, "vec_id", "embedding", "label", VERIFY_FOLDS)
    p = logistic.score_folds(w, _compared(e), e, "vec_id", "embedding", "label")
    return p.withColumn("p_same", round6(F.col("p_same")))


@query
def verify_fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision and recall of the verification of every vector against all
    others, fold by fold."""
    e = _known(_verify_rows(spark, sf_dir))
    w = logistic.fit_folds(e, e, "vec_id", "embedding", "label", VERIFY_FOLDS)
    t = logistic.count_folds(w, e, e, "vec_id", "embedding", "label")

    def share(a, b):
        return F.when(b > 0, F.round(a / b, 4)).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return t.select("fold", "n", "tp", "fp", "fn", share(F.col("n") - fp - fn, F.col("n"))
                    .alias("accuracy"), share(tp, tp + fp).alias("precision"),
                    share(tp, tp + fn).alias("recall"))


def _svm_rows(spark, sf_dir):
    """Normalised document vectors with author and held-out mark, and the feature index."""
    vec, idx, docs = normalised_vectors(spark, sf_dir)
    split = splits.holdout_split(docs.select("doc_id", "author"), "author", "doc_id", 0.1, SEED)
    return materialize(vec.join(split.select("doc_id", "author", "split"), "doc_id")), idx


@query
def svm_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-vs-rest linear SVM (z-score, L2, balanced weights) trained on
    the training texts, predicting the held-out ones."""
    d, _ = _svm_rows(spark, sf_dir)
    model = linear.fit(d.filter(F.col("split") == "train"), "author")
    p = linear.predict(model, d.filter(F.col("split") == "holdout"), ["doc_id", "author"])
    return p.select("doc_id", F.col("author").alias("truth"), "prediction",
                    F.round("score", 6).alias("score"))


@query
def svm_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SVM fitted, saved as a table, read back and used without training."""
    d, _ = _svm_rows(spark, sf_dir)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/models-{uuid.uuid4().hex}"
    p = models.Attributor(folder, "authors", N_COMPONENTS).fit(
        d.select("doc_id", "author", "split", "vec"), "author")
    return p.select("doc_id", F.col("author").alias("truth"), "prediction",
                    F.round("score", 6).alias("score"))


@query
def svm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class x feature coefficients of the fitted SVM."""
    d, idx = _svm_rows(spark, sf_dir)
    train = d.filter(F.col("split") == "train")
    return linear.weights(linear.fit(train, "author"), train, idx)


@query
def svm_weights_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 lowest and 5 highest coefficients of every class."""
    return linear.weights_top(svm_weights(spark, sf_dir), SVM_TOP)


@query
def svm_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision table of 5 contiguous folds in doc_id order."""
    d, _ = _svm_rows(spark, sf_dir)
    t = linear.cross_validate(d, "doc_id", "author", SVM_FOLDS)
    return t.withColumn("Score", F.round("Score", 6))


@query
def fold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro averages per fold of the 1-NN attribution (fold: doc_id
    modulo 5 of the held-out texts)."""
    p = _nearest_predictions(spark, sf_dir)
    t = p.select((F.col("doc_id") % SVM_FOLDS).alias("fold"), F.col("truth").alias("Truth"),
                 F.col("prediction").alias("Prediction"),
                 (F.col("truth") == F.col("prediction")).alias("Correct"))
    return linear.fold_scores(t).select(
        "fold", *[round6(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query
def smote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vectors grown by SMOTE to the largest class; sums of the vectors."""
    g = resample.smote(_embeddings(spark, sf_dir), "vec_id", "label", "embedding", seed=SEED)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return g.select("vec_id", F.col("copy").cast("bigint").alias("copy"), "label",
                    F.round(total, 5).alias("total"))


@query
def smote_tomek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE, then the ends of Tomek links go; what stays per class."""
    g = resample.smote_tomek(_embeddings(spark, sf_dir), "vec_id", "label", "embedding", seed=SEED)
    return g.groupBy("label").agg(F.count(F.lit(1)).alias("n"),
                                  F.count_if(F.col("copy") > 0).alias("n_new"))


@query
def verify_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic regression on the two cross-entropies -> P(same role)."""
    ce = materialize(cross_entropy(spark, sf_dir))
    m = classify.fit_pair_logistic(ce, ["h_ab", "h_ba"])
    return classify.predict_pair_logistic(m, ce, ["h_ab", "h_ba"]).select(
        "conv_id", "turn_a", "turn_b", "is_pair", "p_same")


@query
def merge_minus_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-out role models (role total minus the turn), per turn and
    context length: how many (context, char) entries and characters remain.

    Computed without materialising a model per turn: remaining characters are
    role totals minus the turn's, and an entry vanishes exactly when one turn
    alone has it.  Turns' grams are counted by (role, ctx, ch) before they move."""
    t = _turns(spark, sf_dir)
    turns = materialize(ppm.doc_texts(t.select("doc", "text"), "doc", "text").join(
        t.select("doc", "role"), "doc"))
    grams = ppm.char_model(turns, "doc", order=PPM_ORDER, carry=["role"]).withColumn(
        "k", F.length("ctx").cast("bigint"))
    role = materialize(grams.groupBy("role", "ctx", "ch", "k").agg(
        F.sum("n").alias("n_role"), F.count(F.lit(1)).alias("turns"), F.min("doc").alias("doc")))
    role_tot = role.groupBy("role", "k").agg(F.count(F.lit(1)).alias("role_grams"),
                                             F.sum("n_role").alias("role_chars"))
    chars = F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(
        F.length(x) - F.col("k"), F.lit(0).cast("bigint")))
    lengths = F.sequence(*[F.lit(k).cast("bigint") for k in (0, PPM_ORDER)])
    doc_tot = (turns.withColumn("k", F.explode(lengths))
               .select("doc", "role", "k", chars.alias("c")).filter("c > 0")
               .groupBy("doc", "role", "k").agg(F.sum("c").alias("doc_chars")))
    gone = (role.filter(F.col("role").isNotNull() & (F.col("turns") == 1)).groupBy("doc", "k")
            .agg(F.count(F.lit(1)).alias("gone")))
    return (doc_tot.join(role_tot, ["role", "k"]).join(gone, ["doc", "k"], "left")
            .select("doc", "k",
                    (F.col("role_grams") - F.coalesce("gone", F.lit(0))).alias("loo_grams"),
                    (F.col("role_chars") - F.col("doc_chars")).cast("bigint").alias("loo_chars")))


@query
def pair_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(same label) from a logistic layer on |a - b| of unit vectors,
    trained on pairs with a training comparator, scored on those with a held-out one."""
    e = _embeddings(spark, sf_dir)
    ids, vecs = e.select("vec_id", "label"), e.select("vec_id", "embedding")
    split = splits.holdout_split(ids, "label", "vec_id", 0.1, SEED).select(
        "vec_id", (F.col("split") == "holdout").alias("held"))
    left = materialize(_compared(ids).join(vecs, "vec_id"))
    right = materialize(ids.join(split, "vec_id").join(vecs, "vec_id"))
    p = logistic.held_out_pairs(left, right, "vec_id", "embedding", "label")
    return p.select("left_id", "right_id", "is_pair", F.round("p_same", 3).alias("p_same"))


@query
def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-number summary of text length (words) per author, whole table."""
    d = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("author"), T.word_count(F.col("text")).alias("n_words"))
    s = metrics.group_percentiles(d, "author", "n_words", tie="doc_id")
    return s.select("author", "percentile", round6(F.col("value")).alias("value"))


N_ETA2_TOP = 3


@query
def eta2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised values of the 3 features with the largest eta2, per
    document, with the document's author."""
    vec, idx, docs = normalised_vectors(spark, sf_dir)
    long = materialize(features.vectors_to_long(vec, idx))
    cls = docs.select("doc_id", F.col("author").alias("cls"))
    top = clusters.top_eta2(clusters.eta2(long, cls), N_ETA2_TOP)
    out = clusters.eta2_to_classes(long, cls, top)
    return out.select("doc_id", F.col("cls").alias("author"), "feature",
                      round6(F.col("value")).alias("value"))


N_FEATURE_GROUPS = 3


@query
def feature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised features agglomerated into 3 groups (Ward), pooled by mean."""
    vec, idx, _ = normalised_vectors(spark, sf_dir)
    pooled, _ = linkage.feature_agglomeration(materialize(vec), idx, N_FEATURE_GROUPS)
    return pooled.select("doc_id", "group", round6(F.col("value")).alias("value"))


# ---------------------------------------------------------------------------
# Step 10: filters and feature-table selections
# ---------------------------------------------------------------------------

# Fixed values of the stand-in rules, on titles (a document's first line).
TITLE_NEEDLES = ("idiot", "scum", "loser", "copyright", "licensed")
TITLE_SUFFIXES = (" et", " and", " und")
TITLE_PATTERN = "the |Der |qu|[0-9]"
BLOCKED_GROUPS = ("src1", "src2", "src13")


def _titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id", "source", F.split("text", "\n")[0].alias("title"))


@query
def author_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring and suffix rules on every title."""
    return _titles(spark, sf_dir).select("doc_id", filters.any_substring(
        F.col("title"), TITLE_NEEDLES, TITLE_SUFFIXES).alias("blocked"))


@query
def author_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations and `` et`` removed from every title."""
    return _titles(spark, sf_dir).select(
        "doc_id", filters.clean_author(F.col("title")).alias("author"))


@query
def filtered_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 + B5: documents outside the blocked groups whose title doesn't match a pattern."""
    t = _titles(spark, sf_dir)
    return t.filter(~F.col("source").isin(*BLOCKED_GROUPS)
                    & ~F.col("title").rlike(TITLE_PATTERN)).select("doc_id", "title")


@query
def reject_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the kept documents and the first reason of the others."""
    t = _titles(spark, sf_dir)
    reason = filters.reject_reason([
        ("group", F.col("source").isin(*BLOCKED_GROUPS)),
        ("author", filters.any_substring(F.col("title"), TITLE_NEEDLES, TITLE_SUFFIXES)),
        ("title", F.col("title").rlike(TITLE_PATTERN))])
    return (t.select("source", reason.alias("reason")).groupBy("source", "reason")
            .agg(F.count(F.lit(1)).alias("n_docs")))


@query
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NFKC and white-space clean-up of every text; length and MD5 of the result."""
    d = table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("t"))
    return d.select("doc_id", F.length("t").cast("bigint").alias("n_chars"), F.md5(
        F.col("t").cast("binary")).alias("digest"))


@query
def cased_function_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function words of every text by the elision rule, case kept."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(
        T.plain_words(F.col("text"))).alias("token"))
    return (d.filter(F.col("token").isin(*T.FUNCTION_WORDS)).groupBy("doc_id", "token")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def tag_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of a text's words 10 to 60 as one string."""
    d = bind(_all_docs(spark, sf_dir), ["doc_id"], words=T.words(F.col("text")))
    return bind(d, ["doc_id"], tags=_tag_array()).select(
        "doc_id", T.tag_string(F.col("tags"), 10, 60).alias("tags"))


@query
def complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author counts of the words that every author has."""
    authors, counts = _profiles(spark, sf_dir)
    return filters.complete_features(counts, authors, value="n")


@query
def family_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample shares of the word family alone."""
    return filters.by_family(sample_shares(spark, sf_dir), select=("$MFW$",))


@query
def family_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ordered feature list of the sample shares changes family."""
    idx = features.feature_index(sample_shares(spark, sf_dir))
    return filters.first_family_change(idx).select(F.col("change").cast("bigint").alias("change"))


@query
def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E23 + B11: counts of function words as columns, and back to rows."""
    fw = function_words(spark, sf_dir).withColumn("value", F.col("n").cast("double"))
    wide = features.wide(fw, list(T.FUNCTION_WORDS))
    return filters.unpivot_features(wide, ["doc_id"])


@query
def status_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B13 + B14: exactly half of the impostors; the first author is the candidate."""
    d = _held_out(spark, sf_dir)
    first = d.select(F.min("author")).scalar()
    d = d.withColumn("role", F.when(F.col("split") == "holdout", "test")
                     .when(F.col("author") == first, "candidate").otherwise("impostor"))
    filters.check_status(d, "role")
    return filters.status_subset(d, "impostor", "doc_id", "role", 0.5, SEED).select(
        "doc_id", "author")


KNOWN_CLASSES = tuple(range(7))


@query
def ood_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair table with classes beyond the known ones out of domain."""
    p = unit_pairs(spark, sf_dir)
    p = p.withColumns({c: filters.encode_class(F.col(c), KNOWN_CLASSES)
                       for c in ("left_label", "right_label")})
    f = pairs.pairs_frame(p, PAIR_THRESHOLD)
    return f.select("ComparedClass", "ComparedLabel", "ComparatorClass", "ComparatorLabel",
                    "Distance", "IsAPair")


@query
def attribution_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: share of attributed pairs."""
    return filters.attribution_rate(_frame(spark, sf_dir)).select(
        round6(F.col("rate")).alias("rate"), "n")


@query
def row_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every document's place in the md5 order."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    d = d.withColumn("h", hash_key(SEED, "doc_id"))
    return ranking.global_rank(d, ["h", "doc_id"], "place").select("doc_id", "place")
