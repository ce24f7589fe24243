"""Filter interaction audit: every order of five filters, from one pass over the texts.

A document matters only by which filters it fails, so documents are counted
into cells of (part, failure mask).  Each cell folds across the array of all
orders with higher-order functions: one weighted struct for every order and
step.  The structs of a part's cells are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handprint.functions.arrays import bind
from handprint.llm.common import WORD, narrowed, pinned

FILTERS = "ABCDE"
ORDERS = ["".join(o) for o in permutations(FILTERS)]
#: Fixed values of the filters' conditions.
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_CAPITALS = 5
SYMBOLS = "[#$%&*|]"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(words: Column, text: Column) -> Column:
    """Bits 0 to 3: filters A to D, which judge a text by itself."""
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
    failed = [n < MIN_WORDS, 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * n,
              100 * capitals > MAX_CAPITALS * F.length(text), text.rlike(SYMBOLS)]
    return sum((f.cast("int") * (1 << bit) for bit, f in enumerate(failed)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """(id, part, mask) of (id, text, part); bit 4 is filter E.

    Texts are compared by SHA-256.  Only digests are shuffled; the first ids of
    texts that occur twice or more are written, so that the join is one of two
    scans and Spark can split a text with very many copies.
    """
    base = docs.select("id", F.coalesce("part", F.lit("")).alias("part"),
                       F.coalesce("text", F.lit("")).alias("text"))
    base = bind(base, words=F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    signed = pinned(base.select("id", "part",
                                text_mask(F.col("words"), F.col("text")).alias("alone"),
                                F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")),
                    "audit")
    firsts = pinned(signed.groupBy("sha").agg(F.min("id").alias("first"),
                                              F.count(F.lit(1)).alias("n"))
                    .where("n > 1 and first is not null").select("sha", "first"), "audit-firsts")
    copy = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return signed.join(firsts, "sha", "left").select(
        "id", "part", (F.col("alone") + 16 * copy.cast("int")).alias("mask"))


def cell_steps(mask: Column, n: Column, good: Column, toxic: Column) -> Column:
    """The 600 structs of a cell, order by order and step by step."""
    kinds = ", ".join(f"{c}: bigint" for c in COUNTS)
    orders = F.lit([[FILTERS.index(letter) for letter in order] for order in ORDERS])
    start = F.struct(F.lit(True).alias("alive"),
                     F.array().cast(f"array<struct<{kinds}>>").alias("steps"))

    def step(state: Column, bit: Column) -> Column:
        alive, fails = state["alive"], F.getbit(mask, bit) == 1

        def weighted(when: Column, by: Column) -> Column:
            return F.when(when, by).otherwise(F.lit(0)).cast("bigint")
        found = {"kept": weighted(alive & ~fails, n), "removed": weighted(alive & fails, n),
                 "redundant": weighted(~alive & fails, n),
                 "unique_fails": weighted(fails & (F.bit_count(mask) == 1), n),
                 "good_lost": weighted(alive & fails, good),
                 "toxic_lost": weighted(alive & fails, toxic)}
        row = F.struct(*[found[c].alias(c) for c in COUNTS])
        return F.struct((alive & ~fails).alias("alive"),
                        F.concat(state["steps"], F.array(row)).alias("steps"))
    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step)["steps"]))


def elementwise(cells: Column) -> Column:
    """Sum of the cells' arrays, place by place."""
    def added(a: Column, b: Column) -> Column:
        return F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    return F.reduce(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), cells[0],
                    lambda total, cell: F.zip_with(total, cell, added))


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, filter order and step: counts of documents of the part.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley (the step's filter's ``removed`` summed over
    all orders).  Filters: A under 50 words, B under 65 % distinct words, C over
    5 % capitals, D a symbol, E equal to the text of any smaller id.

    ``labels``: id, quality, toxic; a document is good (toxic) if any of its
    label rows has 1.  A null text is empty, a null part the empty string.  A
    document with a null id has no labels and comes after all ids: it is a copy
    if any row with an id holds its text.  Repeated rows count each; rows of one
    id and text are no copies of each other.  An empty table gives an empty
    result.

    A part has at most 32 cells, so a part's sums are bounded; cells are counted
    before the shuffle, so a hot part sends one row per mask and task.
    """
    masks = failure_masks(narrowed(docs, id=id_col, text=text_col, part=part_col))
    marks = (narrowed(labels, of=labels.columns[0], quality=labels.columns[1],
                      toxic=labels.columns[2]).where("of is not null").groupBy("of")
             .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                  F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    known = masks.join(marks, masks["id"] == marks["of"], "left")
    cells = known.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).cast("bigint").alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).cast("bigint").alias("toxic"))
    steps = cells.select("part", cell_steps(F.col("mask"), F.col("n"), F.col("good"),
                                            F.col("toxic")).alias("steps"))
    parts = bind(steps.groupBy("part").agg(F.collect_list("steps").alias("cells")), ["part"],
                 sums=elementwise(F.col("cells")))
    letters = F.lit([FILTERS.index(letter) for order in ORDERS for letter in order])
    shares = F.transform(F.lit(list(range(len(FILTERS)))), lambda bit: F.reduce(
        F.zip_with("sums", letters, lambda s, at: F.when(at == bit, s["removed"]).otherwise(0)),
        F.lit(0).cast("bigint"), lambda a, b: a + b))
    parts = bind(parts, shares=shares)
    rows = parts.select("part", "shares", F.posexplode("sums").alias("at", "counts"))
    width = len(FILTERS)
    order = F.lit(ORDERS)[F.floor(F.col("at") / width).cast("int")]
    return rows.select(
        "part", order.alias("filter_order"), (F.col("at") % width + 1).cast("int").alias("step"),
        *[F.col("counts")[c].alias(c) for c in COUNTS],
        F.col("shares")[letters[F.col("at")]].alias("shapley"))
