"""Toxicity from the nearest labelled examples.

Texts and labelled examples are TF-IDF vectors over all their terms.  One
block-max inverted index gives every text its exact nearest examples by cosine;
they are the evidence.  They vote twice: by their cosine, and by the greatest
part that a single shared rare term has in it, which tells one telling term from
many common ones.  A logistic curve fitted on left-out examples turns
the two votes into a score.

The classifier (examples, curve) is fitted on at most EXAMPLES labelled rows
with at most EXAMPLE_CHARS characters; document frequencies are counted over all
documents, those of terms that no example holds included: these belong to a
text's length.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handprint.llm.common import extended, narrowed, pinned, sliced

#: Bounds of the fit: labelled rows, and their characters.
EXAMPLES = 8192
EXAMPLE_CHARS = 64_000_000
NEIGHBOURS = 128
BLOCK = 64
#: A term is frequent if more than one example in so many holds it, and rare (its
#: part counts in the second vote) if at most one in so many does.
FREQUENT, RARE = 8, 16
#: Votes for the overall rate, in sums of cosines and of greatest parts.
PRIOR, PART_PRIOR = 1.0, 0.02
#: Evidence kept for a document.
SHOWN = 5
#: Texts whose cosines are computed at a time, and words whose terms a task remembers.
TOGETHER = 64
WORDS = 200_000
#: No place and no hash (these are below 0).
NO_TERM = (1 << 63) - 1

_TOKEN = re.compile(r"\w+")
_PREFIXES = (4, 5)


def terms(text: str | None) -> Counter:
    """Lower-case words and their prefixes of 4 and 5 letters (marked ``*``)."""
    words = Counter(_TOKEN.findall((text or "").lower()))
    out = Counter(words)
    for word, n in words.items():
        for length in _PREFIXES:
            if len(word) >= length:
                out[word[:length] + "*"] += n
    return out


def fixed(weight: np.ndarray) -> np.ndarray:
    """The nearest whole multiples of 2 ** -24, which 32 bits hold exactly."""
    return np.rint(weight * 2.0 ** 24) * 2.0 ** -24


def similar_order(rows: np.ndarray, groups: int = 32, rounds: int = 3) -> np.ndarray:
    """Order in which similar rows stand together (a few rounds of spherical k-means)."""
    n = len(rows)
    if n <= groups or not rows.shape[1]:
        return np.arange(n)
    rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    centres = rows[np.linspace(0, n - 1, groups).astype(int)]
    for _ in range(rounds):
        near = rows @ centres.T
        of = near.argmax(axis=1)
        centres = np.stack([rows[of == g].sum(axis=0) if (of == g).any() else centres[g]
                            for g in range(groups)])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return np.lexsort((-near[np.arange(n), of], of))


class BlockMaxIndex:
    """Inverted index of example vectors (unit length), in blocks of similar examples.

    Frequent terms (held by more than one example in FREQUENT) are kept as a
    matrix for each block, with each term's greatest weight in the block; rare
    ones as postings.  A text's postings are added up first; with the block
    maxima of its frequent terms they bound the cosines of a block.  Blocks are
    visited by their bound, for many texts at a time, until no bound reaches a
    text's k-th best.  Sums of 32 bits choose the candidates, with room for their
    rounding.  Weights are whole multiples of 2 ** -24, so the candidates' sums of
    products (of 64 bits) are exact in any order; cosines are those of the rounded
    vectors, within 1e-7 of the unrounded ones.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        self.n = len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0)]).astype(np.int64)
        held = np.bincount(term, minlength=n_terms)
        del term
        hot = np.flatnonzero(held > max(BLOCK, self.n // FREQUENT))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[hot] = np.arange(len(hot))
        dense = np.zeros((self.blocks * BLOCK, len(hot)), np.float32)
        for i, (t, w) in enumerate(vectors):
            of_hot = self.column[t] >= 0
            dense[i, self.column[t[of_hot]]] = fixed(w[of_hot])
        #: Example at each place; places behind the last example are empty.
        self.order = similar_order(dense[:self.n])
        self.place_of = np.argsort(self.order)
        dense[:self.n] = dense[self.order]
        self.matrix = dense
        self.greatest = np.ascontiguousarray(
            dense.reshape(self.blocks, BLOCK, len(hot)).max(axis=1).T)
        # Twice the error that a sum in 32 bits can have.
        self.rounding = 2e-7 * (len(hot) + 4)
        rare = [(t[c], w[c]) for t, w in (vectors[v] for v in self.order)
                for c in [self.column[t] < 0]]
        term = np.concatenate([t for t, _ in rare] or [np.zeros(0)]).astype(np.int32)
        by = np.argsort(term, kind="stable")
        place = np.repeat(np.arange(self.n), [len(t) for t, _ in rare])
        # (place, weight) side by side, so that a term's postings are one copy.
        self.postings = np.empty((len(by), 2), np.float32)
        self.postings[:, 0] = place[by]
        part = fixed(np.concatenate([w for _, w in rare] or [np.zeros(0)]))
        self.postings[:, 1] = part[by]
        #: Length of each example's rounded vector, by place.
        self.length = np.array([np.sqrt(np.sum(fixed(vectors[v][1]) ** 2)) for v in self.order])
        self.rare = held <= max(BLOCK, self.n // RARE)
        held[hot] = 0
        self.start = np.cumsum(np.r_[0, held])
        self.visited = 0

    def nearest(self, asked: list[tuple[np.ndarray, np.ndarray]], k: int,
                skip: int | list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each unit vector (term, weight): its k nearest examples, best first.

        Gives (example, cosine, greatest part that one rare term has in it).  Examples
        share a term with the vector; ties go to the smaller example.  With
        ``skip``, vector i leaves out example skip + i, or skip[i] of a list.
        """
        if isinstance(skip, int):
            skip = range(skip, skip + len(asked))
        for begin in range(0, len(asked), TOGETHER):
            yield from self.batch(asked[begin:begin + TOGETHER], k,
                                  None if skip is None else skip[begin:begin + TOGETHER])

    def batch(self, asked, k: int, skip):
        places = self.blocks * BLOCK
        dense = np.zeros((len(asked), len(self.greatest)))
        rare = np.zeros((len(asked), places))
        kept = []
        for i, (term, weight) in enumerate(asked):
            weight = fixed(weight)
            length = np.sqrt(np.sum(weight * weight))
            column = self.column[term]
            hot = column >= 0
            dense[i, column[hot]] = weight[hot]
            place, part = np.zeros(0, np.intp), np.zeros(0)
            held = np.flatnonzero(self.start[term] < self.start[term + 1])
            held = held[np.argsort(self.rare[term[held]], kind="stable")]  # rare ones last
            if len(held):
                ranges = [slice(a, b) for a, b in zip(self.start[term[held]].tolist(),
                                                      self.start[term[held] + 1].tolist(),
                                                      strict=True)]
                found = np.concatenate([self.postings[r] for r in ranges])
                place = found[:, 0].astype(np.intp)
                part = found[:, 1] * np.repeat(weight[held], [r.stop - r.start for r in ranges])
                rare[i] = np.bincount(place, part, places)
                common = sum(r.stop - r.start for r, t in
                             zip(ranges, self.rare[term[held]].tolist(), strict=True) if not t)
                place, part = place[common:], part[common:]
            kept.append((place, part, length))
            if skip is not None:
                rare[i, self.place_of[skip[i]]] = -9
        about, least = self.cosines(dense.astype(np.float32), rare.astype(np.float32), k)
        for i, (place, part, length) in enumerate(kept):
            found = np.flatnonzero((about[i] > 0) & (about[i] >= least[i]))
            cosine = self.matrix[found].astype(float) @ dense[i] + rare[i, found]
            best = np.lexsort((self.order[found], -cosine))[:k]
            found, cosine = found[best], cosine[best]
            greatest = np.zeros(places)
            near = np.zeros(places, bool)
            near[found] = True
            own = near[place]
            np.maximum.at(greatest, place[own], part[own])
            found, cosine = found[cosine > 0], cosine[cosine > 0]
            yield (self.order[found], cosine / (length * self.length[found]), greatest[found])

    def cosines(self, dense: np.ndarray, rare: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosines by text and place, up to rounding (-1 in blocks that were not
        visited), and what each text's k-th best has at least."""
        texts, places = len(dense), self.blocks * BLOCK
        rare = rare.reshape(texts, self.blocks, BLOCK)
        bound = dense @ self.greatest + rare.max(axis=2) + self.rounding
        order = np.argsort(-bound, axis=1, kind="stable")
        about = np.full(rare.shape, -1, np.float32)
        least = np.zeros(texts, np.float32)
        done, step = 0, max(-(-k // BLOCK), self.blocks // 8, 1)
        while done < self.blocks:
            # The next blocks of every text whose bound may still reach its k-th best.
            ahead = order[:, done:done + step]
            row, at = np.nonzero(np.take_along_axis(bound, ahead, 1) >= least[:, None])
            if not len(row):
                break
            block = ahead[row, at]
            by = np.argsort(block, kind="stable")
            row, block = row[by], block[by]
            self.visited += len(row)
            cuts = np.flatnonzero(np.diff(block)) + 1
            for rows, b in zip(np.split(row, cuts), block[np.r_[0, cuts]], strict=True):
                own = self.matrix[b * BLOCK:(b + 1) * BLOCK]
                about[rows, b] = dense[rows] @ own.T + rare[rows, b]
            if k < places:
                kth = np.partition(about.reshape(texts, -1), places - k, axis=1)[:, places - k]
                least = np.maximum(0, kth - 2 * self.rounding)
            done, step = done + step, 2 * step
        return about.reshape(texts, -1), least


class ToxicityModel:
    """Examples with all their terms and weights; bounded by EXAMPLES and EXAMPLE_CHARS.

    The driver holds what the index is made of; the index, many times that, is made by
    every worker that reads the model.
    """

    def __init__(self, frequency: np.ndarray, n_docs: int, terms: list[bytes],
                 counts: list[np.ndarray], labels: np.ndarray):
        self.labels = labels.astype(float)
        self.rate = float(self.labels.mean()) if len(labels) else 0.0
        self.made_of = frequency, n_docs, terms, counts

    def build(self) -> None:
        frequency, n_docs, terms, counts = self.made_of
        self.weight = np.log((1 + n_docs) / (1 + frequency)) + 1
        vectors = [self.vector(unpacked(t), n)[:2] for t, n in zip(terms, counts, strict=True)]
        self.index = BlockMaxIndex(vectors, len(frequency))

    def __getstate__(self):
        kept = {k: getattr(self, k) for k in ("labels", "rate", "made_of")}
        return zlib.compress(pickle.dumps(kept), 1)

    def __setstate__(self, state):
        self.__dict__.update(pickle.loads(zlib.decompress(state)))
        self.build()
        del self.made_of

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(term, weight, squared length before it was made 1)."""
        weight = (1 + np.log(count)) * self.weight[term]
        square = float(np.sum(weight * weight))
        return term, weight / np.sqrt(square) if len(term) else weight, square

    def sums(self, examples: np.ndarray, cosine: np.ndarray,
             greatest: np.ndarray) -> tuple[float, float, float, float]:
        """Cosines to examples of label 1 and to all; greatest parts likewise."""
        ones = self.labels[examples]
        return (float(np.sum(cosine * ones)), float(np.sum(cosine)),
                float(np.sum(greatest * ones)), float(np.sum(greatest)))

    def votes(self, ones, every, part_ones, part_every) -> tuple:
        """Weighted shares of label 1, drawn a little to the overall rate."""
        return ((ones + self.rate * PRIOR) / (every + PRIOR),
                (part_ones + self.rate * PART_PRIOR) / (part_every + PART_PRIOR))


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> tuple[float, ...]:
    """Logistic curve of label on votes by Newton steps, with a weak prior; (offset, slopes)."""
    if not len(votes):
        return -4.0, 8.0, 0.0
    x = np.c_[np.ones(len(votes)), votes]
    beta = np.zeros(x.shape[1])
    prior = 1e-3 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + prior,
                               x.T @ (labels - p) - prior @ beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(b) for b in beta)


def left_out_votes(sample: DataFrame, shared) -> np.ndarray:
    """Votes for each example, itself left out, in the order of ``place``.

    ``sample``: (place, terms, counts); two numbers for each example meet at the driver.
    """
    def run(batches):
        model, _ = shared.value
        for batch in sliced(batches):
            vectors = [model.vector(unpacked(t), n)[:2] for t, n in
                       zip(batch.column("terms").to_pylist(), _arrays(batch.column("counts")),
                           strict=True)]
            found = [model.votes(*model.sums(*near)) for near in model.index.nearest(
                vectors, NEIGHBOURS, batch.column("place").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("place"), *[pa.array([v[i] for v in found], pa.float64())
                                          for i in range(2)]], names=["place", "a", "b"])
    found = (sample.select("place", "terms", "counts")
             .mapInArrow(run, "place int, a double, b double").orderBy("place").toArrow())
    return np.c_[found.column("a").to_numpy(), found.column("b").to_numpy()]


def coder(place: dict[str, int]):
    """text -> (codes, counts) of :func:`terms`, ascending: places, and hashes below 0 for others."""
    known: dict[str, int] = {}  # word -> its row of the table
    table = np.empty((WORDS, 1 + len(_PREFIXES)), np.int64)

    def code(term: str) -> int:
        at = place.get(term)
        return (xxhash.xxh64_intdigest(term) >> 1) - (1 << 63) if at is None else at

    def run(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        nonlocal table
        words = Counter(_TOKEN.findall((text or "").lower()))
        if len(known) + len(words) > len(table):
            known.clear()
            if len(words) > len(table):
                table = np.empty((len(words), table.shape[1]), np.int64)
        rows = list(map(known.get, words))
        if None in rows:
            for i, word in enumerate(words):
                if rows[i] is None:
                    rows[i] = known[word] = len(known)
                    table[rows[i]] = [code(word), *(
                        code(word[:k] + "*") if len(word) >= k else NO_TERM for k in _PREFIXES)]
        flat = table[np.array(rows, np.int64)].ravel()
        times = np.repeat(np.fromiter(words.values(), np.int64, len(words)), table.shape[1])
        real = flat != NO_TERM
        order = np.argsort(flat[real])
        flat, times = flat[real][order], times[real][order]
        first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else order
        return flat[first], np.add.reduceat(times, first) if len(flat) else times
    return run


def packed(codes: np.ndarray) -> bytes:
    """Differences of ascending places, as four planes of bytes: mostly zeros, which compress."""
    return np.diff(codes, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(held: bytes) -> np.ndarray:
    planes = np.frombuffer(held, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int32)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    bounds = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = pa.array(np.concatenate(parts) if parts else np.zeros(0)).cast(kind)
    return pa.ListArray.from_arrays(pa.array(bounds), flat)


def _arrays(column: pa.Array) -> list[np.ndarray]:
    bounds = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _counted(docs: DataFrame, shared) -> DataFrame:
    """Columns of ``docs`` but text, and its terms.

    ``terms`` (:func:`packed`), ``counts``: places in the vocabulary, ascending;
    ``rest``, ``rest_counts``: hashes of terms outside of it.
    """
    schema = extended(docs.drop("text"), "terms binary, counts array<int>, "
                                         "rest array<bigint>, rest_counts array<int>")

    def run(batches):
        coded = coder(places_of(shared.value))
        for batch in sliced(batches):
            made = [coded(t) for t in batch.column("text").to_pylist()]
            cut = [int(np.searchsorted(c, 0)) for c, _ in made]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c != "text"]
                + [pa.array([packed(c[k:]) for (c, _), k in zip(made, cut)], pa.binary()),
                   _lists([n[k:] for (_, n), k in zip(made, cut)], pa.int32()),
                   _lists([c[:k] for (c, _), k in zip(made, cut)], pa.int64()),
                   _lists([n[:k] for (_, n), k in zip(made, cut)], pa.int32())],
                names=schema.names)
    return docs.mapInArrow(run, schema)


def vocabulary_of(sample: DataFrame) -> tuple[bytes, int]:
    """All terms of (text), those that most texts hold first (see :func:`places_of`), and
    their number."""
    def run(batches):
        for batch in sliced(batches):
            held = Counter(t for x in batch.column("text").to_pylist() for t in terms(x))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                names=["term", "n"])
    found = (sample.select("text").mapInArrow(run, "term string, n bigint").groupBy("term")
             .agg(F.sum("n").alias("n")).toArrow())
    ranked = found.sort_by([("n", "descending"), ("term", "ascending")]).column("term")
    # The driver makes no Python string for each term.
    every = pa.ListArray.from_arrays(pa.array([0, len(ranked)], pa.int32()),
                                     pa.concat_arrays([pa.array([], ranked.type), *ranked.chunks]))
    return zlib.compress(pc.binary_join(every, "\n")[0].as_buffer(), 1), len(ranked)


def places_of(vocabulary: bytes) -> dict[str, int]:
    ranked = zlib.decompress(vocabulary).decode()
    return {t: i for i, t in enumerate(ranked.split("\n"))} if ranked else {}


def document_frequency(counted: DataFrame, n_terms: int) -> np.ndarray:
    """Documents of (terms) that hold each term."""
    def run(batches):
        held = np.zeros(n_terms, np.int64)
        for batch in batches:
            for part in sliced([batch]):
                every = [unpacked(t) for t in part.column("terms").to_pylist()]
                held += np.bincount(np.concatenate([np.zeros(0, np.int32), *every]),
                                    minlength=n_terms)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], names=["term", "n"])
    out = np.zeros(n_terms)
    found = counted.select("terms").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(
        F.sum("n").alias("n")).toArrow()  # one row for each term of the vocabulary at most
    out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


def rest_squares(counted: DataFrame, n_docs: int) -> DataFrame:
    """(of, square): squared length, times 2 ** 32, of what lies outside the vocabulary.

    Whole numbers, so that the order of the sum doesn't matter.
    """
    cells = counted.select("row", F.explode(F.arrays_zip("rest", "rest_counts")).alias("c")).select(
        "row", F.col("c.rest").alias("term"), F.col("c.rest_counts").alias("n"))
    held = cells.groupBy(F.col("term").alias("t")).agg(F.count(F.lit(1)).alias("df"))
    weight = (1 + F.log("n")) * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)
    return (cells.join(held, cells["term"] == held["t"])
            .groupBy(F.col("row").alias("of"))
            .agg(F.sum(F.round(weight * weight * 2.0 ** 32).cast("bigint")).alias("square")))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """One row per document: id, score, predicted, evidence, similarity.

    ``labels``: id and label (0 or 1; null labels and ids say nothing).  At most
    ``examples`` labelled rows are learnt from, those of least MD5 of their id, up
    to EXAMPLE_CHARS characters; equal texts count once.  ``score`` is between 0 and 1, ``predicted`` 1 from
    0.5, ``evidence`` the ids of the nearest examples with their cosines over
    whole texts.  Null and empty texts, and texts without any term of an
    example, have no neighbours and get the curve's value at the overall rate.  Without labels of both kinds
    every text gets the same score.  Repeated rows score alike; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    base = narrowed(docs, id=id_col, text=text_col)
    of = narrowed(labels, of=labels.columns[0], label=labels.columns[1]).where(
        "of is not null and label is not null")
    of = of.groupBy("of").agg(F.max(F.col("label").cast("double")).alias("label"))
    chosen = of.join(base.select(F.col("id").alias("of")).distinct(), "of", "left_semi").orderBy(
        F.md5(F.col("of").cast("string").cast("binary")), "of").limit(examples)
    chosen = pinned(chosen, "examples")
    # At most ``examples`` rows, so this side is small by its bound.
    sample = base.join(F.broadcast(chosen), base["id"] == chosen["of"]).select(
        "id", F.coalesce("text", F.lit("")).alias("text"), "label")
    first = sample.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(
        F.min(F.struct("id", "label", "text")).alias("row"))
    sample = pinned(first.select("sha", "row.*"), "sample")
    so_far = F.sum(F.length("text")).over(Window.orderBy(
        F.md5(F.col("id").cast("string").cast("binary")), "id", "sha"))
    place = F.row_number().over(Window.orderBy("id", "sha")) - 1
    # One task for the sum over at most ``examples`` rows, many again for what follows.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = pinned(sample.withColumn("so_far", so_far).where(F.col("so_far") <= EXAMPLE_CHARS)
                    .drop("so_far").withColumn("place", place).repartition(parts), "sample")
    words, n_terms = vocabulary_of(sample)
    n_terms = max(1, n_terms)
    places = spark.sparkContext.broadcast(words)

    counted = pinned(_counted(base, places).withColumn("row", F.monotonically_increasing_id()),
                     "terms")
    n_docs = counted.count()
    frequency = document_frequency(counted, n_terms)
    sample = pinned(_counted(sample, places), "examples-terms")
    held = sample.orderBy("place").select("id", "label", "terms", "counts").toArrow().combine_chunks()
    shown = held.column("id").combine_chunks()
    model = ToxicityModel(frequency, n_docs, held.column("terms").to_pylist(),
                          _arrays(held.column("counts").combine_chunks()),
                          held.column("label").to_numpy())
    shared = spark.sparkContext.broadcast((model, shown))
    curve = fit_curve(left_out_votes(sample, shared), model.labels)
    kind = counted.schema["id"].dataType.simpleString()
    schema = extended(counted.select("row", "id"),
                      "own double, ones double, every double, part_ones double, "
                      "part_every double, "
                      f"evidence array<{kind}>, similarity array<double>")

    def run(batches):
        model, shown = shared.value
        for batch in sliced(batches):
            asked = list(zip(map(unpacked, batch.column("terms").to_pylist()),
                             _arrays(batch.column("counts")), strict=True))
            vectors = [model.vector(t, n) for t, n in asked]
            near = list(model.index.nearest([(t, w) for t, w, _ in vectors], NEIGHBOURS))
            sums = [model.sums(*x) for x in near]
            best = _lists([x[0][:SHOWN] for x in near], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"),
                 pa.array([v[2] for v in vectors], pa.float64()),
                 *[pa.array([x[i] for x in sums], pa.float64()) for i in range(4)],
                 pa.ListArray.from_arrays(best.offsets, shown.take(best.values)),
                 _lists([x[1][:SHOWN] for x in near], pa.float64())], names=schema.names)

    scored = counted.select("row", "id", "terms", "counts").mapInArrow(run, schema)
    # Terms outside the vocabulary only make the text's vector longer.
    rest = rest_squares(counted, n_docs)
    square = F.coalesce(F.col("square") / F.lit(2.0 ** 32), F.lit(0.0))
    shorter = F.when(F.col("own") > 0, F.sqrt(F.col("own") / (F.col("own") + square))).otherwise(
        F.lit(1.0))
    offset, by_cosine, by_part = curve
    sums = [F.col(c) * F.col("part") for c in ("ones", "every", "part_ones", "part_every")]
    votes = model.votes(*sums)
    return (scored.join(rest, scored["row"] == rest["of"], "left").withColumn("part", shorter)
            .withColumn("score", 1 / (1 + F.exp(-(offset + by_cosine * votes[0]
                                                  + by_part * votes[1]))))
            .select(F.col("id").alias(id_col), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence",
                    F.transform("similarity", lambda c: c * F.col("part")).alias("similarity")))
