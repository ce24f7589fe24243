"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through the first ``threshold`` bytes, most
significant digit first; suffixes still together after the last digit are
exactly the repeated windows, and of each such group the earliest stays.

A digit is the 64-bit code of a byte string.  Shuffling one row for each suffix
would move many times the corpus, so passes before the last one run on
fewer rows and let go what can't be in a group:

1. Among the grams of ``gram`` bytes inside a window, the one with the least
   code is the window's anchor.  Equal windows have equal anchors at equal
   places.  Neighbouring windows with one anchor form a stretch, about 27
   bytes apart, and the first pass sorts stretches: by anchor, then by the
   bytes of the whole stretch.  A stretch equal to an earlier one repeats
   whole; a stretch alone with its anchor repeats nowhere.
2. Only the windows of what is left (an anchor in different stretches) are
   sorted, by the digits of their first and second half.

Both passes order rows inside shuffle partitions and read them as a stream.
Each batch first drops what it holds twice, so a passage that a third of all
documents share enters the shuffle once for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, ShortType

from handprint.llm.common import narrowed, pinned, row_key, sliced
from handprint.operators.ranking import global_rank

THRESHOLD = 100
GRAM = 48
#: Longest threshold: strings of about twice the length are coded, and up to 1,023 bytes no two
#: of one self-similar family (Thue and Morse's) meet in a code modulo 2 ** 64.
LONGEST = 256
#: Window starts handled at a time.
CHUNK = 1 << 20
_PLACE = np.uint64(CHUNK - 1)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class Codes:
    """64-bit codes of substrings of a byte array of at most CHUNK + reach bytes.

    code(s) = sum of table[byte] * base**offset, modulo 2**64, then mixed; any
    substring's code follows from two prefix sums.
    """

    def __init__(self, reach: int):
        with np.errstate(over="ignore"):
            base = 0x9E3779B97F4A7C15
            inverse = pow(base, -1, 1 << 64)
            n = CHUNK + reach + 1
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)],
                                    dtype=np.uint64)
            self.back = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)],
                                   dtype=np.uint64)
            self.table = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.power[:len(data)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mix((sums[stop] - sums[start]) * self.back[start])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by prefix and suffix minima of blocks."""
    n = len(values)
    full = -(-n // width) * width
    held = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    held[:n] = values
    blocks = held.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def stretches(data: np.ndarray, offsets: np.ndarray, codes: Codes, threshold: int, gram: int):
    """(document index, first window, last window, anchor code, stretch code), as arrays.

    ``data`` holds the documents one after the other, bounded by ``offsets``.
    A chunk border may cut a stretch in two, which costs work, not results.
    """
    found = []
    width = threshold - gram + 1
    step = CHUNK - threshold  # places in a chunk stay below CHUNK
    for begin in range(0, max(0, len(data) - threshold + 1), step):
        part = data[begin:begin + step + threshold - 1]
        n = len(part) - threshold + 1
        inside = np.clip(offsets, begin, begin + n)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(inside))
        valid = np.arange(begin + threshold, begin + threshold + n) <= offsets[owner + 1]
        if not valid.any():
            continue
        sums = codes.sums(part)
        at = np.arange(len(part) - gram + 1, dtype=np.uint64)
        grams = _mix((sums[gram:] - sums[:-gram]) * codes.back[:len(at)])
        # The least code (its high bits), then the leftmost place.
        anchor = (sliding_min((grams & ~_PLACE) | at, width) & _PLACE).astype(np.int64)
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
                    | ~valid[:-1]] & valid
        first = np.flatnonzero(new)
        # A stretch ends before the next one, or before the windows that cross documents.
        breaks = np.flatnonzero(new | ~valid)
        last = np.r_[breaks, n][np.searchsorted(breaks, first, "right")] - 1
        start = begin + first - offsets[owner[first]]
        found.append((owner[first], start, start + last - first, grams[anchor[first]],
                      codes.of(sums, first, last + threshold)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch's texts in a row, and their offsets."""
    text = batch.column("text").cast(pa.large_binary()).fill_null(b"")
    _, bounds, body = text.buffers()
    offsets = np.frombuffer(bounds, np.int64)[text.offset:text.offset + len(text) + 1]
    data = np.frombuffer(body or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def _rows(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns],
                                      names=names)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _runs(doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Union of spans per document: (doc, start, stop) of the maximal runs."""
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if not len(doc):
        return doc, start, stop
    new_doc = _first_of(doc)
    # The furthest stop so far inside the document, by lifting documents apart.
    lift = np.cumsum(new_doc) * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + lift)
    first = np.r_[True, (start + lift)[1:] > reach[:-1]]
    at = np.flatnonzero(first)
    ends = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], (reach - lift)[ends]


#: Kinds of rows in the passes: one to sort; a run of bytes known to repeat; a stretch
#: whose anchor has others; word of such others.
_SORT, _RUN, _SEVERAL, _WITNESS = range(4)


def stretch_pass(docs: DataFrame, threshold: int, gram: int) -> DataFrame:
    """(doc, start, stop, whole): spans that repeat (whole) or whose windows must be sorted.

    For a whole one, [start, stop) are bytes; for the others first and last window.
    A row of the shuffle is four longs: anchor, code, doc, and a place that packs
    start, last - start and kind; a run has its stop as code.
    """
    names = ["anchor", "code", "doc", "place"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(threshold)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                data, offsets = _texts(batch)
                owner, start, last, anchor, code = stretches(data, offsets, codes, threshold, gram)
                if not len(owner):
                    continue
                doc = ids[owner]
                order = np.lexsort((start, doc, code, anchor))
                doc, start, last = doc[order], start[order], last[order]
                anchor, code = anchor[order], code[order]
                fresh = _first_of(anchor, code)
                # What repeats inside the batch, as merged runs.
                d, s, e = _runs(doc[~fresh], start[~fresh], last[~fresh] + threshold)
                yield _rows(_mix(d.view(np.uint64) ^ s.view(np.uint64)).view(np.int64), e, d,
                            s << 18 | _RUN, names=names)
                doc, start, last = doc[fresh], start[fresh], last[fresh]
                anchor, code = anchor[fresh], code[fresh]
                # An anchor in several stretches already: they must be sorted anyway, so
                # they scatter, and a witness tells the anchor's other holders.
                lead = _first_of(anchor)
                several = ~lead
                several[:-1] |= ~lead[1:]
                witness = anchor[lead & several].view(np.int64)
                kind = np.where(several, _SEVERAL, _SORT)
                yield _rows(np.where(several, _mix(anchor ^ code), anchor).view(np.int64),
                            code.view(np.int64), doc, start << 18 | (last - start) << 2 | kind,
                            names=names)
                zero = np.zeros(len(witness), np.int64)
                yield _rows(witness, zero, zero, zero + _WITNESS, names=names)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # anchor and code of the last row but runs
        told = None  # an anchor whose witness has been seen
        for batch in batches:
            anchor, code, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            kind, start = place & 3, place >> 18
            run = kind == _RUN
            out = [(doc[run], start[run], code[run], np.ones(run.sum(), bool))]
            word = anchor[kind == _WITNESS]
            known = np.r_[word, told] if told is not None else word
            told = word[-1] if len(word) else told
            real = ~run & (kind != _WITNESS)
            anchor, code, doc, start = anchor[real], code[real], doc[real], start[real]
            last, kind = start + (place[real] >> 2 & 0xFFFF), kind[real]
            if len(anchor):
                group, stretch = _first_of(anchor), _first_of(anchor, code)
                if before is not None:
                    group[0] = anchor[0] != before[0]
                    stretch[0] = group[0] or code[0] != before[1]
                before = anchor[-1], code[-1]
                # A stretch has company if it isn't its anchor's first, if another follows,
                # if there is word of others, or, for all one knows, at the batch's end.
                lead = np.flatnonzero(stretch)
                company = ~group | (kind == _SEVERAL) | np.isin(anchor, known)
                company[lead[:-1]] |= ~group[lead[1:]]
                company[lead[-1:]] = True
                sort = stretch & company
                out += [(doc[~stretch], start[~stretch], (last + threshold)[~stretch],
                         np.ones((~stretch).sum(), bool)),
                        (doc[sort], start[sort], last[sort], np.zeros(sort.sum(), bool))]
            yield _rows(*(np.concatenate(x) for x in zip(*out, strict=True)),
                        names=["doc", "start", "stop", "whole"])

    rows = docs.mapInArrow(emit, "anchor bigint, code bigint, doc bigint, place bigint")
    # Witnesses come first in their anchor's group.
    rows = rows.repartition("anchor").sortWithinPartitions(
        "anchor", F.expr(f"place <> {_WITNESS}"), "code", "doc", "place")
    return rows.mapInArrow(decide, "doc bigint, start bigint, stop bigint, whole boolean")


def window_pass(held: DataFrame, threshold: int) -> DataFrame:
    """(doc, start, stop): bytes of windows that repeat an earlier one.

    ``held``: doc, text and spans, an array of (start, stop), the first and last
    windows to sort.  A row of the shuffle is four longs: the two digits, doc, and
    a place that packs start and kind; a run has its stop as second digit.
    """
    half = threshold // 2
    names = ["high", "low", "doc", "place"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(threshold)
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column("doc").to_numpy(zero_copy_only=False)
                data, offsets = _texts(batch)
                spans = batch.column("spans")
                bounds = spans.offsets.to_numpy()
                first = spans.values.field("start").to_numpy()[bounds[0]:bounds[-1]]
                final = spans.values.field("stop").to_numpy()[bounds[0]:bounds[-1]]
                owner = np.repeat(np.arange(len(ids)), np.diff(bounds))
                # Every window of every span, by its place in data; each once.
                count = final - first + 1
                at = np.repeat(first + offsets[owner], count) + (
                    np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
                at = np.unique(at)
                owner = np.searchsorted(offsets, at, "right") - 1
                high, low = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
                for begin in range(0, len(data), CHUNK):
                    a, b = np.searchsorted(at, [begin, begin + CHUNK])
                    if a < b:
                        sums = codes.sums(data[begin:begin + CHUNK + threshold])
                        here = at[a:b] - begin
                        high[a:b] = codes.of(sums, here, here + half)
                        low[a:b] = codes.of(sums, here + half, here + threshold)
                doc, start = ids[owner], at - offsets[owner]
                order = np.lexsort((start, doc, low, high))
                doc, start = doc[order], start[order]
                high, low = high[order], low[order]
                fresh = _first_of(high, low)
                d, s, e = _runs(doc[~fresh], start[~fresh], start[~fresh] + threshold)
                yield _rows(_mix(d.view(np.uint64) ^ s.view(np.uint64)).view(np.int64), e, d,
                            s << 2 | _RUN, names=names)
                yield _rows(high[fresh].view(np.int64), low[fresh].view(np.int64), doc[fresh],
                            start[fresh] << 2, names=names)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            high, low, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            run, start = place & 3 == _RUN, place >> 2
            late = np.zeros(len(run), bool)
            window = np.flatnonzero(~run)
            if len(window):
                first = _first_of(high[window], low[window])
                if before is not None:
                    first[0] = (high[window[0]], low[window[0]]) != before
                before = high[window[-1]], low[window[-1]]
                late[window] = ~first
            out = run | late
            yield _rows(*_runs(doc[out], start[out], np.where(run, low, start + threshold)[out]),
                        names=["doc", "start", "stop"])

    rows = held.mapInArrow(emit, "high bigint, low bigint, doc bigint, place bigint")
    rows = rows.repartition("high", "low").sortWithinPartitions("high", "low", "doc", "place")
    return rows.mapInArrow(decide, "doc bigint, start bigint, stop bigint")


def numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text, doc), and documents (doc, text): each number once.

    ``doc`` orders documents by id (nulls last), then row key.  Unique integer
    ids are their own numbers.  Otherwise rows get ranks; rows alike in id and
    text are one document and share a number.
    """
    whole = isinstance(docs.schema["id"].dataType, (ShortType, IntegerType, LongType))
    if whole and not docs.groupBy("id").count().where("count > 1 or id is null").head(1):
        rows = docs.withColumn("doc", F.col("id").cast("bigint"))
        return rows, rows.select("doc", "text")
    keyed = docs.withColumn("row", row_key(F.col("id"), F.col("text")))
    ranks = global_rank(keyed.select("id", "row").distinct(),
                        [F.col("id").asc_nulls_last(), F.col("row")], "doc")
    rows = keyed.join(ranks.select("row", "doc"), "row").select("id", "text", "doc")
    return rows, rows.select("doc", "text").dropDuplicates(["doc"])


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM) -> DataFrame:
    """(doc, spans): byte spans (start, stop) to remove, of (doc, text); see the module.

    A document's number occurs once: a second row of it would repeat the first.
    """
    once = docs.select("doc", "text")
    passed = pinned(stretch_pass(once, threshold, gram), "stretches")
    span = F.collect_list(F.struct("start", "stop")).alias("spans")
    held = once.join(passed.where("not whole").groupBy("doc").agg(span), "doc")
    windows = pinned(window_pass(held, threshold), "windows")
    every = passed.where("whole").select("doc", "start", "stop").unionByName(windows)
    return every.groupBy("doc").agg(span)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: int = THRESHOLD, gram: int = GRAM,
                   texts: bool = False) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes].

    Removes each byte covered by a ``threshold``-byte string that also starts
    earlier: in a document of smaller id (nulls last, then by row key), or in the
    same one.  ``threshold`` is at most LONGEST.  Texts are UTF-8 bytes, null counts as empty; texts shorter than
    the threshold keep all.  Rows alike in id and text are one document, and
    each of them gets its result.  An empty table gives an empty result.
    """
    if not 8 <= gram < threshold <= LONGEST or threshold % 2:
        raise ValueError(f"need 8 <= gram < threshold <= {LONGEST}, threshold even")
    base, once = numbered(narrowed(docs, id=id_col, text=text_col))
    spans = repeated_spans(once, threshold, gram)
    kind = base.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
              + (", kept_bytes binary" if texts else ""))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            size, removed, runs, digest, kept_texts = [], [], [], [], []
            for text, spans in zip(batch.column("text").cast(pa.binary()),
                                   batch.column("spans"), strict=True):
                data = text.as_py() or b""
                if spans.is_valid:
                    start = spans.values.field("start").to_numpy()
                    stop = spans.values.field("stop").to_numpy()
                    _, start, stop = _runs(np.zeros(len(start), np.int64), start, stop)
                    edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(data)]
                    kept = b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2],
                                                               strict=True)])
                else:
                    start, kept = (), data
                size.append(len(data))
                removed.append(len(data) - len(kept))
                runs.append(len(start))
                digest.append(hashlib.sha256(kept).hexdigest())
                if texts:
                    kept_texts.append(kept)
            made = [batch.column("id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(runs, pa.int64()), pa.array(digest, pa.string())]
            if texts:
                made.append(pa.array(kept_texts, pa.binary()))
            yield pa.RecordBatch.from_arrays(made, names=[p.split(" ")[0] for p in schema.split(", ")])

    met = base.join(spans, "doc", "left").select("id", "text", "spans")
    return met.mapInArrow(finish, schema).withColumnRenamed("id", id_col)
