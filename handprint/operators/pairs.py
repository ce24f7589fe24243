"""Pair tables and vector distances.

All unordered pairs of n vectors is quadratic by definition.  It is
computed in blocks: rows are hashed into ceil(n / block_rows) blocks,
each row is replicated to the block pairs (bi <= bj) it belongs to, and
every block pair is one ``applyInPandas`` group holding at most two
blocks, whose distance matrix NumPy computes in chunks.  Task size is
bounded by ``block_rows`` whatever the data, and there is no cross join.

Verification compares a stated set of rows (compared) with a reference set
(comparator): ``compared_pairs`` scores them in the same kind of blocks, and
``pair_counts``, ``nearest`` and ``closest_false`` reduce
inside the block, so what leaves it is counts or a few rows per query row.
``candidate_pairs`` scores a given (left, right) table with two equi-joins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMMETRIC = {"cityblock", "manhattan", "l1", "euclidean", "l2", "sqeuclidean", "cosine"}
ASYMMETRIC = {"snr"}

#: Numbers of a chunk of differences, which stays in a core's cache.
_CHUNK = 1 << 17
#: Numbers of the vectors of a shuffled block.
BLOCK_NUMBERS = 1 << 23
#: Rows and columns of a tile of city-block sums, which stays in a core's cache.
TILE_ROWS, TILE_COLUMNS = 64, 2048
#: Steps of rounded distances whose counts are packed into a row.
PART = 1 << 14


def no_rows(names: list[str]) -> pd.DataFrame:
    """An empty result for any schema."""
    return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})


def _normalise(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def distance_matrix(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Dense |a| x |b| distances in float64, computed in row chunks."""
    out = np.empty((a.shape[0], b.shape[0]), dtype=np.float64)
    if metric == "cosine":
        an, bn = _normalise(a), _normalise(b)
        return 1.0 - an @ bn.T
    if metric == "snr":
        av = ((a - a.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
    rows = max(1, _CHUNK // max(1, b.size))
    for s in range(0, a.shape[0], rows):
        part = slice(s, s + rows)
        d = a[part, None, :] - b[None, :, :]
        if metric in ("cityblock", "manhattan", "l1"):
            out[part] = np.abs(d, out=d).sum(axis=2)
        elif metric in ("euclidean", "l2"):
            out[part] = np.sqrt(np.multiply(d, d, out=d).sum(axis=2))
        elif metric == "sqeuclidean":
            out[part] = np.multiply(d, d, out=d).sum(axis=2)
        elif metric == "snr":
            dc = d - d.mean(axis=2, keepdims=True)
            num = (dc * dc).sum(axis=2)
            # No signal: 0 to an equal vector, else without bound.
            out[part] = np.divide(num, av[part, None], out=np.where(
                num > 0, np.inf, 0.0), where=av[part, None] > 0)
        else:
            raise ValueError(f"unknown metric {metric}")
    return out


def near_distances(a: np.ndarray, b: np.ndarray, out: np.ndarray, k: int, digits: int,
                   weight: np.ndarray | None = None) -> np.ndarray:
    """Euclidean distances of each row's k nearest columns and of all that tie with them
    after rounding; inf elsewhere, and where ``out`` holds.

    A matrix product gives all distances nearly; those that may be among the k
    nearest, by its error and the rounding, are computed as ``distance_matrix`` does.
    With ``weight`` (of the squares), nearest by the weighted distance.
    """
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 1e-12 * (aa.max() + bb.max()) * (1.0 if weight is None else weight.max())
    if not np.isfinite(error):
        d = distance_matrix(a, b, "euclidean")
        d[out | np.isnan(d)] = np.inf
        return d
    near = a @ b.T
    near *= -2
    near += aa[:, None]
    near += bb
    if weight is not None:
        near *= weight
    near[out] = np.inf
    if k < near.shape[1]:
        last = near.min(axis=1) if k == 1 else _not_below(near, k)
        most = (np.sqrt(np.maximum(last, 0) + error) + 1.01 * 10.0 ** -digits) ** 2 + error
        i, j = np.nonzero(near <= most[:, None])
    else:
        i, j = np.nonzero(~out)
    d = np.full(near.shape, np.inf)
    for at in range(0, len(i), max(1, _CHUNK // max(1, a.shape[1]))):
        part = slice(at, at + max(1, _CHUNK // max(1, a.shape[1])))
        x = a[i[part]] - b[j[part]]
        d[i[part], j[part]] = np.sqrt(np.multiply(x, x, out=x).sum(axis=1))
    d[out] = np.inf
    return d


def _not_below(near: np.ndarray, k: int, size: int = 16) -> np.ndarray:
    """For each row a number that its k-th least is not above: the k-th least of the minima of
    groups of ``size`` columns."""
    groups = near.shape[1] // size
    if groups >= 2 * k:
        near = near[:, :groups * size].reshape(len(near), size, groups).min(axis=1)
    return np.partition(near, k - 1, axis=1)[:, k - 1]


def rounded_distances(a: np.ndarray, b: np.ndarray, metric: str, digits: int) -> np.ndarray:
    """``distance_matrix``, rounded.

    Squares of differences are found by a matrix product, nearly; those that its error
    could round otherwise are computed as ``distance_matrix`` does.
    """
    root = metric in ("euclidean", "l2")
    error = np.inf
    if len(a) and len(b) and a.shape[1] <= 1 << 11 and (root or metric in ("sqeuclidean", "snr")):
        error = 1e-12 * ((a * a).sum(axis=1).max() + (b * b).sum(axis=1).max())
    if not np.isfinite(error):
        return np.round(distance_matrix(a, b, metric), digits)
    x, y = a, b
    if metric == "snr":
        x, y = (z - z.mean(axis=1, keepdims=True) for z in (a, b))
    xx, yy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    columns = np.ascontiguousarray(y.T)
    unit = 10.0 ** digits
    out = np.empty((len(a), len(b)))
    some = max(1, _CHUNK // max(1, a.shape[1]))
    for begin in range(0, len(a), TILE_ROWS):
        rows = slice(begin, begin + TILE_ROWS)
        near = np.matmul(x[rows], columns, out=out[rows])
        near *= -2
        near += xx[rows, None]
        near += yy
        np.maximum(near, 0, out=near)
        room = error * unit
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            if root:
                np.sqrt(near, out=near)
            elif metric == "snr":
                near /= xx[rows, None]
                room = room / xx[rows, None]
            near *= unit
            off = near - np.rint(near)
            np.abs(off, out=off)
            if root:  # the error of a root is that of its square, divided by the root
                off += room * unit / near
                room = 0.0
            room = room + 1e-6 + 1e-15 * near.max(axis=1, keepdims=True)
            np.rint(near, out=near)
            near /= unit
            i, j = np.nonzero(~(off < 0.5 - room))
        for k in range(0, len(i), some):
            p, q = i[k:k + some], j[k:k + some]
            near[p, q] = np.round(_pair_distances(a[rows][p], b[q], metric), digits)
    return out


def _pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row of a to the same row of b, as ``distance_matrix`` computes it."""
    d = a - b
    if metric == "snr":
        av = ((a - a.mean(axis=1, keepdims=True)) ** 2).sum(axis=1)
        dc = d - d.mean(axis=1, keepdims=True)
        num = (dc * dc).sum(axis=1)
        return np.divide(num, av, out=np.where(num > 0, np.inf, 0.0), where=av > 0)
    d = np.multiply(d, d, out=d).sum(axis=1)
    return np.sqrt(d) if metric in ("euclidean", "l2") else d


def first_nearest(a: np.ndarray, b: np.ndarray, metric: str, digits: int
                  ) -> tuple[np.ndarray, np.ndarray]:
    """(column, distance) of each row's nearest column by rounded distance; ties to the lower one.

    City-block distances are summed in whole steps of 16 bits first.  Each row's loss by
    that is known, so the columns that may be nearest are too; these are computed as
    ``distance_matrix`` does.
    """
    at, least = np.zeros(len(a), np.int64), np.full(len(a), np.inf)
    steps = _stepped(a, b) if metric in ("cityblock", "manhattan", "l1") else None
    for begin in range(0, len(a), TILE_ROWS):
        rows = slice(begin, begin + TILE_ROWS)
        if steps is None:
            d = np.round(distance_matrix(a[rows], b, metric), digits)
            at[rows] = d.argmin(axis=1)
            least[rows] = d[np.arange(len(d)), at[rows]]
            continue
        (qa, loss_a), (qb, loss_b), step, error = steps
        # Distance in steps, less what is the same for a row: |x - y| = x + y - 2 min(x, y).
        about = np.empty((len(qa[rows]), len(b)), np.int32)
        lows, totals = np.empty((2, len(about), TILE_COLUMNS), np.uint16)
        for first in range(0, len(b), TILE_COLUMNS):
            part = qb[:, first:first + TILE_COLUMNS]
            low, total = lows[:, :part.shape[1]], totals[:, :part.shape[1]]
            total[...] = 0
            for f in range(len(part)):
                np.minimum(qa[rows, f, None], part[f], out=low)
                total += low
            about[:, first:first + TILE_COLUMNS] = (part.sum(axis=0, dtype=np.int32)
                                                    - 2 * total.astype(np.int32))
        most = about.min(axis=1) + np.ceil(
            (2 * loss_a[rows] + 2 * loss_b.max() + error + 1.01 * 10.0 ** -digits) / step)
        i, j = np.nonzero(about <= most[:, None])
        d = np.empty(len(i))
        some = max(1, _CHUNK // max(1, a.shape[1]))
        for k in range(0, len(i), some):
            x = a[rows][i[k:k + some]] - b[j[k:k + some]]
            d[k:k + some] = np.abs(x, out=x).sum(axis=1)
        d = np.round(d, digits)
        order = np.lexsort((j, d, i))
        best = order[np.searchsorted(i, np.arange(len(about)))]
        at[rows], least[rows] = j[best], d[best]
    return at, least


def first_distances(a: np.ndarray, b: np.ndarray, own: np.ndarray, metric: str, digits: int
                    ) -> np.ndarray:
    """Each row's distance to its ``first_nearest`` column, inf elsewhere; all distances where a
    column is to be left out (``own``) or a number isn't finite."""
    if own.any() or not (np.isfinite(a).all() and np.isfinite(b).all()):
        return distance_matrix(a, b, metric)
    at, least = first_nearest(a, b, metric, digits)
    d = np.full((len(a), len(b)), np.inf)
    d[np.arange(len(a)), at] = least
    return d


def _stepped(a: np.ndarray, b: np.ndarray):
    """Both sides in whole steps above each feature's least value, with each row's loss: the
    greatest sums fit 16 bits; (rows of a, loss), (columns of b, loss), step, rounding error.
    None if there is no such step."""
    if not len(a) or not len(b) or not 0 < a.shape[1] < 1 << 12:
        return None
    low = np.minimum(a.min(axis=0), b.min(axis=0))
    high = np.maximum(a.max(axis=0), b.max(axis=0))
    # Room for rounding up in every feature.
    step = (high - low).sum() / ((1 << 16) - 1 - a.shape[1])
    error = 1e-12 * a.shape[1] * max(np.abs(low).max(), np.abs(high).max())
    if not np.isfinite(step) or not np.isfinite(error) or step <= error:
        return None

    def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (x - low) / step
        q = np.rint(x)
        return q.astype(np.uint16), step * np.abs(x - q).sum(axis=1)
    (qa, loss_a), (qb, loss_b) = whole(a), whole(b)
    return (qa, loss_a), (np.ascontiguousarray(qb.T), loss_b), step, error


def first_columns(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of each row's k least finite values; ties to the lower column."""
    d = np.where(np.isnan(d), np.inf, d)
    if k == 1:
        i, j = np.arange(len(d)), d.argmin(axis=1)
    else:
        i, j = np.nonzero(d < np.inf)  # by row, then column
        if len(i) > 4 * k * len(d):
            most = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
            i, j = np.nonzero(d <= most[:, None])
        order = np.lexsort((j, d[i, j], i))
        i, j = i[order], j[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, j = i[place < k], j[place < k]
    keep = np.isfinite(d[i, j])
    i, j = i[keep], j[keep]
    return i, j, d[i, j]


def nearest_of(k: int):
    """Merge of (q, r, distance) rows: the k nearest of every q."""
    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.sort_values(["q", "distance", "r"]).groupby("q", dropna=False).head(k)
    return merged


def vector_distance(a: Column, b: Column, metric: str) -> Column:
    """The same metrics as JVM array expressions (for candidate pairs)."""
    if metric in ("cityblock", "manhattan", "l1"):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0),
                           lambda acc, x: acc + x)
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                     lambda acc, x: acc + x)
    if metric in ("euclidean", "l2"):
        return F.sqrt(sq)
    if metric == "sqeuclidean":
        return sq
    raise ValueError(f"metric {metric} has no column form; use all_pairs")


def all_pairs(vecs: DataFrame, id_col: str, vec: str, carry: list[str] | None = None,
              metric: str = "cityblock", normalise: bool = False, block_rows: int = 1024,
              ordered: bool | None = None) -> DataFrame:
    """(left_id, right_id, left_<c>, right_<c> for c in carry, distance).

    Symmetric metrics give each unordered pair once with left_id < right_id;
    asymmetric ones (``snr``), or ``ordered=True``, give both orientations.
    ``normalise`` scales vectors to unit L2 norm first.
    """
    carry = list(carry or [])
    if ordered is None:
        ordered = metric in ASYMMETRIC
    id_type = vecs.schema[id_col].dataType
    fields = [T.StructField("left_id", id_type), T.StructField("right_id", id_type)]
    for c in carry:
        t = vecs.schema[c].dataType
        fields += [T.StructField(f"left_{c}", t), T.StructField(f"right_{c}", t)]
    fields.append(T.StructField("distance", T.DoubleType()))
    schema = T.StructType(fields)

    nb = F.greatest(F.ceil(vecs.select(F.count(F.lit(1))).scalar() / block_rows), F.lit(1))
    v = (vecs.select(id_col, vec, *carry).withColumn("_nb", nb.cast("int"))
         .withColumn("_b", F.pmod(F.xxhash64(id_col), F.col("_nb")).cast("int")))
    # side 0: this row's block is bi; side 1: it is bj of a lower bi.
    left = (v.withColumn("_bi", F.col("_b"))
            .withColumn("_bj", F.explode(F.sequence(F.col("_b"), F.col("_nb") - 1)))
            .withColumn("_side", F.lit(0)))
    right = (v.filter(F.col("_b") > 0)
             .withColumn("_bi", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
             .withColumn("_bj", F.col("_b")).withColumn("_side", F.lit(1)))
    rows = left.unionByName(right).drop("_nb", "_b")

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        lhs = pdf[pdf["_side"] == 0]
        diagonal = int(pdf["_bi"].iloc[0]) == int(pdf["_bj"].iloc[0])
        rhs = lhs if diagonal else pdf[pdf["_side"] == 1]
        if lhs.empty or rhs.empty:
            return no_rows([f.name for f in fields])
        a = np.stack(lhs[vec].to_numpy()).astype(np.float64)
        b = a if diagonal else np.stack(rhs[vec].to_numpy()).astype(np.float64)
        if normalise:
            a, b = _normalise(a), (_normalise(b) if not diagonal else None)
            b = a if diagonal else b
        d = distance_matrix(a, b, metric)
        if diagonal:
            if ordered:
                i, j = np.where(~np.eye(len(lhs), dtype=bool))
            else:
                i, j = np.triu_indices(len(lhs), k=1)
            li, ri = i, j
            dist = d[i, j]
        else:
            i, j = np.indices(d.shape).reshape(2, -1)
            li, ri, dist = i, j, d.ravel()
            if ordered:
                back = distance_matrix(b, a, metric)
                li2, ri2 = np.indices(back.shape).reshape(2, -1)
        out = {}
        lid, rid = lhs[id_col].to_numpy()[li], rhs[id_col].to_numpy()[ri]
        cols = {c: (lhs[c].to_numpy()[li], rhs[c].to_numpy()[ri]) for c in carry}
        if not ordered:
            swap = lid > rid
            lid, rid = np.where(swap, rid, lid), np.where(swap, lid, rid)
            cols = {c: (np.where(swap, r, l), np.where(swap, l, r)) for c, (l, r) in cols.items()}
        elif not diagonal:
            lid = np.concatenate([lid, rhs[id_col].to_numpy()[li2]])
            rid = np.concatenate([rid, lhs[id_col].to_numpy()[ri2]])
            cols = {c: (np.concatenate([l, rhs[c].to_numpy()[li2]]),
                        np.concatenate([r, lhs[c].to_numpy()[ri2]])) for c, (l, r) in cols.items()}
            dist = np.concatenate([dist, back.ravel()])
        out["left_id"], out["right_id"] = lid, rid
        for c, (l, r) in cols.items():
            out[f"left_{c}"], out[f"right_{c}"] = l, r
        out["distance"] = dist
        return pd.DataFrame(out)

    return rows.groupBy("_bi", "_bj").applyInPandas(block, schema)


def shuffle_rows(n_left: int, n_right: int, block_rows: int, width: int, wanted: int) -> int:
    """Rows of a block as it is shuffled.

    A row is copied to every block of the other side, so blocks grow from
    ``block_rows`` as long as ``wanted`` block pairs are left and a block's
    vectors of ``width`` numbers stay within BLOCK_NUMBERS.
    """
    most = max(block_rows, BLOCK_NUMBERS // max(1, width))
    fair = int((n_left / wanted * n_right) ** 0.5)
    return min(max(block_rows, fair), most)


def blocked(left: DataFrame, right: DataFrame, id_col: str, vec: str, reduce, schema: str,
            carry: list[str] | None = None, metric: str | None = "cityblock",
            normalise: bool = False, block_rows: int = 1024, measure=None, merge=None,
            gather=None, twice: bool = False) -> DataFrame:
    """``reduce(left rows, right rows, distances)`` on every left block x right block.

    With ``metric`` None the distances are 0.  ``measure(left rows, right rows, a, b, own)``
    replaces the metric; own marks the pairs of a row with itself.  ``merge`` reduces what
    a tile's left rows gave against the whole right block.  ``gather()`` makes an object for
    a block pair: ``add`` takes every tile instead of ``reduce``, ``rows`` gives the results.
    With ``twice`` both tables are one: two tiles meet once, and ``reduce`` is also told how
    often their pairs count, twice but for a tile with itself.

    Both tables are hashed into blocks (``shuffle_rows``) and a row goes to every
    block of the other side; a block pair is read once and worked on in tiles of
    ``block_rows`` rows a side.  Pairs of a row with itself (same id) have distance
    NaN; ``reduce`` must leave them out.
    """
    cols = [id_col, vec, *(carry or [])]
    spark = left.sparkSession
    of_left, of_right = (rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vec)).alias("w")).first()
                         for rows in (left, right))
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = shuffle_rows(of_left["n"], of_right["n"], block_rows,
                        max(of_left["w"] or 0, of_right["w"] or 0), wanted)
    nl, nr = (max(1, -(-n // size)) for n in (of_left["n"], of_right["n"]))

    def split(rows: DataFrame, own: str, other: str, n_own: int, n_other: int, side: int
              ) -> DataFrame:
        return (rows.select(*cols)
                .withColumn(own, F.pmod(F.xxhash64(id_col), F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
                .select(*cols, "_bl", "_br", F.lit(side).alias("_side")))
    rows = split(left, "_bl", "_br", nl, nr, 0)
    if twice:
        rows = rows.filter("_bl <= _br")
    others = split(right, "_br", "_bl", nr, nl, 1)
    rows = rows.unionByName(others.filter("_bl < _br") if twice else others)

    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def side_of(parts: list[pd.DataFrame]) -> tuple[pd.DataFrame, np.ndarray]:
        one = pd.concat(parts).sort_values(id_col, ignore_index=True)
        x = np.stack(one.pop(vec).to_numpy()).astype(np.float64)
        return one, _normalise(x) if normalise else x

    def block(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides, own_block = ([], []), False
        for pdf in parts:
            own_block = twice and bool((pdf["_bl"] == pdf["_br"]).all())
            for k in (0, 1):
                one = pdf[pdf["_side"] == k]
                if not one.empty:
                    sides[k].append(one)
        if not sides[0] or not (sides[1] or own_block):
            return
        lhs, a = side_of(sides[0])
        rhs, b = (lhs, a) if own_block else side_of(sides[1])
        del sides
        held = gather() if gather else None
        for i in range(0, len(a), block_rows):
            found = (tile(lhs, a, rhs, b, i, j, held.add if held else reduce, own_block and i == j)
                     for j in range(i if own_block else 0, len(b), block_rows))
            if held:
                for _ in found:
                    pass
            elif merge is None:
                yield from found
            else:
                yield merge(pd.concat([x for x in found if len(x)] or [no_rows(names)]))
        if held:
            yield from held.rows()

    def tile(lhs, a, rhs, b, i, j, reduce, itself):
        l, r = lhs.iloc[i:i + block_rows], rhs.iloc[j:j + block_rows]
        x, y = a[i:i + block_rows], b[j:j + block_rows]
        own = l[id_col].to_numpy()[:, None] == r[id_col].to_numpy()[None, :]
        if metric is None:
            d = np.zeros((len(x), len(y)))
            l, r = l.assign(**{vec: list(x)}), r.assign(**{vec: list(y)})
        else:
            d = measure(l, r, x, y, own) if measure else distance_matrix(x, y, metric)
        d[own] = np.nan
        return reduce(l, r, d, 1 if itself else 2) if twice else reduce(l, r, d)

    block.__annotations__ = {"parts": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return rows.groupBy("_bl", "_br").applyInPandas(block, schema)


def _id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def compared_pairs(compared: DataFrame, comparator: DataFrame, id_col: str, vec: str,
                   carry: list[str], metric: str = "euclidean", normalise: bool = False,
                   digits: int = 6, block_rows: int = 1024) -> DataFrame:
    """Every compared row with every comparator row but itself:
    (left_id, right_id, left_<c>, right_<c>, distance)."""
    t = _id_type(compared, id_col)
    schema = f"left_id {t}, right_id {t}, " + "".join(
        f"left_{c} {_id_type(compared, c)}, right_{c} {_id_type(compared, c)}, "
        for c in carry) + "distance double"

    def rounded(lhs, rhs, a, b, own):
        return rounded_distances(a, b, metric, digits)

    def listed(lhs, rhs, d):
        out = {}
        for name, c in (("id", id_col), *((c, c) for c in carry)):
            out[f"left_{name}"] = np.repeat(lhs[c].to_numpy(), len(rhs))
            out[f"right_{name}"] = np.tile(rhs[c].to_numpy(), len(lhs))
        out = pd.DataFrame(out | {"distance": d.ravel()})
        own = np.isnan(d).ravel()
        return out[~own] if own.any() else out
    return blocked(compared, comparator, id_col, vec, listed, schema, carry, metric, normalise,
                   block_rows, rounded)


def extreme_pairs(compared: DataFrame, comparator: DataFrame, id_col: str, vec: str,
                  label: str = "label", metric: str = "euclidean", normalise: bool = False,
                  digits: int = 6, block_rows: int = 1024, beyond: str | None = None) -> DataFrame:
    """(left_id, distance, is_pair): of the pairs of ``compared_pairs``, the nearest and the
    farthest true, false and unknown one (null: a label is) of each compared row and block.

    With ``beyond``, a distance of the compared rows: only the nearest false pairs beyond it.
    """
    t = _id_type(compared, id_col)

    def rounded(lhs, rhs, a, b, own):
        return rounded_distances(a, b, metric, digits)

    def ends(lhs, rhs, d):
        there = ~np.isnan(d)
        known = lhs[label].notna().to_numpy()[:, None] & rhs[label].notna().to_numpy()[None, :]
        same = lhs[label].to_numpy()[:, None] == rhs[label].to_numpy()[None, :]
        kinds = {True: there & known & same, False: there & known & ~same, None: there & ~known}
        if beyond:
            kinds = {False: kinds[False] & (d > lhs[beyond].to_numpy(float)[:, None])}
        parts = []
        for flag, of in kinds.items():
            some = of.any(axis=1)
            if not some.any():
                continue
            ids = lhs[id_col].to_numpy()[some]
            parts += [pd.DataFrame({"left_id": ids, "distance": x[some], "is_pair": flag}) for x in (
                np.where(of, d, np.inf).min(axis=1),
                *(() if beyond else (np.where(of, d, -np.inf).max(axis=1),)))]
        return pd.concat(parts) if parts else no_rows(["left_id", "distance", "is_pair"])

    def merged(found):
        return pd.concat([pd.DataFrame(found.groupby(["left_id", "is_pair"], dropna=False)["distance"]
                                       .agg(end).reset_index()) for end in
                          (("min",) if beyond else ("min", "max"))])
    if beyond:
        comparator = comparator.withColumn(beyond, F.lit(None).cast("double"))
    return blocked(compared, comparator, id_col, vec, ends,
                   f"left_id {t}, distance double, is_pair boolean",
                   [label, *([beyond] if beyond else [])], metric, normalise, block_rows, rounded,
                   merged).select("left_id", "distance", "is_pair")


def pair_counts(compared: DataFrame, comparator: DataFrame, id_col: str, vec: str,
                label: str = "label", metric: str = "euclidean", normalise: bool = False,
                digits: int = 6, block_rows: int = 1024, by: str | None = None) -> DataFrame:
    """(distance, is_pair, n): how many pairs have that (rounded) distance, counted per
    block before the shuffle; ``by``, a boolean column of the comparators, parts them too
    (then is_pair is null where a label is)."""
    keys = ["distance", "is_pair", *([by] if by else [])]

    def kinds(lhs, rhs):
        """(mark, is_pair, columns, pairs of these columns) of every kind of pair."""
        same = lhs[label].to_numpy()[:, None] == rhs[label].to_numpy()[None, :]
        found = {True: same, False: ~same}
        if by:
            known = lhs[label].notna().to_numpy()[:, None] & rhs[label].notna().to_numpy()[None, :]
            found = {True: same & known, False: ~same & known, None: ~known}
        for mark in ((True, False) if by else (None,)):
            cols = slice(None) if mark is None else np.flatnonzero(rhs[by].to_numpy() == mark)
            for flag, of in found.items():
                yield mark, flag, cols, of[:, cols]
    if by:  # the compared rows have no mark of their own to carry
        compared = compared.withColumn(by, F.lit(None).cast("boolean"))
    carry = [label, *([by] if by else [])]
    if normalise and metric in ("euclidean", "l2", "sqeuclidean") and digits <= 6:
        return _unit_counts(compared, comparator, id_col, vec, carry, kinds, metric, digits,
                            block_rows, by)

    def counted(lhs, rhs, d):
        parts = []
        for mark, flag, cols, of in kinds(lhs, rhs):
            x = d[:, cols][of]
            values, n = np.unique(np.round(x[~np.isnan(x)], digits), return_counts=True)
            part = {"distance": values, "is_pair": flag, "n": n}
            parts.append(pd.DataFrame(part | ({by: mark} if by else {})))
        return pd.concat(parts)

    def merged(found):
        return found.groupby(keys, as_index=False, dropna=False)["n"].sum()
    rows = blocked(compared, comparator, id_col, vec, counted, "distance double, is_pair boolean, "
                   "n bigint" + (f", {by} boolean" if by else ""), carry, metric, normalise,
                   block_rows, None, merged)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


class _Steps:
    """Pairs of a block pair, counted by kind and whole steps of their rounded distance."""

    def __init__(self, kinds, digits: int):
        self.kinds, self.unit, self.sums = kinds, 10.0 ** digits, {}

    def add(self, lhs, rhs, d) -> None:
        d = np.multiply(d, self.unit, out=d)
        d[np.isnan(d)] = -1
        steps = np.rint(d, out=d).astype(np.int64)
        for mark, flag, cols, of in self.kinds(lhs, rhs):
            x = steps[:, cols][of]
            x = x[x >= 0]
            if not len(x):
                continue
            low = int(x.min())
            n = np.bincount(x - low)
            held = self.sums.get((mark, flag), np.zeros(0, np.int64))
            if low + len(n) > len(held):
                held = np.r_[held, np.zeros(low + len(n) - len(held), np.int64)]
            held[low:low + len(n)] += n
            self.sums[mark, flag] = held

    def rows(self) -> Iterator[pd.DataFrame]:
        for (mark, flag), held in self.sums.items():
            parts = [(at // PART, held[at:at + PART]) for at in range(0, len(held), PART)
                     if held[at:at + PART].any()]
            yield pd.DataFrame({"mark": pd.Series([mark] * len(parts), dtype=object),
                                "is_pair": pd.Series([flag] * len(parts), dtype=object),
                                "part": [k for k, _ in parts],
                                "counts": [zlib.compress(n.tobytes(), 1) for _, n in parts]})


def _unit_counts(compared, comparator, id_col, vec, carry, kinds, metric, digits, block_rows, by
                 ) -> DataFrame:
    """``pair_counts`` of unit vectors, whose distances have few steps: a block pair keeps one
    count for each of them, and only these leave it, packed, PART steps to a row."""
    def rounded(lhs, rhs, a, b, own):
        return rounded_distances(a, b, metric, digits)

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART, np.int64)
        for packed in pdf["counts"]:
            n = np.frombuffer(zlib.decompress(packed), np.int64)
            total[:len(n)] += n
        at = np.flatnonzero(total)
        mark, flag, part = (pdf[c].iloc[0] for c in ("mark", "is_pair", "part"))
        return pd.DataFrame({
            "distance": (int(part) * PART + at) / 10.0 ** digits, "n": total[at],
            "mark": pd.Series([mark] * len(at), dtype=object),
            "is_pair": pd.Series([flag] * len(at), dtype=object)})
    rows = blocked(compared, comparator, id_col, vec, None,
                   "mark boolean, is_pair boolean, part int, counts binary", carry, metric, True,
                   block_rows, rounded, gather=lambda: _Steps(kinds, digits))
    found = rows.groupBy("mark", "is_pair", "part").applyInPandas(
        added, "distance double, n bigint, mark boolean, is_pair boolean")
    return found.select("distance", "is_pair", *([F.col("mark").alias(by)] if by else []), "n")


def nearest(queries: DataFrame, refs: DataFrame, id_col: str, vec: str, k: int = 1,
            metric: str = "cityblock", normalise: bool = False, digits: int = 9,
            block_rows: int = 1024) -> DataFrame:
    """(q, r, distance, rank): the k nearest references of every query but itself;
    rounded distances, ties to the smaller id.  k rows per query leave a block."""
    t = _id_type(queries, id_col)

    def best(lhs, rhs, d):
        i, j, d = first_columns(np.round(d, digits), k)  # columns are in id order
        return pd.DataFrame({"q": lhs[id_col].to_numpy()[i], "r": rhs[id_col].to_numpy()[j],
                             "distance": d})

    def screened(lhs, rhs, a, b, own):
        if metric in ("euclidean", "l2"):
            return near_distances(a, b, own, k, digits)
        if metric in ("cityblock", "manhattan", "l1") and k == 1:
            return first_distances(a, b, own, metric, digits)
        return distance_matrix(a, b, metric)

    rows = blocked(queries, refs, id_col, vec, best, f"q {t}, r {t}, distance double", None,
                   metric, normalise, block_rows, screened, nearest_of(k))
    # At most k rows per query and block of references.
    w = Window.partitionBy("q").orderBy("distance", "r")
    return (rows.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .filter(F.col("rank") <= k))


def closest_false(compared: DataFrame, comparator: DataFrame, id_col: str, vec: str, k: int,
                  label: str = "label", metric: str = "euclidean", normalise: bool = False,
                  digits: int = 6, block_rows: int = 1024) -> DataFrame:
    """The k closest pairs of different labels (a top-k report); k rows leave a block."""
    t = _id_type(compared, id_col)

    def best(lhs, rhs, d):
        same = lhs[label].to_numpy()[:, None] == rhs[label].to_numpy()[None, :]
        d = np.where(same | np.isnan(d), np.inf, np.round(d, digits))
        flat = np.argsort(d, axis=None, kind="stable")[:k]
        i, j = np.unravel_index(flat[np.isfinite(d.ravel()[flat])], d.shape)
        return pd.DataFrame({"left_id": lhs[id_col].to_numpy()[i],
                             "right_id": rhs[id_col].to_numpy()[j], "distance": d[i, j]})
    rows = blocked(compared, comparator, id_col, vec, best,
                   f"left_id {t}, right_id {t}, distance double", [label], metric, normalise,
                   block_rows)
    return rows.orderBy("distance", "left_id", "right_id").limit(k)


def candidate_pairs(vecs: DataFrame, candidates: DataFrame, id_col: str, vec: str,
                    carry: list[str] | None = None, metric: str = "cityblock") -> DataFrame:
    """Score given (left_id, right_id) pairs: two equi-joins, JVM-side distance."""
    carry = list(carry or [])
    lv = vecs.select(F.col(id_col).alias("left_id"), F.col(vec).alias("_lv"),
                     *[F.col(c).alias(f"left_{c}") for c in carry])
    rv = vecs.select(F.col(id_col).alias("right_id"), F.col(vec).alias("_rv"),
                     *[F.col(c).alias(f"right_{c}") for c in carry])
    j = candidates.select("left_id", "right_id").join(lv, "left_id").join(rv, "right_id")
    return j.withColumn("distance", vector_distance(F.col("_lv"), F.col("_rv"), metric)).drop(
        "_lv", "_rv")


def pairs_frame(pairs: DataFrame, threshold: float, k: int = 0, cls: str = "label",
                label: str | None = None, strict: bool = True) -> DataFrame:
    """The reference's pair table from a distance table.

    Distance, Probability = 1 - d, Attribution = d < t (``strict``) else
    d <= t, IsAPair = same class (null when either class is ``[OOD]``).
    """
    lc, rc = F.col(f"left_{cls}").cast("string"), F.col(f"right_{cls}").cast("string")
    ll = F.col(f"left_{label}").cast("string") if label else F.col("left_id").cast("string")
    rl = F.col(f"right_{label}").cast("string") if label else F.col("right_id").cast("string")
    d = F.col("distance")
    ood = (lc == "[OOD]") | (rc == "[OOD]")
    return pairs.select(
        lc.alias("ComparedClass"), ll.alias("ComparedLabel"),
        rc.alias("ComparatorClass"), rl.alias("ComparatorLabel"),
        d.alias("Distance"), (1 - d).alias("Probability"),
        (d < threshold if strict else d <= threshold).alias("Attribution"),
        F.when(ood, F.lit(None).cast("boolean")).otherwise(lc == rc).alias("IsAPair"),
        F.lit(k).alias("K"))
