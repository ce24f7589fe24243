"""In-batch pairs: AUROC and mining.

A batch of the m-per-class plan (F12) is one group of m rows of each class; it
forms its own pairs, scores and mines them, and gives back one row.  No pair
leaves the group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from handprint.operators.pairs import distance_matrix

#: What is mined; a batch's sums of these distances over its anchors.
MINED = ("easy_positive", "hard_positive", "easy_negative", "semihard_negative", "hard_negative")


def auroc(distance: np.ndarray, same: np.ndarray) -> float | None:
    """P(a true pair is nearer than a false one), ties half; None without both kinds."""
    pos, neg = np.sort(distance[same]), np.sort(distance[~same])
    if not len(pos) or not len(neg):
        return None
    nearer = np.searchsorted(neg, pos, "right")
    ties = nearer - np.searchsorted(neg, pos, "left")
    return float((len(neg) - nearer + ties / 2).sum() / (len(pos) * len(neg)))


def mined(d: np.ndarray, same: np.ndarray) -> dict[str, np.ndarray]:
    """Per anchor (rows with a positive and a negative): the distances of what is mined.

    Easy positive: the nearest; hard: the farthest.  Easy negative: the
    farthest; hard: the nearest; semihard: the nearest beyond the easy positive
    (NaN if there is none).
    """
    other = ~np.eye(len(d), dtype=bool)
    pos, neg = same & other, ~same
    full = pos.any(axis=1) & neg.any(axis=1)
    d, pos, neg = d[full], pos[full], neg[full]
    near = np.where(pos, d, np.inf).min(axis=1, initial=np.inf)
    beyond = np.where(neg & (d > near[:, None]), d, np.inf).min(axis=1, initial=np.inf)
    return {"easy_positive": near,
            "hard_positive": np.where(pos, d, -np.inf).max(axis=1, initial=-np.inf),
            "easy_negative": np.where(neg, d, -np.inf).max(axis=1, initial=-np.inf),
            "semihard_negative": np.where(np.isfinite(beyond), beyond, np.nan),
            "hard_negative": np.where(neg, d, np.inf).min(axis=1, initial=np.inf)}


def batch_scores(rows: DataFrame, keys: list[str], vec: str, label: str, row_id: str,
                 metric: str = "euclidean", normalise: bool = True, digits: int = 6) -> DataFrame:
    """One row per batch (``keys``): n_rows, n_pairs, n_true, auroc, n_anchors, n_semihard and
    the sum of each mined distance over the anchors (see MINED).

    ``rows`` holds a row once for each batch it is in; a batch has at most m
    rows of each class.  Unordered pairs for the AUROC, every row as an anchor
    for mining.  An AUROC that can't be told (one class, one row) is null.
    """
    schema = rows.select(*keys)
    fields = ", ".join(f"{k} {schema.schema[k].dataType.simpleString()}" for k in keys)
    fields += (", n_rows bigint, n_pairs bigint, n_true bigint, auroc double, n_anchors bigint, "
               "n_semihard bigint, " + ", ".join(f"{m} double" for m in MINED))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(row_id)
        x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
        if normalise:
            n = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        d = np.round(distance_matrix(x, x, metric), digits)
        cls = pdf[label].to_numpy()
        same = cls[:, None] == cls[None, :]
        i, j = np.triu_indices(len(x), k=1)
        found = mined(d, same)
        out = {k: [pdf[k].iloc[0]] for k in keys}
        out |= {"n_rows": [len(x)], "n_pairs": [len(i)], "n_true": [int(same[i, j].sum())],
                "auroc": [auroc(d[i, j], same[i, j])],
                "n_anchors": [len(found["easy_positive"])],
                "n_semihard": [int((~np.isnan(found["semihard_negative"])).sum())]}
        out |= {name: [float(np.nansum(found[name]))] for name in MINED}
        return pd.DataFrame(out)[[f.split(" ")[0] for f in fields.split(", ")]]
    return rows.select(*keys, row_id, label, vec).groupBy(*keys).applyInPandas(score, fields)
