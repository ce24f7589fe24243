"""Principal components (J3's optional step before the SVM).

Every task adds up its rows, their sum and their Gram matrix; partial sums are
added in a second, narrower round, so neither a task nor the driver holds more
than a bounded number of features x features matrices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

#: Groups in which partial sums meet before the last addition.
GROUPS = 16


@dataclass
class PCA:
    """``components`` (k, features), by decreasing ``variance``; signs: the largest
    entry of a component is positive."""

    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    ratio: np.ndarray


def fit_pca(rows: DataFrame, vec: str, k: int) -> PCA:
    """The first k components of ``rows`` (population covariance over n - 1)."""
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            one = (len(x), x.sum(axis=0), x.T @ x)
            n, s, g = one if s is None else (n + one[0], s + one[1], g + one[2])
        if n:
            yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "g": [g.tobytes()]})

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [int(pdf["n"].sum())],
                             "s": [sum(np.frombuffer(b) for b in pdf["s"]).tobytes()],
                             "g": [sum(np.frombuffer(b) for b in pdf["g"]).tobytes()]})
    schema = "n bigint, s binary, g binary"
    parts = rows.select(vec).mapInPandas(partial, schema)
    met = (parts.withColumn("m", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
           .groupBy("m").applyInPandas(added, schema).collect())  # GROUPS rows
    if not met:
        raise ValueError("no rows")
    n = sum(r["n"] for r in met)
    s = sum(np.frombuffer(r["s"]) for r in met)
    g = sum(np.frombuffer(r["g"]) for r in met).reshape(len(s), len(s))
    mean = s / n
    values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(1, n - 1))
    order = np.argsort(-values, kind="stable")[:k]
    total = max(float(np.clip(values, 0, None).sum()), 1e-300)
    parts = vectors.T[order]
    at = np.abs(parts).argmax(axis=1)
    parts = parts * np.sign(parts[np.arange(len(parts)), at])[:, None]
    values = np.clip(values[order], 0, None)
    return PCA(mean, parts, values, values / total)


def project(model: PCA, rows: DataFrame, vec: str) -> DataFrame:
    """``rows`` with ``vec`` replaced by its coordinates along the components."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = rows.drop(vec).schema.add(vec, ArrayType(DoubleType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            out = pdf.drop(columns=[vec])
            if not pdf.empty:
                x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
                out[vec] = list((x - m.mean) @ m.components.T)
            else:
                out[vec] = pd.Series([], dtype=object)
            yield out
    return rows.mapInPandas(run, schema)


def explained(model: PCA, rows: DataFrame) -> DataFrame:
    """(component from 1, variance, ratio)."""
    return rows.sparkSession.createDataFrame(
        [(i + 1, float(v), float(r)) for i, (v, r) in enumerate(zip(model.variance, model.ratio,
                                                                    strict=True))],
        "component bigint, variance double, ratio double")
