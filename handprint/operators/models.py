"""Fitted models as versioned tables.

A model is a few Parquet rows (part, place, label, values) under
``<path>/name=<name>/version=<n>``.  Saving gives the next version; loading
reads the latest or a given one and scores in any session, without training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handprint.operators import linear
from handprint.operators.pca import PCA, project

SCHEMA = "kind string, part string, place int, label string, values array<double>"


@dataclass
class SavedModel:
    """What a model was fitted as: ``kind`` and its parts (name -> rows of numbers)."""

    kind: str
    labels: list[str]
    parts: dict[str, np.ndarray]


def packed(model) -> SavedModel:
    """A fitted SVM (of one fold), PCA or stack of fold weights as its parts."""
    if isinstance(model, linear.StackedSVM):
        if len(model.weights) != 1:
            raise ValueError("only a model fitted on all rows can be saved")
        return SavedModel("svm", [str(x) for x in model.labels], {"weights": model.weights[0]})
    if isinstance(model, PCA):
        return SavedModel("pca", [], {"mean": model.mean[None], "components": model.components,
                                      "variance": model.variance[None], "ratio": model.ratio[None]})
    if isinstance(model, np.ndarray):
        return SavedModel("folds", [], {"weights": model})
    raise ValueError(f"no table form for {type(model).__name__}")


def unpacked(saved: SavedModel):
    parts = saved.parts
    if saved.kind == "svm":
        return linear.StackedSVM(saved.labels, parts["weights"][None], 0)
    if saved.kind == "pca":
        return PCA(parts["mean"][0], parts["components"], parts["variance"][0], parts["ratio"][0])
    return parts["weights"]


def versions(spark: SparkSession, path: str, name: str) -> list[int]:
    """Saved versions of a model, ascending; none if it was never saved."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/name={name}")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = [s.getPath() for s in files.listStatus(folder)
            if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def save(spark: SparkSession, model, path: str, name: str) -> int:
    """Write ``model`` as the next version of ``name`` and return its number (from 1)."""
    if not name or "/" in name or "=" in name:
        raise ValueError("a model's name must not be empty or hold / or =")
    saved = packed(model)
    rows = [(saved.kind, part, i, saved.labels[i] if part == "weights" and saved.labels else None,
             [float(v) for v in row]) for part, values in saved.parts.items()
            for i, row in enumerate(values)]
    version = (versions(spark, path, name) or [0])[-1] + 1
    (spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("error")
     .parquet(f"{path.rstrip('/')}/name={name}/version={version}"))
    return version


def load(spark: SparkSession, path: str, name: str, version: int | None = None):
    """The fitted model of a version, by default the latest; its numbers are bounded."""
    if version is None:
        known = versions(spark, path, name)
        if not known:
            raise ValueError(f"no saved model {name}")
        version = known[-1]
    rows = spark.read.schema(SCHEMA).parquet(
        f"{path.rstrip('/')}/name={name}/version={version}").orderBy("part", "place").collect()
    parts: dict[str, list] = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r["values"])
    labels = [r["label"] for r in rows if r["part"] == "weights" and r["label"] is not None]
    return unpacked(SavedModel(rows[0]["kind"], labels,
                               {k: np.array(v, dtype=np.float64) for k, v in parts.items()}))


class Attributor:
    """Fit with a held-out split, test, keep under a name, and predict later."""

    def __init__(self, path: str, name: str, components: int | None = None):
        self.path, self.name, self.components = path, name, components

    def fit(self, rows: DataFrame, target: str, vec: str = "vec", split: str = "split") -> DataFrame:
        """Fit on the rows of split 'train', save, and predict the others: (..., prediction, score)."""
        spark = rows.sparkSession
        train = rows.filter(F.col(split) == "train")
        if self.components:
            from handprint.operators.pca import fit_pca
            reducer = fit_pca(train, vec, self.components)
            save(spark, reducer, self.path, f"{self.name}-pca")
            train = project(reducer, train.select(target, vec), vec)
        save(spark, linear.fit(train, target, vec), self.path, self.name)
        keep = [c for c in rows.columns if c != vec]
        return self.predict(rows.filter(F.col(split) != "train"), keep, vec)

    def predict(self, rows: DataFrame, keep: list[str], vec: str = "vec",
                version: int | None = None, threshold: float | None = None) -> DataFrame:
        """Score rows with the saved model; nothing is trained."""
        spark = rows.sparkSession
        rows = rows.select(*keep, vec)
        if self.components:
            rows = project(load(spark, self.path, f"{self.name}-pca", version), rows, vec)
        model = load(spark, self.path, self.name, version)
        return linear.predict(model, rows, keep, vec, threshold=threshold)
