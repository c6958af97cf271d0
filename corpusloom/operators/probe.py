"""Linear probes of hidden states: per-layer cross-validated accuracy and a permutation test."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

C, FOLDS = 0.1, 5
MOST_VECTORS = 100_000  # of a permutation test


def layers(df: DataFrame, n: int, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """A long table (layer, id, label, features) from one vector cut into n equal parts."""
    width = F.floor(F.size(vector) / n).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.cast("long").alias("layer"), F.slice(F.col(vector), i * width + 1, width).alias("features")))
    return df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.inline(part))


def _fit_score(x: np.ndarray, y: np.ndarray, test: np.ndarray, classes: int, c: float = C, steps: int = 200) -> float:
    """Accuracy on ``test`` of multinomial logistic regression (L2, strength c, free intercept) on
    features standardised by the training rows; accelerated gradient steps."""
    train = ~test
    mean, std = x[train].mean(axis=0), x[train].std(axis=0)
    x = (x - mean) / np.where(std > 0, std, 1.0)
    a = np.c_[x, np.ones(len(x))]
    n = int(train.sum())
    reg = np.r_[np.full(x.shape[1], 1 / (c * n)), 0.0][:, None]
    w = np.zeros((a.shape[1], classes))
    v = w
    rate = 1 / (0.5 * np.linalg.norm(a[train], 2) ** 2 / n + reg.max())
    hot = np.eye(classes)[y[train]]
    for k in range(steps):
        z = a[train] @ v
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = v - rate * (a[train].T @ (p - hot) / n + reg * v)
        v = new + k / (k + 3) * (new - w)
        w = new
    return float(((a[test] @ w).argmax(axis=1) == y[test]).mean())


def _folded(df: DataFrame, folds: int) -> DataFrame:
    """Adds the fold of each row: rows of a class dealt in turn in the order of a hash."""
    w = W.partitionBy("layer", "label").orderBy(F.md5(F.col("id").cast("string")), "id")
    return df.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


def cross_validated(df: DataFrame, folds: int = FOLDS) -> DataFrame:
    """``(layer, accuracy_mean, accuracy_std)`` with the population deviation over stratified
    folds. Each layer and fold is a task; a layer's vectors must fit one task's memory."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["features"].to_numpy()).astype(float)
        names, y = np.unique(pdf["label"].to_numpy().astype(str), return_inverse=True)
        test = (pdf["fold"] == pdf["held"]).to_numpy()
        ok = test.any() and len(names) > 1
        return pd.DataFrame({"layer": pdf["layer"].iloc[:1], "held": pdf["held"].iloc[:1], "accuracy": [_fit_score(x, y, test, len(names)) if ok else None]})

    tasks = _folded(df, folds).withColumn("held", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    scores = tasks.groupBy("layer", "held").applyInPandas(one, "layer long, held int, accuracy double")
    return scores.groupBy("layer").agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"))


def permutation_test(df: DataFrame, draws: int = 200, folds: int = FOLDS, seed: int = 42) -> DataFrame:
    """``(true_accuracy, null_mean, null_std, p)`` for one layer: p = (null >= true, plus one) by
    (draws plus one). The labels are permuted within tasks that share the vectors by broadcast, so
    more than ``MOST_VECTORS`` of them are an error."""
    if (n := df.count()) > MOST_VECTORS:
        raise ValueError(f"{n} vectors, more than the {MOST_VECTORS} that are shared with every task")
    long = _folded(layers(df, 1), folds).orderBy("id").toPandas()
    held = df.sparkSession.sparkContext.broadcast((np.stack(long["features"].to_numpy()).astype(float), np.unique(long["label"].to_numpy().astype(str), return_inverse=True)[1], long["fold"].to_numpy()))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, fold = held.value
        k = int(pdf["draw"].iloc[0])
        labels = y if k == 0 else np.random.default_rng([seed, k]).permutation(y)
        return pd.DataFrame({"draw": [k], "accuracy": [float(np.mean([_fit_score(x, labels, fold == f, int(y.max()) + 1) for f in range(folds)]))]})

    got = df.sparkSession.range(draws + 1).withColumnRenamed("id", "draw").groupBy("draw").applyInPandas(run, "draw long, accuracy double")
    true = F.max(F.when(F.col("draw") == 0, F.col("accuracy")))
    stats = got.agg(true.alias("true_accuracy"), F.collect_list(F.when(F.col("draw") > 0, F.col("accuracy"))).alias("null"))
    x = F.col("null")
    mean = F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)
    return stats.select("true_accuracy", mean.alias("null_mean"), F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / F.size(x)).alias("null_std"), ((F.size(F.filter(x, lambda v: v >= F.col("true_accuracy"))) + 1) / (F.size(x) + 1)).alias("p"))
