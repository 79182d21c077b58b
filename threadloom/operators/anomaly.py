"""Isolation forest: trees grown on a small hashed sample, scored where the rows are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows per tree, trees, and rows drawn for all trees; the sample is what the driver holds.
SUBSAMPLE, TREES, SAMPLE = 256, 100, 8192


def _expected(n: float) -> float:
    """Mean path length of an unsuccessful search in a tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n <= 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A tree as nested (feature, cut, left, right), leaves as path-length corrections."""
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) else []
    if depth == 0 or len(x) <= 1 or not len(spread):
        return (_expected(len(x)),)
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    side = x[:, f] < cut
    return f, cut, grow(x[side], rng, depth - 1), grow(x[~side], rng, depth - 1)


def depths(tree: tuple, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))

    def walk(node: tuple, at: np.ndarray, d: int) -> None:
        if len(node) == 1:
            out[at] = d + node[0]
            return
        side = x[at, node[0]] < node[1]
        walk(node[2], at[side], d + 1)
        walk(node[3], at[~side], d + 1)

    walk(tree, np.arange(len(x)), 0)
    return out


def isolation_scores(df: DataFrame, key: str, features: list[str], seed: int = 17) -> DataFrame:
    """key, score: in (0, 1], higher is stranger. Null or NaN features count as the sample's median; no rows give none."""
    numbers = [F.col(c).cast("double").alias(c) for c in features]
    drawn = np.array(df.select(*numbers).orderBy(F.xxhash64(F.col(key), F.lit(seed))).limit(SAMPLE).collect(), dtype=float).reshape(-1, len(features))
    middle = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in drawn.T]) if len(drawn) else np.zeros(len(features))
    drawn = np.where(np.isnan(drawn), middle, drawn)
    rng = np.random.default_rng(seed)
    size = min(SUBSAMPLE, len(drawn))
    trees = [grow(drawn[rng.choice(len(drawn), size, replace=False)], rng, 8) for _ in range(TREES)] if size else []
    model = df.sparkSession.sparkContext.broadcast((trees, middle, _expected(size) or 1.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest, fill, scale = model.value
        for pdf in batches:
            x = pdf[features].to_numpy(float)
            x = np.where(np.isnan(x), fill, x)
            mean = np.mean([depths(t, x) for t in forest], axis=0) if forest else np.zeros(len(x))
            yield pd.DataFrame({"key": pdf["key"], "score": 2.0 ** (-mean / scale)})

    chosen = df.select(F.col(key).cast("string").alias("key"), *numbers)
    return chosen.mapInPandas(score, "key string, score double").withColumnRenamed("key", key)
