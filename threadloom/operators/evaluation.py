"""Splits, fused scores, calibration and error analysis as functions of DataFrames.

Nulls are "not measured": they leave means and shares alone. Empty inputs give empty results or nulls.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Distinct label mixes that ``grouped_kfold`` deals out on the driver, and bins of a calibration histogram.
MOST_MIXES, BINS = 100_000, 10_000


def _lot(key: Column, seed: int) -> Column:
    return F.xxhash64(key, F.lit(seed))


def grouped_kfold(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """df with ``fold`` 0.. so that a group is in one fold and folds have nearly the same size and labels.

    Groups with the same label counts are equal to the rule, so they are dealt round in the order of
    their hash; only the distinct mixes reach the driver, which fixes the fold each one starts with
    (the one that lacks most rows). Null groups are groups of one row each by the row's hash.
    """
    if folds < 2:
        raise ValueError("at least two folds")
    key = F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\u0000row:"), F.xxhash64(*df.columns).cast("string")))
    keyed = df.withColumn("_g", key)
    counts = keyed.groupBy("_g", F.coalesce(F.col(label).cast("string"), F.lit("")).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    groups = counts.groupBy("_g").agg(F.to_json(F.sort_array(F.collect_list(F.struct("_l", "_n")))).alias("_mix"), F.sum("_n").alias("_n"))
    mixes = groups.groupBy("_mix").agg(F.count(F.lit(1)).alias("k"), F.first("_n").alias("n")).limit(MOST_MIXES + 1).collect()
    if len(mixes) > MOST_MIXES:
        raise ValueError(f"more than {MOST_MIXES} different label mixes; coarsen the labels or use hashed folds")
    if sum(m["k"] for m in mixes) < folds:
        raise ValueError("fewer groups than folds")
    loads, starts = [0] * folds, []
    for m in sorted(mixes, key=lambda m: (-m["n"], m["_mix"])):
        start = min(range(folds), key=lambda f: loads[f])
        for f in range(folds):
            loads[(start + f) % folds] += m["n"] * (m["k"] // folds + (f < m["k"] % folds))
        starts.append((m["_mix"], start))
    table = df.sparkSession.createDataFrame(starts, "_mix string, _start int")
    at = F.row_number().over(W.partitionBy("_mix").orderBy(_lot(F.col("_g"), seed), "_g")) - 1
    dealt = groups.withColumn("_at", at).join(table, "_mix").select("_g", ((F.col("_start") + F.col("_at")) % folds).cast("int").alias("fold"))
    return keyed.join(dealt, "_g").drop("_g")


def domain_holdout(df: DataFrame, domain: str, held_out: str | Sequence[str], group: str | None = None, validation: float = 0.12, seed: int = 0) -> DataFrame:
    """df with ``split``: test for the held-out domains; the rest is train but for a share of its groups (rows without ``group``).

    Null domains are never held out. Unknown domains, or nothing left to train on, raise an error.
    """
    names = [held_out] if isinstance(held_out, str) else list(held_out)
    test = F.coalesce(F.col(domain).isin(*names), F.lit(False))
    seen = df.agg(F.sum(test.cast("bigint")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not seen["t"] or seen["t"] == seen["n"]:
        raise ValueError("the held-out domains must be some of the rows, and not all")
    key = F.coalesce(F.col(group).cast("string"), F.xxhash64(*df.columns).cast("string")) if group else F.xxhash64(*df.columns)
    lot = F.pmod(_lot(key, seed), F.lit(1_000_000)) / 1_000_000
    return df.withColumn("split", F.when(test, "test").when(lot < validation, "validation").otherwise("train"))


def overlap(df: DataFrame, split: str, *keys: str) -> DataFrame:
    """key, value, splits of every key value that lies in more than one split; nulls lie in none."""
    each = df.select(F.col(split).alias("_s"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("x")).where("x.value is not null and _s is not null")
    by = each.groupBy("x.key", "x.value").agg(F.sort_array(F.collect_set("_s")).alias("splits"))
    return by.where(F.size("splits") > 1)


def label_summary(df: DataFrame, label: str, group: str | None = None) -> DataFrame:
    """label, n, share, groups: the label balance of a set."""
    by = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), (F.countDistinct(group) if group else F.lit(None).cast("bigint")).alias("groups"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return by.join(F.broadcast(total)).select("label", "n", F.round(F.col("n") / F.col("_total"), 6).alias("share"), "groups")  # one row


def fused(components: Sequence[Column]) -> Column:
    """The mean of the components that are measured; null where none is."""
    real = [F.nanvl(c.cast("double"), F.lit(None).cast("double")) for c in components]
    n = sum((c.isNotNull().cast("int") for c in real), F.lit(0))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in real), F.lit(0.0)), n)


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, share: how much of each column is not null; null for no rows."""
    sums = df.agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.round(c, 6).alias("share")) for c in columns])).alias("x")).select("x.*")


def pair_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, share: how often both columns of each pair are not null."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    sums = df.agg(*[F.avg((F.col(a).isNotNull() & F.col(b).isNotNull()).cast("double")).alias(f"_{k}") for k, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"_{k}", 6).alias("share")) for k, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def ablation(df: DataFrame, configurations: Mapping[str, Sequence[str]]) -> DataFrame:
    """configuration, share, mean: coverage and mean of the score fused from each set of components."""
    scores = df.select(*[fused([F.col(c) for c in cs if c in df.columns] or [F.lit(None)]).alias(f"_{k}") for k, cs in enumerate(configurations.values())])
    sums = scores.agg(*[x for k in range(len(configurations)) for x in (F.avg(F.col(f"_{k}").isNotNull().cast("double")).alias(f"s{k}"), F.avg(f"_{k}").alias(f"m{k}"))])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(name).alias("configuration"), F.round(f"s{k}", 6).alias("share"), F.round(f"m{k}", 6).alias("mean")) for k, name in enumerate(configurations)])).alias("x")).select("x.*")


def top_mean(scores: Column, k: int) -> Column:
    """Mean of the k greatest values of an array; 0 for an empty one, null for null."""
    top = F.slice(F.sort_array(F.filter(scores, lambda x: x.isNotNull()), False), 1, k)
    return F.when(scores.isNotNull(), F.coalesce(F.try_divide(F.aggregate(top, F.lit(0.0), lambda a, x: a + x), F.size(top)), F.lit(0.0)))


def dominant(scores: Mapping[str, Column]) -> Column:
    """The name with the greatest value; the first of equal ones; null where all are null."""
    order = F.array_compact(F.array(*[F.when(c.isNotNull(), F.struct(c.cast("double").alias("v"), F.lit(-k).alias("k"), F.lit(name).alias("name"))) for k, (name, c) in enumerate(scores.items())]))
    return F.array_max(order).getField("name")


def categories(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """category, n: rows that each rule holds for (a row may count in several), and ``uncategorized``."""
    hits = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    found = df.select(F.explode(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("uncategorized")))).alias("category"))
    names = df.sparkSession.createDataFrame([(x,) for x in [*rules, "uncategorized"]], "category string")
    return names.join(found.groupBy("category").agg(F.count(F.lit(1)).alias("n")), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def errors(df: DataFrame, y: str, p: str, key: str, n: int = 50, seed: int = 0) -> DataFrame:
    """The rows that are wrong, with ``error`` fp or fn and ``sampled`` for the n of each kind that come first by hash of the key."""
    wrong = df.where(F.col(y) != F.col(p)).withColumn("error", F.when(F.col(p).cast("int") == 1, "fp").otherwise("fn"))
    drawn = None
    for kind in ("fp", "fn"):  # a bounded sort for each kind, no window over all errors
        part = wrong.where(F.col("error") == kind).select(F.col(key).alias("_k")).orderBy(F.xxhash64("_k", F.lit(seed)), "_k").limit(n)
        drawn = part if drawn is None else drawn.unionByName(part)
    marks = F.broadcast(drawn.distinct().withColumn("sampled", F.lit(True)))  # at most 2 n rows
    return wrong.join(marks, F.col(key) == F.col("_k"), "left").drop("_k").withColumn("sampled", F.coalesce("sampled", F.lit(False)))


class Calibrator:
    """A monotone map of scores: none, platt (a, b of a logistic curve) or isotonic (points); ``state`` is JSON."""

    def __init__(self, method: str, points: Sequence[tuple[float, float]] = (), a: float = 1.0, b: float = 0.0):
        self.method, self.points, self.a, self.b = method, [tuple(map(float, x)) for x in points], float(a), float(b)

    @classmethod
    def fit(cls, df: DataFrame, score: str, label: str, method: str = "auto", least_isotonic: int = 200) -> Calibrator:
        """From rows with a score and a label 0 or 1; nulls are left out. auto: isotonic from ``least_isotonic`` rows on, else platt.

        Scores are counted in BINS equal bins first, so what the fit sees has a bound; one class only gives none.
        """
        rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).where("s is not null and y is not null and not isnan(s)")
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
        if method == "none" or not seen["n"] or seen["ones"] in (0, seen["n"]):
            return cls("none")
        if method == "auto":
            method = "isotonic" if seen["n"] >= least_isotonic else "platt"
        bins = rows.groupBy(F.floor(F.least(F.greatest("s", F.lit(0.0)), F.lit(1.0)) * BINS).alias("bin"), "y").agg(F.avg("s").alias("s"), F.count(F.lit(1)).cast("double").alias("w"))
        if method == "isotonic":
            model = IsotonicRegression(featuresCol="s", labelCol="y", weightCol="w").fit(bins.coalesce(8))
            return cls("isotonic", zip(model.boundaries.toArray(), model.predictions.toArray()))
        data = VectorAssembler(inputCols=["s"], outputCol="x").transform(bins)
        model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=1e-6).fit(data)
        return cls("platt", a=model.coefficients[0], b=model.intercept)

    def transform(self, score: Column) -> Column:
        """The calibrated score in [0, 1]; null for null."""
        s = score.cast("double")
        if self.method == "platt":
            s = 1 / (1 + F.exp(-(self.a * s + self.b)))
        elif self.method == "isotonic" and self.points:
            xs, ys = (F.array(*[F.lit(p[k]) for p in self.points]) for k in (0, 1))
            below = F.size(F.filter(xs, lambda x: x <= s))  # points at or below the score
            x0, x1, y0, y1 = F.get(xs, below - 1), F.get(xs, below), F.get(ys, below - 1), F.get(ys, below)
            s = F.when(s.isNull(), None).when(below == 0, y1).when(below == len(self.points), y0).otherwise(y0 + F.try_divide((y1 - y0) * (s - x0), x1 - x0))
        return F.when(score.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))

    def state(self) -> str:
        return json.dumps({"method": self.method, "points": self.points, "a": self.a, "b": self.b})

    @classmethod
    def from_state(cls, state: str) -> Calibrator:
        return cls(**json.loads(state))


def bootstrap(df: DataFrame, measure: Column, key: str, draws: int = 200, alpha: float = 0.05, least: int = 10, seed: int = 0) -> dict[str, float]:
    """Value and percentile interval of an aggregate (a function of sums over the column ``w`` of weights).

    Each row gets a Poisson weight per draw from the hash of its key, so draws are one pass and one
    partial aggregation; fewer than ``least`` rows give no interval. measure must use F.col("w").
    """
    n = df.count()
    value = df.withColumn("w", F.lit(1.0)).agg(measure.alias("v")).first()["v"]
    if n < least:
        return {"value": value, "low": math.nan, "high": math.nan}
    u = (F.pmod(F.xxhash64(F.col(key), F.col("draw"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / F.lit(float(1 << 40))
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    weight = sum((F.when(u > s, 1.0).otherwise(0.0) for s in steps), F.lit(0.0))
    drawn = df.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight).groupBy("draw").agg(measure.alias("v"))
    low, high = drawn.where("v is not null").agg(F.percentile("v", F.lit(alpha / 2)), F.percentile("v", F.lit(1 - alpha / 2))).first()
    return {"value": value, "low": low, "high": high}


def already_scored(table: DataFrame, keys: Sequence[str], versions: Mapping[str, str], column: str = "model_versions") -> DataFrame:
    """The keys of rows whose map of model versions holds all of the wanted ones."""
    held = F.lit(True)
    for name, version in versions.items():
        held = held & F.coalesce(F.try_element_at(F.col(column), F.lit(name)) == version, F.lit(False))
    return table.where(held).select(*keys).distinct()
