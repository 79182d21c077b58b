"""Narratives: groups of records with their measures, representatives and identity over time."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Narratives of one run whose identity is carried on the driver.
MOST_NARRATIVES = 20_000


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))


def centroids(members: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: the mean vector of each group scaled to length one; summed by position before the shuffle."""
    each = members.where(F.col(vector).isNotNull()).select(group, F.posexplode(vector).alias("at", "v"))
    means = each.groupBy(group, "at").agg(F.avg(F.col("v").cast("double")).alias("v"))
    rows = means.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("at", "v"))).alias("x")).select(group, F.transform("x", lambda e: e.v).alias("m"))  # one entry a dimension
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, v: s + v * v))
    return rows.select(group, F.transform("m", lambda v: F.coalesce(F.try_divide(v, length), v)).alias("centroid"))


def mint_id(centroid: Sequence[float]) -> str:
    """nar- and twelve hex digits of the digest of the centroid rounded to four places."""
    return "nar-" + hashlib.sha256(np.round(np.asarray(centroid, np.float64), 4).tobytes()).hexdigest()[:12]


def weighted_percentile(values: DataFrame, group: str, value: str, weight: str, share: float) -> DataFrame:
    """group, threshold: the value at ``share`` of the weight, linear between the midpoints of the values' weights.

    Null values and weights are left out; groups without weight give null. Equal values of a group are summed first.
    """
    v = values.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(group, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    by = W.partitionBy(group).orderBy("v")
    at = (F.sum("w").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("w") / 2) / F.sum("w").over(W.partitionBy(group))
    placed = v.withColumn("at", at).withColumn("v0", F.lag("v").over(by)).withColumn("at0", F.lag("at").over(by)).withColumn("last", F.lead("v").over(by).isNull())
    hit = F.when((F.col("at") >= share) & F.col("v0").isNull(), F.col("v")).when((F.col("at") >= share) & (F.col("at0") < share), F.col("v0") + F.try_divide((F.col("v") - F.col("v0")) * (share - F.col("at0")), F.col("at") - F.col("at0"))).when(F.col("last") & (F.col("at") < share), F.col("v"))
    return placed.groupBy(group).agg(F.max(hit).alias("threshold"))


def severity(members: DataFrame, group: str, value: str, weight: str, share: float = 0.75) -> DataFrame:
    """group, severity: the weighted mean of the values at or above the group's weighted percentile; null where none is measured."""
    levels = weighted_percentile(members, group, value, weight, share)
    top = members.where(F.col(value).isNotNull()).join(levels, group).where(F.col(value) >= F.col("threshold"))
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return members.select(group).distinct().join(top.groupBy(group).agg(mean.alias("severity")), group, "left")


def top_values(members: DataFrame, group: str, values: str, n: int = 10) -> DataFrame:
    """group, top: the n most frequent entries of an array column, by count and then name."""
    counts = members.select(group, F.explode(F.array_distinct(values)).alias("value")).groupBy(group, "value").agg(F.count(F.lit(1)).alias("k"))
    best = counts.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(F.desc("k"), "value"))).where(F.col("_n") <= n)
    return best.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", "value"))).alias("x")).select(group, F.transform("x", lambda e: e.value).alias("top"))


def narrative_rows(members: DataFrame, group: str = "narrative_id") -> DataFrame:
    """One row per group of records: size, authors, first and last time, platforms, top domains and hashtags, posts an hour."""
    base = members.groupBy(group).agg(F.count(F.lit(1)).alias("size"), F.countDistinct("author_id").alias("n_authors"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.sort_array(F.collect_set("source")).alias("platforms"))
    hours = F.greatest((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 3.6e9, F.lit(1.0))
    rows = base.withColumn("velocity", F.col("size") / hours)
    for name, column in (("top_domains", "domains"), ("top_hashtags", "hashtags")):
        rows = rows.join(top_values(members, group, column).withColumnRenamed("top", name), group, "left")
    return rows


def representatives(members: DataFrame, centers: DataFrame, group: str, vector: str, platform: str, key: str, n: int = 5) -> DataFrame:
    """group, key, rank: n members nearest to the centroid, the best of each platform before second ones; ties by key."""
    near = members.where(F.col(vector).isNotNull()).join(centers, group).withColumn("_s", F.round(cosine(F.col(vector), F.col("centroid")), 9))
    first = F.row_number().over(W.partitionBy(group, platform).orderBy(F.desc("_s"), key))
    kept = near.withColumn("_p", first).where(F.col("_p") <= n)  # at most n a platform reach the second window
    rank = F.row_number().over(W.partitionBy(group).orderBy((F.col("_p") > 1).cast("int"), F.desc("_s"), key))
    return kept.withColumn("rank", rank).where(F.col("rank") <= n).select(group, key, "rank")


def carry_ids(new: DataFrame, old: DataFrame, least: float = 0.85) -> DataFrame:
    """new_id, old_id, similarity: a one-to-one matching of centroids, best pairs first; ties by names.

    new, old: id, centroid: the narratives of two runs, a stated set of at most MOST_NARRATIVES each
    (more raise an error), so that their similar pairs are matched on the driver.
    """
    if max(new.count(), old.count()) > MOST_NARRATIVES:
        raise ValueError(f"more than {MOST_NARRATIVES} narratives")
    pairs = new.select(F.col("id").alias("new_id"), F.col("centroid").alias("x")).join(F.broadcast(old.select(F.col("id").alias("old_id"), F.col("centroid").alias("y"))), F.size("x") == F.size("y"))
    left = pairs.withColumn("similarity", F.round(cosine(F.col("x"), F.col("y")), 9)).where(F.col("similarity") >= least).select("new_id", "old_id", "similarity")
    rows = sorted(left.collect(), key=lambda r: (-r["similarity"], r["new_id"], r["old_id"]))
    used_new, used_old, out = set(), set(), []
    for r in rows:
        if r["new_id"] not in used_new and r["old_id"] not in used_old:
            used_new.add(r["new_id"])
            used_old.add(r["old_id"])
            out.append((r["new_id"], r["old_id"], r["similarity"]))
    return new.sparkSession.createDataFrame(out, "new_id string, old_id string, similarity double")


def label_of(text: Column, limit: int = 90) -> Column:
    """The first sentence without links, at most ``limit`` characters cut at a word, with an ellipsis where cut."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"https?://\S+", " "), r"\s+", " "))
    first = F.split(plain, r"(?<=[.!?])\s+")[0]
    cut = F.regexp_replace(F.substring(first, 1, limit - 1), r"\s+\S*$", "")
    return F.when(plain == "", "(untitled narrative)").when(F.length(first) <= limit, first).otherwise(F.concat(cut, F.lit("…")))


def prepared(text: Column, budget: int) -> Column:
    """struct(text, was_truncated): white space collapsed and cut to ``budget`` characters at a word's end."""
    plain = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    cut = F.regexp_replace(F.substring(plain, 1, budget), r"\s+\S*$", "")
    long = F.length(plain) > budget
    return F.struct(F.when(long, cut).otherwise(plain).alias("text"), long.alias("was_truncated"))


def members_touched(records: DataFrame, membership: DataFrame) -> DataFrame:
    """author_id, narratives: the sorted narratives that each author's records belong to."""
    joined = records.select("id", "author_id").distinct().join(membership.select(F.col("record_id").alias("id"), "narrative_id").distinct(), "id")
    return joined.groupBy("author_id").agg(F.sort_array(F.collect_set("narrative_id")).alias("narratives"))
