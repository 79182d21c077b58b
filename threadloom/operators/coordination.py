"""Coordination evidence from records: who shares addresses, hashtag sequences and parents at the same time.

Accounts that share a key within one time window are linked. Keys of up to ``most`` accounts give an
edge for each two of them; a key of more becomes a node of its own that all its accounts are linked
to, so that no key gives more edges than it has accounts and none is left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.graph import communities
from threadloom.operators.ranking import rank_within

#: Accounts of a key up to which each two are linked; accounts of a window.
MOST, WINDOW_US = 100, 3_600_000_000


def evidence_keys(records: DataFrame, window_us: int = WINDOW_US, least_tags: int = 2) -> DataFrame:
    """author_id, bucket, kind, key, us: each key of each record. Null authors and times, and deleted authors, have none.

    cotweet: an address or its domain; hashtag_seq: the hashtags in their order, from ``least_tags`` on;
    temporal: the parent that is answered.
    """
    each = lambda prefix, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.concat(F.lit(prefix), x))
    one = lambda kind, keys: F.transform(F.array_distinct(keys), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))
    tags = F.when(F.size("hashtags") >= least_tags, F.array(F.concat(F.lit("tags:"), F.array_join("hashtags", "|")))).otherwise(F.array().cast("array<string>"))
    parent = F.array_compact(F.array(F.concat(F.lit("parent:"), F.col("parent_id"))))
    keys = F.concat(one("cotweet", F.concat(each("url:", F.col("urls")), each("domain:", F.col("domains")))), one("hashtag_seq", tags), one("temporal", parent))
    known = records.where("author_id is not null and timestamp is not null and not endswith(author_id, ':__deleted__')")
    us = F.unix_micros("timestamp")
    return known.select("author_id", F.floor(us / window_us).cast("bigint").alias("bucket"), us.alias("us"), F.explode(keys).alias("k")).select("author_id", "bucket", "k.kind", "k.key", "us")


def record_edges(records: DataFrame, window_us: int = WINDOW_US, least_tags: int = 2, most: int = MOST) -> DataFrame:
    """src < dst, kind, observations, first_us: the windows and keys that link two accounts, or an account and a shared key's node."""
    seen = evidence_keys(records, window_us, least_tags).groupBy("kind", "key", "bucket", "author_id").agg(F.min("us").alias("us"))
    sizes = seen.groupBy("kind", "key", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = seen.join(sizes, ["kind", "key", "bucket"])
    few = shared.where(F.col("n") <= most)
    other = few.select("kind", "key", "bucket", F.col("author_id").alias("dst"), F.col("us").alias("us_b"))
    pairs = few.join(other, ["kind", "key", "bucket"]).where("author_id < dst").select(F.col("author_id").alias("src"), "dst", "kind", F.least("us", "us_b").alias("us"))
    hub = F.concat(F.lit("key:"), F.col("bucket").cast("string"), F.lit(":"), F.col("key"))
    stars = shared.where(F.col("n") > most).select(F.least("author_id", hub).alias("src"), F.greatest("author_id", hub).alias("dst"), "kind", "us")
    return pairs.unionByName(stars).groupBy("src", "dst", "kind").agg(F.count(F.lit(1)).alias("observations"), F.min("us").alias("first_us"))


def weighted(edges: DataFrame) -> DataFrame:
    """src, dst, weight over all kinds of evidence: the number of observations."""
    return edges.groupBy("src", "dst").agg(F.sum("observations").cast("double").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame) -> float | None:
    """Newman's modularity of a partition; null without edges."""
    a, b = (membership.select(F.col("node").alias(n), F.col("community").alias(f"c_{n}")) for n in ("src", "dst"))
    joined = edges.join(a, "src").join(b, "dst")
    ends = joined.select(F.col("c_src").alias("c"), "weight").unionByName(joined.select(F.col("c_dst").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("deg"))
    squares = ends.agg(F.sum(F.col("deg") * F.col("deg")).alias("s"))
    sums = joined.agg(F.sum("weight").alias("m"), F.sum(F.when(F.col("c_src") == F.col("c_dst"), F.col("weight")).otherwise(0.0)).alias("inside"))
    r = sums.join(F.broadcast(squares)).first()  # one row each
    return r["inside"] / r["m"] - r["s"] / (4 * r["m"] ** 2) if r["m"] else None


def shuffled_times(records: DataFrame, run: int, buckets: int = 64) -> DataFrame:
    """The records with the times of each author dealt out anew among the author's own records, by hash of the run.

    Ranks are counted in buckets of the hash, so that an author of any size is no single task.
    """
    times = rank_within(records.select("author_id", "timestamp", F.xxhash64("id").alias("_i")), ["author_id"], F.xxhash64("_i", F.lit(2 * run)), buckets, "_r")
    posts = rank_within(records.drop("timestamp"), ["author_id"], F.xxhash64("id", F.lit(2 * run + 1)), buckets, "_r")
    given = times.select(F.col("author_id").alias("_a"), F.col("_r").alias("_k"), "timestamp")
    return posts.join(given, posts["author_id"].eqNullSafe(given["_a"]) & (posts["_r"] == given["_k"])).drop("_r", "_a", "_k")


def null_model(records: DataFrame, runs: int = 5, **options) -> dict[str, float | bool | None]:
    """modularity of the records' graph, its mean and sample deviation over shuffled times, and whether it exceeds both together."""

    def measure(rows: DataFrame) -> float | None:
        edges = weighted(record_edges(rows, **options))
        return modularity(edges, communities(edges))

    value = measure(records)
    drawn = [x for x in (measure(shuffled_times(records, run)) for run in range(runs)) if x is not None]
    mean = sum(drawn) / len(drawn) if drawn else None
    spread = (sum((x - mean) ** 2 for x in drawn) / (len(drawn) - 1)) ** 0.5 if len(drawn) > 1 else 0.0
    return {"modularity": value, "null_mean": mean, "null_std": spread, "exceeds_null": value is not None and mean is not None and value > mean + spread}


def edge_kinds(edges: DataFrame) -> DataFrame:
    """kind, edges, observations, heaviest: how much evidence of each kind there is."""
    return edges.groupBy("kind").agg(F.count(F.lit(1)).alias("edges"), F.sum("observations").alias("observations"), F.max("observations").alias("heaviest"))


def tiers(records: DataFrame, authors: DataFrame) -> DataFrame:
    """tier, available: universal always; social_graph if any author has followers; threading if any record has a parent."""
    threading = records.agg(F.coalesce(F.max(F.col("parent_id").isNotNull()), F.lit(False)).alias("t"))
    social = authors.agg(F.coalesce(F.max(F.col("followers").isNotNull()), F.lit(False)).alias("s"))
    rows = threading.join(F.broadcast(social))  # one row each
    return rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("tier"), c.alias("available")) for n, c in (("universal", F.lit(True)), ("social_graph", F.col("s")), ("threading", F.col("t")))])).alias("x")).select("x.*")


def lifetime_posts(raw: Column) -> Column:
    """The first of the platforms' post counts in an author's payload; null where none is a number."""
    return reduce(lambda a, b: F.coalesce(a, b), [F.get_json_object(raw, f"$.{k}").try_cast("double") for k in ("statuses_count", "tweet_count", "post_count", "videoCount")])


def age_days(created: Column, now: Column) -> Column:
    """Days from one instant to another; null where negative."""
    days = (F.unix_micros(now) - F.unix_micros(created)) / 8.64e10
    return F.when(days >= 0, days)
