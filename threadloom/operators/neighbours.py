"""Near neighbours of 64-bit similarity hashes, and what is left when each gives way to the first of its kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import hamming
from threadloom.session import Scratch


def hash_pairs(values: DataFrame, column: str, distance: int = 3, prefix_bits: int = 0) -> DataFrame:
    """a < b, distance: the pairs of different hashes that differ in at most ``distance`` bits and share their first ``prefix_bits``.

    Of distance + 1 blocks of the other bits one is equal, so that each hash meets only those of the
    same block; a pair is given by the first block that it shares. Null and 0 (no words) have no
    pairs; copies of a hash are one.
    """
    blocks, bits = distance + 1, 64 - prefix_bits
    edges = [bits * k // blocks for k in range(blocks + 1)]
    one = values.select(F.col(column).alias("a")).where("a is not null and a <> 0").distinct()
    part = lambda c, k: F.shiftrightunsigned(c, edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1))
    prefix = F.shiftrightunsigned("a", bits) if prefix_bits else F.lit(0)
    keyed = one.select("a", prefix.alias("p"), F.posexplode(F.array(*[part(F.col("a"), k) for k in range(blocks)])).alias("k", "v"))
    other = keyed.select(F.col("a").alias("b"), "p", "k", "v")
    d = hamming(F.col("a"), F.col("b")).cast("int")
    near = keyed.join(other, ["p", "k", "v"]).where((F.col("a") < F.col("b")) & (d <= distance))
    earlier = F.greatest(*[F.when((F.col("k") > k) & (part(F.col("a"), k) == part(F.col("b"), k)), 1).otherwise(0) for k in range(blocks)])
    return near.where(earlier == 0).select("a", "b", d.alias("distance"))


def first_of_kind(records: DataFrame, key: str = "id", column: str = "simhash", distance: int = 3, prefix_bits: int = 16) -> DataFrame:
    """key, representative: in the order of the key, each record joins the first representative near its hash, or becomes one.

    Rounds over the graph of hashes: a hash without an undecided or standing neighbour before it
    stands; one with a standing neighbour before it falls. Equal hashes are one node named by their
    first key, so a group of copies is no hot spot. Records without hash, or with hash 0, stand for
    themselves; null keys are left out; repeated keys count with their least hash.
    """
    scratch = Scratch(records.sparkSession, "firsts")
    rows = scratch.save(records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.when(F.col(column) != 0, F.col(column))).alias("h")), "rows")
    names = rows.where("h is not null").groupBy("h").agg(F.min("key").alias("name"))
    named = lambda c, n: names.select(F.col("h").alias(c), F.col("name").alias(n))
    pairs = hash_pairs(rows, "h", distance, prefix_bits).join(named("a", "x"), "a").join(named("b", "y"), "b")
    edges = scratch.save(pairs.select(F.least("x", "y").alias("before"), F.greatest("x", "y").alias("after")), "edges")
    live, fallen, step = edges, None, 0
    while not live.isEmpty():
        standing = live.select(F.col("before").alias("s")).distinct().join(live.select(F.col("after").alias("s")).distinct(), "s", "left_anti")
        falls = live.join(standing.withColumnRenamed("s", "before"), "before").groupBy("after").agg(F.min("before").alias("rep"))
        falls = scratch.save(falls, f"falls{step}")
        fallen = falls if fallen is None else fallen.unionByName(falls)
        gone = falls.select(F.col("after").alias("g"))
        rest = live.join(gone.withColumnRenamed("g", "after"), "after", "left_anti").join(gone.withColumnRenamed("g", "before"), "before", "left_anti")
        live, step = scratch.save(rest.select("before", "after"), f"live{step}"), step + 1
    by_hash = rows.join(names, "h", "left")
    if fallen is None:
        return by_hash.select(F.col("key").alias(key), F.coalesce("name", "key").alias("representative"))
    # A hash falls to the first of all standing ones near it, also those found to stand in later rounds.
    firsts = scratch.save(edges.join(fallen.select(F.col("after").alias("before")).distinct(), "before", "left_anti").groupBy("after").agg(F.min("before").alias("rep")), "firsts")
    return by_hash.join(firsts, by_hash["name"] == firsts["after"], "left").select(F.col("key").alias(key), F.coalesce("rep", "name", "key").alias("representative"))
