"""Communities and scores of co-activity graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch


def communities(edges: DataFrame, rounds: int = 40, levels: int = 12) -> DataFrame:
    """node, community: Louvain over an edge table src, dst, weight, in rounds of parallel moves.

    In a round every node of a lot that is drawn anew joins the neighbouring community with the
    greatest gain in modularity, ties to the smallest hash; a level ends when two rounds in a row
    (the lot and its complement) move no node. Its communities then become the nodes of the next level, until a
    level moves none. ``rounds`` and ``levels`` are a guard against endless swaps and far above what
    graphs need. Null ends and self-loops are ignored; no edges give no communities. All state stays
    in tables; a community's weight is joined, not collected. Communities are named by their smallest node.
    """
    scratch = Scratch(edges.sparkSession, "communities")
    one = edges.select("src", "dst", "weight").where("src is not null and dst is not null and src <> dst and weight > 0")
    both = scratch.save(one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("w")), "both0")
    nodes = scratch.save(both.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("deg")), "nodes0")
    m2 = nodes.agg(F.sum("deg")).first()[0]
    members = nodes.select("node", F.col("node").alias("community"))
    if not m2:
        return members
    return merged(scratch, members, both, nodes, m2, rounds, 0, levels)


def merged(scratch: Scratch, members: DataFrame, both: DataFrame, nodes: DataFrame, m2: float, rounds: int = 40, first: int = 0, levels: int = 12) -> DataFrame:
    """members (node, community) after the levels from ``first`` on, whose nodes are the communities.

    both: src, dst, w in both directions. nodes: node, deg. m2: the sum of all degrees.
    """
    for level in range(first, levels):
        state, moved = _moves(scratch, both, nodes, m2, rounds, level)
        if not moved:
            break
        names = state.groupBy("community").agg(F.min("node").alias("name"))
        to = scratch.save(state.join(names, "community").select("node", "deg", F.col("name").alias("to")), f"to{level}")
        members = scratch.save(members.join(to.select(F.col("node").alias("community"), "to"), "community").select("node", F.col("to").alias("community")), f"members{level}")
        ends = to.select("node", "to")
        both = both.join(ends.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(ends.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst").where("a <> b")
        both = scratch.save(both.groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")), f"both{level + 1}")
        nodes = scratch.save(to.groupBy(F.col("to").alias("node")).agg(F.sum("deg").alias("deg")), f"nodes{level + 1}")
    return members


def _moves(scratch: Scratch, both: DataFrame, nodes: DataFrame, m2: float, rounds: int, level: int) -> tuple[DataFrame, bool]:
    """node, deg, community after the moves of one level, and whether any node moved."""
    state = nodes.select("node", "deg", F.col("node").alias("community"))
    moved, still = False, 0
    for r in range(rounds):
        totals = state.groupBy("community").agg(F.sum("deg").alias("tot"))
        near = both.join(state.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("w").alias("to"))
        own = state.select("node", "deg", F.col("community").alias("old"))
        stay = own.select("node", F.col("old").alias("community"), F.lit(0.0).alias("to"))  # a node may have no neighbour in its own community
        options = near.unionByName(stay).groupBy("node", "community").agg(F.sum("to").alias("to")).join(own, "node").join(totals, "community")
        # A node's own degree does not count towards the community that it weighs.
        tot = F.col("tot") - F.when(F.col("community") == F.col("old"), F.col("deg")).otherwise(0)
        gain = F.round(F.col("to") - F.col("deg") * tot / F.lit(m2), 9)
        best = options.withColumn("gain", gain).groupBy("node").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("old")).cast("int"), -F.xxhash64("community"))).alias("best"))
        turn = F.pmod(F.xxhash64("node", F.lit(r // 2)), F.lit(2)) == r % 2
        next_ = state.join(best, "node").select("node", "deg", "community", F.when(turn, F.col("best")).otherwise(F.col("community")).alias("next"))
        next_ = scratch.save(next_, f"state{level}-{r}")
        still = still + 1 if next_.where("next <> community").isEmpty() else 0
        moved |= not still
        state = next_.select("node", "deg", F.col("next").alias("community"))
        if r:
            scratch.drop(f"state{level}-{r - 1}")
        if still == 2:
            break
    return state, moved


def coordination_scores(edges: DataFrame, membership: DataFrame, posts: DataFrame) -> DataFrame:
    """node, community, score in [0, 1]: mean of community size, edge weight and participation terms.

    membership: node, community. posts: node, n_posts; a node without posts takes part fully.
    """
    ends = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    by = ends.groupBy("node").agg(F.avg("weight").alias("w"), F.count(F.lit(1)).alias("degree"))
    return node_scores(by, edges.agg(F.max("weight").alias("w_max")), membership, posts)


def node_scores(by: DataFrame, top: DataFrame, membership: DataFrame, posts: DataFrame) -> DataFrame:
    """coordination_scores from each node's mean weight w and degree, and the one row w_max."""
    sizes = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.agg(F.max("size").alias("size_max"))
    joined = by.join(membership, "node").join(sizes, "community").join(posts, "node", "left").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(largest))
    part = F.least(F.lit(1.0), F.col("degree") / F.greatest(F.coalesce("n_posts", F.lit(1)), F.lit(1)))
    score = (F.log(1.0 + F.col("size")) / F.log(1.0 + F.col("size_max")) + F.col("w") / F.col("w_max") + part) / 3
    return joined.select("node", "community", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 5).alias("score"))
