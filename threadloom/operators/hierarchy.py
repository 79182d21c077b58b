"""Parent-child links to full hierarchies: root, depth, path, descendants and loops.

The nodes that somebody names as parent form the inner graph; all others hang on it by one
join. In the inner graph a deterministic hash makes one node in ``SPLITTER_EVERY`` a splitter.
Every node walks to its next splitter or root (walks are shortened by pointer doubling), the
graph of splitters alone is solved, and its solution is expanded to the nodes between. Walks onto
loops without a splitter never end and are solved on their own; splitters among them are ends of
the graph of splitters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.session import Scratch

#: One inner node in so many is a splitter.
SPLITTER_EVERY = 8
OPEN, AT_SPLITTER, AT_ROOT = 0, 1, 2


def _is_splitter(name: Column) -> Column:
    return F.pmod(F.xxhash64(name, F.lit("splitter")), F.lit(SPLITTER_EVERY)) == 0


def _chase(scratch: Scratch, label: str, state: DataFrame, kind: int, trail: bool) -> DataFrame:
    """Double the pointers of the rows of ``kind`` until all have ended or must be on a loop.

    state: id, up, dist, low (smallest id from id to before up), kind[, trail]. A row ends when
    the row it points to has ended. Round r ends the rows that lie 2^(r-1) to 2^r steps before
    an end, so once a round ends none, all others lie on loops or below. When these have walked
    as many steps as they are, their pointers lie on the loops and low has seen all of one.
    """
    rounds, before = 0, -1
    first = scratch.save(state, f"{label}-step0")
    live, ended = first.where(F.col("kind") == kind), [first.where(F.col("kind") != kind)]
    while (n := live.count()) and not (n == before and 2**rounds >= n):
        before = n
        target = live
        for part in ended:
            target = target.unionByName(part)
        target = target.select(*[F.col(c).alias(f"t_{c}") for c in target.columns])
        step = live.join(target, F.col("up") == F.col("t_id")).select(
            "id",
            F.col("t_up").alias("up"),
            (F.col("dist") + F.col("t_dist")).alias("dist"),
            F.least("low", "t_low").alias("low"),
            F.col("t_kind").alias("kind"),
            *([F.concat("trail", "t_trail").alias("trail")] if trail else []),
        )
        rounds += 1
        new = scratch.save(step, f"{label}-step{rounds}")
        ended.append(new.where(F.col("kind") != kind))
        live = new.where(F.col("kind") == kind)
    out = live
    for part in ended:
        out = out.unionByName(part)
    return out


def _loops(rows: DataFrame, state: DataFrame) -> DataFrame:
    """id, root: for rows whose pointer lies on a loop, the smallest id on that loop."""
    there = state.select(F.col("id").alias("t_id"), F.col("low").alias("root"))
    return rows.join(there, F.col("up") == F.col("t_id")).select("id", "root")


def _solve_inner(scratch: Scratch, inner: DataFrame, trail: bool = False) -> DataFrame:
    """id, root, depth[, trail]: trail lists the ids from the node up to, not including, its root."""
    start = inner.select(
        "id",
        F.coalesce("up", "id").alias("up"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
        F.col("id").alias("low"),
        F.when(F.col("up").isNull(), AT_ROOT).when(_is_splitter(F.col("up")), AT_SPLITTER).otherwise(OPEN).alias("kind"),
        *([F.when(F.col("up").isNull(), F.array().cast("array<string>")).otherwise(F.array("id")).alias("trail")] if trail else []),
    )
    walked = scratch.save(_chase(scratch, f"walk{int(trail)}", start, OPEN, trail), f"walked{int(trail)}")
    # Rows whose walk never ends; splitters among them end the reduced graph, with the loop's root as pointer.
    endless = scratch.save(_loops(walked.where(F.col("kind") == OPEN), walked), f"endless{int(trail)}")
    stuck = walked.where(_is_splitter(F.col("id")) & (F.col("kind") == OPEN)).drop("up").join(endless.withColumnRenamed("root", "up"), "id")
    reduced = walked.where(_is_splitter(F.col("id")) & (F.col("kind") != OPEN)).unionByName(stuck)
    solved = scratch.save(_chase(scratch, f"reduced{int(trail)}", reduced, AT_SPLITTER, trail), f"solved{int(trail)}")
    extra = ["trail"] if trail else []
    at_root = solved.where(F.col("kind") == AT_ROOT).select("id", F.col("up").alias("root"), F.col("dist").alias("depth"), *extra)
    below = solved.where(F.col("kind") == OPEN).select("id", F.col("up").alias("root"))
    on_loop = _loops(solved.where(F.col("kind") == AT_SPLITTER), solved).unionByName(below).withColumn("depth", F.lit(-1).cast("bigint"))
    if trail:
        on_loop = on_loop.withColumn("trail", F.lit(None).cast("array<string>"))
    splitters = at_root.unionByName(on_loop)
    rest = walked.where(~_is_splitter(F.col("id")))
    direct = rest.where(F.col("kind") == AT_ROOT).select("id", F.col("up").alias("root"), F.col("dist").alias("depth"), *extra)
    reach = splitters.select(*[F.col(c).alias(f"s_{c}") for c in splitters.columns])
    between = (
        rest.where(F.col("kind") == AT_SPLITTER)
        .join(reach, F.col("up") == F.col("s_id"))
        .select(
            "id",
            F.col("s_root").alias("root"),
            F.when(F.col("s_depth") < 0, F.col("s_depth")).otherwise(F.col("dist") + F.col("s_depth")).alias("depth"),
            *([F.concat("trail", "s_trail").alias("trail")] if trail else []),
        )
    )
    splitterless = endless.where(~_is_splitter(F.col("id"))).withColumn("depth", F.lit(-1).cast("bigint"))
    if trail:
        splitterless = splitterless.withColumn("trail", F.lit(None).cast("array<string>"))
    return splitters.unionByName(direct).unionByName(between).unionByName(splitterless)


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", paths: bool = False) -> DataFrame:
    """id, parent_id, root_id, depth[, path]: one row per distinct non-null id.

    - A node without parent, or whose parent is not among the ids, is a root of depth 0.
    - On a loop or below one, root_id is the smallest id on that loop, depth -1 and path null.
    - Repeated ids count once; if copies name different parents, the smallest non-null one holds.
    - path runs from the root to the node, both included. Ids compare by code point.
    - Rows with a null id are left out; other columns, of whatever names, are not read;
      an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession, "hierarchy")
    nodes = scratch.save(
        df.select(F.col(id_col).cast("string").alias("id"), F.col(parent_col).cast("string").alias("parent"))
        .where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("parent").alias("parent")),
        "nodes",
    )
    named = nodes.where(F.col("parent").isNotNull()).select(F.col("parent").alias("id")).distinct()
    inner = scratch.save(nodes.join(named, "id", "left_semi"), "inner")
    known = inner.select(F.col("id").alias("up"))
    linked = scratch.save(inner.join(known, inner.parent == known.up, "left").select("id", "up"), "linked")
    solved = scratch.save(_solve_inner(scratch, linked), "inner-solved")
    above = solved.select(F.col("id").alias("p_id"), "root", "depth")
    if paths:
        tree = linked.join(solved.where(F.col("depth") >= 0).select("id"), "id", "left_semi")
        trails = scratch.save(_solve_inner(scratch, tree, trail=True).select("id", "trail"), "trails")
        above = above.join(trails.withColumnRenamed("id", "p_id"), "p_id", "left")
    hung = nodes.join(above, nodes.parent == above.p_id, "left")
    path = F.when(F.col("p_id").isNull(), F.array("id")).when(
        F.col("depth") >= 0, F.concat(F.array("root"), F.reverse("trail"), F.array("id"))
    )
    return hung.select(
        "id",
        F.col("parent").alias("parent_id"),
        F.coalesce("root", "id").alias("root_id"),
        F.when(F.col("p_id").isNull(), 0).when(F.col("depth") < 0, -1).otherwise(F.col("depth") + 1).cast("int").alias("depth"),
        *([path.alias("path")] if paths else []),
    )


def descendants(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """ancestor_id, id, distance: one row for each node below another, outside loops.

    The descendants are rows, not arrays, so that a root above a third of all nodes stays spread.
    """
    tree = hierarchy(df, id_col, parent_col, paths=True).where(F.col("depth") > 0)
    pairs = tree.select("id", "depth", F.posexplode("path").alias("pos", "ancestor_id"))
    return pairs.where(F.col("pos") < F.col("depth")).select("ancestor_id", "id", (F.col("depth") - F.col("pos")).cast("int").alias("distance"))
