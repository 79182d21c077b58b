"""Splits that keep together the records of one author, article or account.

Keys are written unevenly and accounts move: written keys are linked to their normal form, normal
forms to those of the accounts moved to. Components of this graph come from parallel hooking and
shortcutting of a parent table; they get splits by subset sums over the multiplicities of their sizes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.subsets import closest
from threadloom.operators.ranking import rank_within
from threadloom.session import Scratch
from threadloom.tables import table

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
DELETED = "__deleted__"
BLANK = r"[\s\p{Z}\x{feff}\x{200b}]+"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}|{BLANK}$", "")


def _number(c: Column) -> Column:
    """The decimal text of a whole number without leading zeros or a zero fraction; other text as it is."""
    return F.when(c.rlike(r"^\d+(\.0*)?$"), F.coalesce(F.nullif(F.regexp_extract(c, r"^0*(\d*?)(?:\.0*)?$", 1), F.lit("")), F.lit("0"))).otherwise(c)


def normal_author(key: Column) -> Column:
    """source:name in one spelling; null for null and for the deleted author."""
    source = F.lower(_strip(F.substring_index(key, ":", 1)))
    name = _strip(key.substr(F.instr(key, ":") + 1, F.length(key)))
    name = F.when(source == "reddit", F.lower(F.regexp_replace(name, r"(?i)^/?(?:u|user)/", ""))).otherwise(name)
    name = F.when(source == "mastodon", _number(name)).otherwise(name)
    whole = F.when(F.instr(key, ":") > 0, F.concat(source, F.lit(":"), name)).otherwise(_strip(key))
    return F.when(~whole.endswith(DELETED), whole)


def normal_body(key: Column) -> Column:
    return F.nullif(_number(_strip(key)), F.lit(""))


def normal_user(key: Column) -> Column:
    return F.nullif(_number(F.regexp_replace(_strip(key), r"(?i)^u(?=\d)", "")), F.lit(""))


#: Each table's column that holds the key, and its normal form.
KEYS = (("records", "author_id", normal_author), ("train_stances", "body_id", normal_body), ("users", "id", normal_user))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """node, root: the smallest node of each connected component, for the nodes of the edges.

    Hooking: every root that sees a smaller root over an edge hooks to the smallest; shortcutting:
    every node then points to its parent's parent. Both are joins of the parent table; the edges
    shrink to those between different roots and the loop ends when none is left.
    Null ends and self-loops are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    pairs = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    live = scratch.save(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "live0")
    parent = live.select(F.col("a").alias("node")).unionByName(live.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node"))
    parent, step = scratch.save(parent, "parent0"), 0
    while not live.isEmpty():
        step += 1
        hooks = live.groupBy(F.col("b").alias("h")).agg(F.min("a").alias("to"))  # a < b: every hook leads to a smaller root
        up = scratch.save(parent.join(hooks, parent.root == hooks.h, "left").select("node", F.coalesce("to", "root").alias("root")), f"hooked{step}")
        while True:  # shortcut until all nodes point to roots
            other = up.select(F.col("node").alias("p"), F.col("root").alias("pp"))
            jumped = scratch.save(up.join(other, up.root == other.p).select("node", F.col("pp").alias("root"), (F.col("pp") != F.col("root")).alias("moved")), f"jump{uid(step)}")
            up = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        parent = up
        ends = up.select(F.col("node").alias("n"), "root")
        rooted = live.join(ends, live.a == ends.n).select(F.col("root").alias("ra"), "b").join(ends, F.col("b") == F.col("n")).select("ra", F.col("root").alias("rb"))
        live = scratch.save(rooted.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"live{step}")
    return parent


_count = iter(range(10**9))


def uid(step: int) -> str:
    return f"{step}-{next(_count)}"


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, key (as written), root, n_rows: one row per distinct written key that names something."""
    authors = table(spark, sf_dir, "authors")
    moved = F.from_json("raw", "moved struct<id:string,acct:string>").getField("moved")
    handles = authors.where("source = 'mastodon'").select(normal_author(F.col("author_id")).alias("owner"), F.lower(_strip(F.col("handle"))).alias("acct"))
    moves = authors.where(F.col("raw").contains("moved")).select(normal_author(F.col("author_id")).alias("a"), moved.alias("m")).where("m is not null")
    by_id = moves.where("m.id is not null").select("a", normal_author(F.concat(F.lit("mastodon:"), F.col("m.id"))).alias("b"))
    named = moves.where("m.id is null and m.acct is not null").select("a", F.lower(_strip(F.col("m.acct"))).alias("acct"))
    by_acct = named.join(handles.where("acct is not null").groupBy("acct").agg(F.min("owner").alias("b")), "acct").select("a", "b")
    parts = []
    for name, column, normal in KEYS:
        counted = table(spark, sf_dir, name).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
        parts.append(counted.select(F.lit(name).alias("table_name"), "key", normal(F.col("key")).alias("normal"), "n_rows"))
    keys = Scratch(spark, "spellings").save(reduce(lambda a, b: a.unionByName(b), parts).where("normal is not null"), "keys")
    # One graph: a written key hangs on its normal form, normal forms hang on those of accounts moved to.
    form = lambda name, c: F.concat(name, F.lit("="), c)
    written = lambda name, c: F.concat(name, F.lit("~"), c)
    spelled = keys.select(form(F.col("table_name"), F.col("normal")).alias("a"), written(F.col("table_name"), F.col("key")).alias("b"))
    moved_on = by_id.unionByName(by_acct).select(*[form(F.lit("records"), F.col(x)).alias(x) for x in "ab"])
    roots = components(spelled.unionByName(moved_on), "a", "b")
    return keys.withColumn("node", written(F.col("table_name"), F.col("key"))).join(roots, "node").select("table_name", "key", "root", "n_rows")


def same_split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, key_a, key_b: different spellings (also of moved accounts) that must share a split."""
    keys = spellings(spark, sf_dir).select("table_name", "root", "key")
    other = keys.select("table_name", "root", F.col("key").alias("key_b"))
    return keys.join(other, ["table_name", "root"]).where("key < key_b").select("table_name", F.col("key").alias("key_a"), "key_b")


def subset_sum_plan(sizes: dict[int, int], shares: tuple[float, ...] = SHARES) -> list[dict[int, int]]:
    """How many components of each size go to each split so that the totals come closest to the shares.

    All splits but the largest are filled one after the other: a proportional part of every size
    first, so that each split gets components of all sizes; the bitset of reachable totals then
    covers what is left to reach. The largest share takes the rest.
    """
    total = sum(s * c for s, c in sizes.items())
    left = dict(sizes)
    order = sorted(range(len(shares)), key=lambda k: shares[k])
    plan: list[dict[int, int]] = [{} for _ in shares]
    for at, k in enumerate(order[:-1]):
        part = shares[k] / sum(shares[j] for j in order[at:])
        take = {s: n for s, c in left.items() if (n := int(c * part))}
        rest = round(shares[k] * total) - sum(s * n for s, n in take.items())
        for s in sorted(take):  # rounding of an earlier split may leave too much
            while rest < 0 and take[s]:
                take[s] -= 1
                rest += s
        for s, n in closest({s: c - take.get(s, 0) for s, c in left.items()}, rest).items():
            take[s] = take.get(s, 0) + n
        plan[k] = {s: n for s, n in take.items() if n}
        left = {s: c - take.get(s, 0) for s, c in left.items() if c - take.get(s, 0)}
    plan[order[-1]] = left
    return plan


def assign_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, key (as written), split, n_rows; every row's split follows from its written key.

    Rows without a key, or of the deleted author, are nobody's group and not in this table:
    ``keyless_rows`` deals them out one by one. Each table is split on its own, so its three parts come as near
    80/10/10 as its component sizes allow.
    """
    keys = Scratch(spark, "splits").save(spellings(spark, sf_dir), "keys")
    comps = keys.groupBy("table_name", "root").agg(F.sum("n_rows").alias("size"))
    histogram = comps.groupBy("table_name", "size").agg(F.count(F.lit(1)).alias("n")).collect()  # distinct sizes: at most the root of twice the rows
    plans = []
    for name in ("records", "train_stances", "users"):
        sizes = {r["size"]: r["n"] for r in histogram if r["table_name"] == name}
        plan = subset_sum_plan(sizes)
        for s, c in sizes.items():
            at = 0
            for k, split in enumerate(SPLITS):
                if n := plan[k].get(s, 0):
                    plans.append((name, s, at, at + n, split))
                    at += n
    ranges = spark.createDataFrame(plans, "p_table string, p_size bigint, low bigint, high bigint, split string")
    buckets = max(1, sum(r["n"] for r in histogram) // 50_000)
    ranked = rank_within(comps, ["table_name", "size"], F.xxhash64("root", F.lit(7)), buckets)
    chosen = ranked.join(ranges, (F.col("table_name") == F.col("p_table")) & (F.col("size") == F.col("p_size")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return keys.join(chosen.select("table_name", "root", "split"), ["table_name", "root"]).select("table_name", "key", "split", "n_rows")


def split_of_row(row_id: Column) -> Column:
    """The split of a row that belongs to no group."""
    x = F.pmod(F.xxhash64(row_id, F.lit(7)), F.lit(10))
    return F.when(x == 8, "validation").when(x == 9, "test").otherwise("train")


def _rows(spark: SparkSession, sf_dir: str, name: str, column: str) -> DataFrame:
    """table_name, row_id, key of every row; row_id is the id, or a hash of the whole row where there is none."""
    rows = table(spark, sf_dir, name)
    whole = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    row_id = F.coalesce(F.col("id"), whole) if "id" in rows.columns else whole
    return rows.select(F.lit(name).alias("table_name"), row_id.alias("row_id"), F.col(column).alias("key"))


def keyless_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, key, split of every row without a key or of the deleted author; equal rows share a split."""
    parts = [_rows(spark, sf_dir, name, column).where(normal(F.col("key")).isNull()) for name, column, normal in KEYS]
    return reduce(lambda a, b: a.unionByName(b), parts).withColumn("split", split_of_row(F.col("row_id")))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, key, split, n_rows: the number of rows of each written key in its split."""
    grouped = assign_splits(spark, sf_dir)
    dealt = keyless_rows(spark, sf_dir).groupBy("table_name", "key", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    return grouped.unionByName(dealt)


def row_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, key, split: the split of every single row of the three tables."""
    keyed = reduce(lambda a, b: a.unionByName(b), [_rows(spark, sf_dir, name, column).where(normal(F.col("key")).isNotNull()) for name, column, normal in KEYS])
    grouped = assign_splits(spark, sf_dir).select("table_name", "key", "split")
    return keyed.join(grouped, ["table_name", "key"]).select("table_name", "row_id", "key", "split").unionByName(keyless_rows(spark, sf_dir))
