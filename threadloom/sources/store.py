"""The corpus on disk and keyed, idempotent upserts of scored tables.

The corpus is Parquet under ``source=/date=`` folders. A scored table has keys, a closed schema and
volatile columns that do not count as content. Writing the same content again touches no file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ScoredTable:
    name: str
    schema: T.StructType
    keys: tuple[str, ...]
    volatile: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    foreign_key: str | None = None
    options: dict = field(default_factory=dict)


def write_records(df: DataFrame, root: str) -> dict[str, int]:
    """Append the records whose id the corpus lacks; the first of a batch's copies counts.

    Returns written and duplicates. An id is looked for in the whole corpus, so that a record
    whose time moved is not stored twice.
    """
    spark = df.sparkSession
    total = df.count()
    first = W.partitionBy("id").orderBy("ingested_at", "timestamp")
    new = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").withColumn("date", F.date_format("timestamp", "yyyy-MM-dd"))
    if exists(spark, root):  # of the corpus only the id column is read
        new = new.join(spark.read.parquet(root).select("id"), "id", "left_anti")
    new = new.persist()
    written = new.count()
    if written:
        new.write.mode("append").partitionBy("source", "date").option("compression", "zstd").parquet(root)
    new.unpersist()
    return {"written": written, "duplicates": total - written}


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_records(spark: SparkSession, root: str, sources: Sequence[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame | None:
    """The corpus, filtered by source and date folders (inclusive); None where there is none.

    Duplicate ids keep the earliest date. A limit takes the first ids over all sources.
    """
    if not exists(spark, root):
        return None
    df = spark.read.parquet(root)
    if sources:
        df = df.where(F.col("source").isin(list(sources)))
    if start:
        df = df.where(F.col("date") >= start)
    if end:
        df = df.where(F.col("date") <= end)
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("date", "ingested_at"))).where("_n = 1").drop("_n")
    return df.orderBy("id").limit(limit) if limit else df


def conform(df: DataFrame, contract: ScoredTable) -> DataFrame:
    """The contract's columns in order and type: unknown columns raise, missing ones are null, NaN is null."""
    extra = set(df.columns) - set(contract.schema.names)
    if extra:
        raise ValueError(f"{contract.name}: unexpected columns {sorted(extra)}")
    out = []
    for f in contract.schema:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in df.columns and isinstance(df.schema[f.name].dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def content(columns: Sequence[str], schema: T.StructType, side: str):
    """Hash of the columns' values; floats count at storage precision, maps without their order."""
    parts = []
    for c in sorted(columns):
        col = F.col(f"{side}.{c}")
        if isinstance(schema[c].dataType, T.MapType):
            col = F.array_sort(F.map_entries(col))
        elif isinstance(schema[c].dataType, T.DoubleType):
            col = col.cast("float")
        parts.append(col.alias(c))
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def merge_status(old: DataFrame, new: DataFrame, keys: Sequence[str], volatile: Sequence[str] = (), merge: bool = True) -> DataFrame:
    """old joined with new by key, with status written, updated, unchanged, and kept (or dropped unless merge).

    merge: only the columns that new has replace old ones, also by null. Null keys match each other.
    """
    compared = [c for c in new.columns if c not in keys and c not in volatile]
    o, n = old.withColumn("_old", F.lit(True)).alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    on = None
    for k in keys:
        same = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        on = same if on is None else on & same
    joined = o.join(n, on, "full")
    equal = content(compared, old.schema, "o") == content(compared, new.schema, "n") if compared else F.lit(True)
    status = F.when(F.col("o._old").isNull(), "written").when(F.col("n._new").isNull(), "kept" if merge else "dropped").when(equal, "unchanged").otherwise("updated")
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c))
        elif c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        else:
            use_new = F.col("n._new") & (F.lit(True) if c not in volatile else (status != "unchanged"))
            out.append(F.when(use_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*out, status.alias("status"))


def assert_joinable(df: DataFrame, known: DataFrame, key: str) -> None:
    """Raise if a key of df is not among the known ones."""
    lost = [r[0] for r in df.select(key).join(known.select(key), key, "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"keys without a parent row: {lost}")


def upsert(spark: SparkSession, root: str, contract: ScoredTable, new: DataFrame, merge: bool = True, known: DataFrame | None = None) -> dict[str, int]:
    """Write new rows by key; returns written, updated, unchanged, kept, dropped.

    Nothing is written when no row changed. Else the whole table goes to a folder of its own, which
    then takes the old one's place.
    """
    given = [c for c in contract.schema.names if c in new.columns]
    fresh = conform(new, contract).select(*given)
    if known is not None and contract.foreign_key:
        assert_joinable(fresh, known, contract.foreign_key)
    path = f"{root}/{contract.name}"
    old = spark.read.schema(contract.schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], contract.schema)
    status = merge_status(old, fresh, contract.keys, contract.volatile, merge).persist()
    counts = {r["status"]: r["n"] for r in status.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    result = {k: counts.get(k, 0) for k in ("written", "updated", "unchanged", "kept", "dropped")}
    if result["written"] + result["updated"] + result["dropped"]:
        writer = status.where("status <> 'dropped'").drop("status").sortWithinPartitions(*contract.keys).write.mode("overwrite").option("compression", "zstd")
        (writer.partitionBy(*contract.partition_by) if contract.partition_by else writer).parquet(f"{path}.new")
        jvm = spark.sparkContext._jvm
        target, staged = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.new")
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(target, True)
        fs.rename(staged, target)
    status.unpersist()
    return result
