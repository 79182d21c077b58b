"""Queries of the general problems 4 and 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.hierarchy import descendants, hierarchy
from threadloom.operators.timestamps import components, first_per_row
from threadloom.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy(table(spark, sf_dir, "records"))
    return rows.where(F.col("parent_id").isNotNull()).select("id", "root_id", "depth")


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hierarchy(table(spark, sf_dir, "records"), paths=True)
    return rows.select("id", "root_id", "depth", F.array_join("path", ">").alias("path"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(table(spark, sf_dir, "records"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = table(spark, sf_dir, "feed_zones").groupBy("feed").agg(F.min("tz_name").alias("tz_name"), F.min("date_order").alias("date_order"))
    def source(name: str, row_id: str, value: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), F.col(value).alias("value"), *[F.col("feed")] * (name == "news_rss_entries"))

    value = F.col("value")
    news = source("news_rss_entries", "id", "published").join(zones, "feed", "left")
    parts = [
        components(source("reddit_convokit_utterances", "id", "timestamp"), value, unix=True),
        components(news, value, True, F.col("tz_name"), F.col("date_order")),
        components(source("youtube_items", "id", "snippet.publishedAt"), value),
        components(source("gdelt_gkg_rows", "gkgrecordid", "date"), value),
    ]
    return first_per_row([p.select("table_name", "row_id", "_t_parts", "_t_zone", "_t_order") for p in parts])


QUERIES = {"p4_found": p4_found, "p4_paths": p4_paths, "p4_descendants": p4_descendants, "p5_found": p5_found}

_P4 = """
WITH RECURSIVE n AS (SELECT id, min(parent_id) AS p FROM records WHERE id IS NOT NULL GROUP BY id),
t AS (
  SELECT id, id AS root, 0 AS depth, id AS path FROM n WHERE p IS NULL OR p NOT IN (SELECT id FROM n)
  UNION ALL
  SELECT n.id, t.root, t.depth + 1, t.path || '>' || n.id FROM n JOIN t ON n.p = t.id
),
c AS (SELECT id, p FROM n WHERE id NOT IN (SELECT id FROM t)),
reach(s, x) AS (SELECT id, p FROM c UNION SELECT reach.s, c.p FROM reach JOIN c ON reach.x = c.id),
lp AS (SELECT s AS id FROM reach WHERE s = x),
cyc AS (SELECT reach.s AS id, min(reach.x) AS root FROM reach WHERE reach.x IN (SELECT id FROM lp) GROUP BY reach.s),
a AS (SELECT id, root, depth, path FROM t UNION ALL SELECT id, root, -1, NULL FROM cyc)
"""

ORACLES = {
    "p4_found": _P4 + "SELECT a.id, a.root AS root_id, CAST(a.depth AS INTEGER) AS depth FROM a JOIN n ON a.id = n.id WHERE n.p IS NOT NULL",
    "p4_paths": _P4 + "SELECT id, root AS root_id, CAST(depth AS INTEGER) AS depth, path FROM a",
    "p4_descendants": _P4
    + """, up AS (
  SELECT t.id, n.p AS anc, 1 AS d, t.depth FROM t JOIN n ON n.id = t.id WHERE t.depth > 0
), walk AS (SELECT id, anc, d, depth FROM up UNION ALL SELECT w.id, n.p, w.d + 1, w.depth FROM walk w JOIN n ON n.id = w.anc WHERE w.d < w.depth)
SELECT anc AS ancestor_id, id, CAST(d AS INTEGER) AS distance FROM walk""",
}
