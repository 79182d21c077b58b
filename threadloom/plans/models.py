"""Queries of graph communities, anomaly scores and streaming forms; SQL cannot express these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators.anomaly import isolation_scores
from threadloom.operators.coactivity import node_sums, user_communities
from threadloom.operators.graph import node_scores
from threadloom.plans.corpus import active_users
from threadloom.plans.texts import anomaly_features
from threadloom.session import Scratch
from threadloom.streaming.ingest import author_rollup, tail
from threadloom.tables import table


def co_activity_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_communities(active_users(spark, sf_dir))


def coordination(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = active_users(spark, sf_dir)
    nodes = Scratch(spark, "coordination").save(node_sums(users), "nodes")
    posts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.count(F.lit(1)).alias("n_posts"))
    by = nodes.select("node", (F.col("weight") / F.col("degree")).alias("w"), "degree")
    return node_scores(by, nodes.agg(F.max("heaviest").alias("w_max")), user_communities(users, nodes), posts)


def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = ["gap", "hour_distance", "author_posts", "log_chars", "n_urls", "self_duplicates"]
    return isolation_scores(anomaly_features(spark, sf_dir), "id", features)


def streamed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The author roll-up by a stream over the records, run until all files are read."""
    path = f"{sf_dir}/records.parquet"
    schema = spark.read.parquet(path).schema
    scratch = Scratch(spark, "stream")
    rows = author_rollup(tail(spark, f"{path}*", schema))
    out = f"{scratch.path}/rollup"
    query = rows.writeStream.outputMode("complete").foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    query.option("checkpointLocation", f"{scratch.path}/offsets").trigger(availableNow=True).start().awaitTermination()
    rolled = spark.read.parquet(out)
    return rolled.select("author_id", "post_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


QUERIES = {"co_activity_communities": co_activity_communities, "coordination": coordination, "anomaly_scores": anomaly_scores, "streamed_rollup": streamed_rollup}
ORACLES = {
    "streamed_rollup": "SELECT author_id, count(*) AS post_count, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us FROM records GROUP BY author_id",
}
