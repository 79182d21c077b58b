"""Evaluation and narrative operators over the project's tables, with their SQL.

A narrative here is a ``source_detail`` of the records: where posts of one place come together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import similarity_hash
from threadloom.operators import coordination as C
from threadloom.operators import evaluation as E
from threadloom.operators import narratives as N
from threadloom.operators.neighbours import first_of_kind, hash_pairs
from threadloom.plans.corpus import latest
from threadloom.sources.files import consistent_claims
from threadloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_R = "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, timestamp) AS _n FROM records) WHERE _n = 1)\n"
_MEASURED = ("lang", "parent_id", "conversation_id", "simhash", "author_handle")


@query("SELECT stance AS label, count(*) AS n, round(count(*) / (SELECT count(*) FROM train_stances), 6) AS share, count(DISTINCT body_id) AS groups FROM train_stances GROUP BY stance")
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_summary(table(spark, sf_dir, "train_stances"), "stance", "body_id")


@query("SELECT source, CASE WHEN source IN ('toots', 'newsletters') THEN 'test' ELSE 'other' END AS part, count(*) AS n FROM documents GROUP BY ALL")
def holdout_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that a domain holdout puts into the test set, and the rest."""
    d = table(spark, sf_dir, "documents")
    d = E.domain_holdout(d, "source", ["toots", "newsletters"], "outlet")
    return d.groupBy("source", F.when(F.col("split") == "test", "test").otherwise("other").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query()
def stance_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bodies and stances of five folds that keep the rows of a body together."""
    folds = E.grouped_kfold(table(spark, sf_dir, "train_stances").withColumn("y", F.lower(F.trim("stance"))), "body_id", "y", 5)
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("body_id").alias("bodies"), F.countDistinct("y").alias("stances"))


@query(_R + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(count({c}) / count(*), 6) AS share FROM r" for c in _MEASURED) + ")")
def column_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.coverage(latest(spark, sf_dir), _MEASURED)


@query(_R + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) / count(*), 6) AS share FROM r" for i, a in enumerate(_MEASURED) for b in _MEASURED[i + 1 :]))
def column_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.pair_coverage(latest(spark, sf_dir), _MEASURED)


_PARTS = "engagement.likes / (abs(engagement.likes) + 10.0)", "engagement.replies / (abs(engagement.replies) + 5.0)", "engagement.shares / (abs(engagement.shares) + 5.0)"


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).selectExpr("id", "source", *[f"cast({p} as double) as {n}" for n, p in zip("abc", _PARTS)])


_F = f", f AS (SELECT id, source, CAST({_PARTS[0]} AS DOUBLE) AS a, CAST({_PARTS[1]} AS DOUBLE) AS b, CAST({_PARTS[2]} AS DOUBLE) AS c FROM r)\n"
_MEAN = "(coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif((a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)"


@query(_R + _F + f"SELECT source, count(*) AS n, count(x) AS scored, round(avg(x), 6) AS mean FROM (SELECT source, {_MEAN} AS x FROM f) GROUP BY source")
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the measured parts of each record's engagement, by source."""
    s = _components(spark, sf_dir).select("source", E.fused([F.col(c) for c in "abc"]).alias("x"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("scored"), F.round(F.avg("x"), 6).alias("mean"))


@query(_R + _F + f"SELECT 'all' AS configuration, round(count(x) / count(*), 6) AS share, round(avg(x), 6) AS mean FROM (SELECT {_MEAN} AS x FROM f) UNION ALL SELECT 'likes', round(count(a) / count(*), 6), round(avg(a), 6) FROM f UNION ALL SELECT 'absent', 0.0, NULL")
def fusion_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ablation(_components(spark, sf_dir), {"all": ["a", "b", "c"], "likes": ["a"], "absent": ["z"]})


@query(_R + ", c AS (SELECT length(text) < 40 AS short, parent_id IS NULL AS root, lang IS NULL AS nolang FROM r) SELECT 'short' AS category, count(*) FILTER (coalesce(short, false)) AS n FROM c UNION ALL SELECT 'root', count(*) FILTER (root) FROM c UNION ALL SELECT 'no_lang', count(*) FILTER (nolang) FROM c UNION ALL SELECT 'uncategorized', count(*) FILTER (NOT coalesce(short, false) AND NOT root AND NOT nolang) FROM c")
def rule_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.categories(latest(spark, sf_dir), {"short": F.length("text") < 40, "root": F.col("parent_id").isNull(), "no_lang": F.col("lang").isNull()})


def _narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).withColumn("narrative_id", F.coalesce("source_detail", F.lit("none")))


@query(
    _R
    + """, n AS (SELECT *, coalesce(source_detail, 'none') AS narrative_id FROM r), b AS (SELECT narrative_id, count(*) AS size, count(DISTINCT author_id) AS n_authors, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us, array_to_string(list_sort(list(DISTINCT source)), ',') AS platforms FROM n GROUP BY narrative_id),
t AS (SELECT narrative_id, tag, count(*) AS k FROM (SELECT narrative_id, unnest(list_distinct(hashtags)) AS tag FROM n) GROUP BY ALL), u AS (SELECT narrative_id, tag, row_number() OVER (PARTITION BY narrative_id ORDER BY k DESC, tag) AS i FROM t),
h AS (SELECT narrative_id, string_agg(tag, ',' ORDER BY i) AS tags FROM u WHERE i <= 10 GROUP BY narrative_id)
SELECT b.*, round(size / greatest((last_us - first_us) / 3.6e9, 1.0), 6) AS velocity, coalesce(tags, '') AS tags FROM b LEFT JOIN h USING (narrative_id)"""
)
def narrative_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = N.narrative_rows(_narratives(spark, sf_dir))
    us = F.unix_micros
    return n.select("narrative_id", "size", "n_authors", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), F.array_join("platforms", ",").alias("platforms"), F.round("velocity", 6).alias("velocity"), F.coalesce(F.array_join("top_hashtags", ","), F.lit("")).alias("tags"))


@query(
    _R
    + """, v AS (SELECT coalesce(source_detail, 'none') AS g, CAST(length(text) % 97 AS DOUBLE) AS v, sum(1.0 + greatest(coalesce(engagement.likes, 0), 0)) AS w, count(*) AS n FROM r WHERE text IS NOT NULL GROUP BY ALL),
c AS (SELECT *, (sum(w) OVER (PARTITION BY g ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY g) AS pos FROM v), d AS (SELECT *, lag(v) OVER (PARTITION BY g ORDER BY v) AS v0, lag(pos) OVER (PARTITION BY g ORDER BY v) AS pos0, lead(v) OVER (PARTITION BY g ORDER BY v) IS NULL AS is_last FROM c),
t AS (SELECT g, max(CASE WHEN pos >= 0.75 AND v0 IS NULL THEN v WHEN pos >= 0.75 AND pos0 < 0.75 THEN v0 + (v - v0) * (0.75 - pos0) / (pos - pos0) WHEN is_last AND pos < 0.75 THEN v END) AS threshold FROM d GROUP BY g)
SELECT a.g AS narrative_id, round(sum(v * w) / sum(w), 6) AS severity FROM v a JOIN t ON t.g = a.g AND a.v >= t.threshold GROUP BY a.g"""
)
def narrative_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weighted tail mean of a value of each narrative's records; narratives without text have none."""
    n = _narratives(spark, sf_dir).where("text is not null").select("narrative_id", (F.length("text") % 97).cast("double").alias("v"), (1.0 + F.greatest(F.coalesce("engagement.likes", F.lit(0)), F.lit(0))).alias("w"))
    return N.severity(n, "narrative_id", "v", "w").select("narrative_id", F.round("severity", 6).alias("severity"))


@query(_R + "SELECT author_id, array_to_string(list_sort(list(DISTINCT coalesce(source_detail, 'none'))), ',') AS narratives FROM r WHERE author_id IS NOT NULL GROUP BY author_id")
def author_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _narratives(spark, sf_dir).where("author_id is not null")
    touched = N.members_touched(n, n.select(F.col("id").alias("record_id"), "narrative_id"))
    return touched.select("author_id", F.array_join("narratives", ",").alias("narratives"))


@query("SELECT lower(headline) AS claim, min(lower(stance)) AS label FROM train_stances WHERE headline IS NOT NULL AND trim(headline) <> '' AND stance IS NOT NULL GROUP BY lower(headline) HAVING min(lower(stance)) = max(lower(stance))")
def stance_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines that carry one stance only."""
    t = table(spark, sf_dir, "train_stances").withColumn("y", F.lower("stance"))
    return consistent_claims(t, "headline", "y").select(F.lower("text").alias("claim"), "label")


_K = """, k AS (SELECT author_id, floor(epoch_us(timestamp) / 3600000000)::BIGINT AS bucket, epoch_us(timestamp) AS us, urls, domains, hashtags, parent_id FROM r WHERE author_id IS NOT NULL AND timestamp IS NOT NULL AND NOT ends_with(author_id, ':__deleted__')),
e AS (SELECT author_id, bucket, us, 'cotweet' AS kind, 'url:' || unnest(urls) AS key FROM k UNION ALL SELECT author_id, bucket, us, 'cotweet', 'domain:' || unnest(domains) FROM k
  UNION ALL SELECT author_id, bucket, us, 'hashtag_seq', 'tags:' || array_to_string(hashtags, '|') FROM k WHERE len(hashtags) >= 2 UNION ALL SELECT author_id, bucket, us, 'temporal', 'parent:' || parent_id FROM k WHERE parent_id IS NOT NULL),
g AS (SELECT kind, key, bucket, author_id, min(us) AS us, count(*) OVER (PARTITION BY kind, key, bucket) AS n FROM e WHERE key IS NOT NULL GROUP BY kind, key, bucket, author_id),
p AS (SELECT a.author_id AS src, b.author_id AS dst, a.kind, least(a.us, b.us) AS us FROM g a JOIN g b USING (kind, key, bucket) WHERE a.author_id < b.author_id AND a.n <= 100
  UNION ALL SELECT least(author_id, 'key:' || bucket || ':' || key), greatest(author_id, 'key:' || bucket || ':' || key), kind, us FROM g WHERE n > 100)
"""


@query(_R + _K + "SELECT src, dst, kind, count(*) AS observations, min(us) AS first_us FROM p GROUP BY ALL")
def coordination_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts that share an address, a hashtag sequence or a parent within an hour."""
    return C.record_edges(latest(spark, sf_dir))


@query(_R + _K + "SELECT kind, count(*) AS edges, sum(n)::BIGINT AS observations, max(n) AS heaviest FROM (SELECT src, dst, kind, count(*) AS n FROM p GROUP BY ALL) GROUP BY kind")
def coordination_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.edge_kinds(C.record_edges(latest(spark, sf_dir)))


@query("SELECT 'universal' AS tier, true AS available UNION ALL SELECT 'social_graph', count(followers) > 0 FROM authors UNION ALL SELECT 'threading', count(parent_id) > 0 FROM records")
def feature_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.tiers(table(spark, sf_dir, "records"), table(spark, sf_dir, "authors"))


@query("SELECT author_id, coalesce(TRY_CAST(raw ->> '$.statuses_count' AS DOUBLE), TRY_CAST(raw ->> '$.tweet_count' AS DOUBLE), TRY_CAST(raw ->> '$.post_count' AS DOUBLE), TRY_CAST(raw ->> '$.videoCount' AS DOUBLE)) AS posts, CASE WHEN created_at <= last_seen THEN round((epoch_us(last_seen) - epoch_us(created_at)) / 8.64e10, 6) END AS age FROM authors")
def author_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime posts by the platform's payload, and the account's age when last seen."""
    a = table(spark, sf_dir, "authors")
    return a.select("author_id", C.lifetime_posts(F.col("raw")).alias("posts"), F.round(C.age_days(F.col("created_at"), F.col("last_seen")), 6).alias("age"))


@query("WITH h AS (SELECT DISTINCT simhash AS a FROM records WHERE simhash IS NOT NULL AND simhash <> 0) SELECT x.a, y.a AS b, bit_count(xor(x.a, y.a))::INTEGER AS distance FROM h x JOIN h y ON x.a < y.a WHERE bit_count(xor(x.a, y.a)) <= 3")
def simhash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different hashes that differ in at most three bits, wherever these lie."""
    return hash_pairs(table(spark, sf_dir, "records"), "simhash")


@query()
def collapsed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, representative: each record's first near-duplicate by its hash."""
    return first_of_kind(latest(spark, sf_dir))


@query(_R + "SELECT id, simhash FROM r WHERE simhash IS NOT NULL AND text IS NOT NULL")
def record_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity hash of every record that came with one: made anew from its text, equal to the stored one."""
    r = latest(spark, sf_dir).where("simhash is not null and text is not null")
    return r.select("id", similarity_hash("text").alias("simhash"))
