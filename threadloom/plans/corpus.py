"""Corpus statistics, row rules, set operations and account behaviour over the records and events tables.

Every query is a DataFrame plan; the SQL beside it states the same result for DuckDB.
Null means "not measurable" throughout and is never counted as zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.operators.coactivity import keys_by_user, node_sums, pair_edges
from threadloom.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def share(c: Column, digits: int = 6) -> Column:
    return F.round(F.avg(c.cast("double")), digits)


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with one row per id: the first fetched copy."""
    first = W.partitionBy("id").orderBy("ingested_at", "timestamp")
    return table(spark, sf_dir, "records").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


_R = "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, timestamp) AS _n FROM records) WHERE _n = 1)\n"


@query(
    """
WITH g AS (SELECT user_id, ts, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev,
  count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 1 HOUR FOLLOWING) AS ahead FROM events),
p AS (SELECT user_id, count(*) AS posts, count(DISTINCT CAST(ts AS DATE)) AS active_days, max(ahead) AS peak_per_hour,
  epoch_us(max(ts)) - epoch_us(min(ts)) AS span, avg((epoch_us(ts) - prev) / 1e6) AS m, stddev_pop((epoch_us(ts) - prev) / 1e6) AS s, count(prev) AS gaps FROM g GROUP BY user_id),
h AS (SELECT user_id, -sum(n / t * log2(n / t)) AS hour_entropy FROM (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY user_id) AS t FROM events GROUP BY user_id, hour(ts)) GROUP BY user_id),
d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events),
i AS (SELECT user_id, d - CAST(row_number() OVER (PARTITION BY user_id ORDER BY d) AS INTEGER) AS isle FROM d),
k AS (SELECT user_id, max(n) AS longest_streak FROM (SELECT user_id, isle, count(*) AS n FROM i GROUP BY user_id, isle) GROUP BY user_id)
SELECT p.user_id, posts, active_days, peak_per_hour,
  round(CASE WHEN posts < 2 THEN posts ELSE posts / greatest(span / 8.64e10, 1.0 / 24) END, 6) AS posts_per_day,
  round(CASE WHEN gaps < 2 OR s + m = 0 THEN 0 ELSE (s - m) / (s + m) END, 6) AS burstiness,
  round(hour_entropy, 6) + 0.0 AS hour_entropy, longest_streak
FROM p JOIN h USING (user_id) JOIN k USING (user_id)
"""
)
def author_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity of every user: posts, active days, rate, peak, burstiness, hour entropy and longest streak of days."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    us = F.unix_micros("ts")
    by = W.partitionBy("user_id")
    gaps = e.select(
        "user_id", "ts", us.alias("us"),
        ((us - F.lag(us).over(by.orderBy("ts", "event_id"))) / 1e6).alias("gap"),
        F.count(F.lit(1)).over(by.orderBy(us).rangeBetween(0, 3_600_000_000)).alias("ahead"),
    )
    span, m, s = F.max("us") - F.min("us"), F.avg("gap"), F.stddev_pop("gap")
    profile = gaps.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("posts"), F.countDistinct(F.to_date("ts")).alias("active_days"), F.max("ahead").alias("peak_per_hour"),
        F.round(F.when(F.count(F.lit(1)) < 2, F.count(F.lit(1))).otherwise(F.count(F.lit(1)) / F.greatest(span / 8.64e10, F.lit(1.0 / 24))), 6).alias("posts_per_day"),
        F.round(F.when((F.count("gap") < 2) | (s + m == 0), 0).otherwise((s - m) / (s + m)), 6).alias("burstiness"),
    )
    hours = e.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    p = F.col("n") / F.sum("n").over(by)
    entropy = hours.withColumn("p", p).groupBy("user_id").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 6).alias("hour_entropy"))
    days = e.select("user_id", F.to_date("ts").alias("d")).distinct()
    isles = days.withColumn("isle", F.date_sub("d", F.row_number().over(by.orderBy("d"))))
    streak = isles.groupBy("user_id", "isle").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest_streak"))
    return profile.join(entropy, "user_id").join(streak, "user_id")


@query(
    """
WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events),
l AS (SELECT user_id, ln(1 + gap) AS x FROM g WHERE gap > 0),
b AS (SELECT user_id, x, min(x) OVER (PARTITION BY user_id) AS lo, max(x) OVER (PARTITION BY user_id) AS hi, count(*) OVER (PARTITION BY user_id) AS n FROM l),
c AS (SELECT user_id, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor((x - lo) / (hi - lo) * 12) AS INTEGER), 11) END AS bin, CAST(count(*) AS DOUBLE) AS k FROM b WHERE n >= 2 GROUP BY ALL)
SELECT user_id, round(-sum(k / t * log2(k / t)), 6) + 0.0 AS interval_entropy FROM (SELECT *, sum(k) OVER (PARTITION BY user_id) AS t FROM c) GROUP BY user_id
"""
)
def interval_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy in bits over twelve equal bins of log gaps; users with fewer than two positive gaps have none."""
    by = W.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = table(spark, sf_dir, "events").select("user_id", ((us - F.lag(us).over(by.orderBy("ts", "event_id"))) / 1e6).alias("gap")).where("gap > 0")
    x = gaps.select("user_id", F.log(1 + F.col("gap")).alias("x"))
    b = x.select("user_id", "x", F.min("x").over(by).alias("lo"), F.max("x").over(by).alias("hi"), F.count("x").over(by).alias("n")).where("n >= 2")
    bins = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 12).cast("int"), F.lit(11)))
    c = b.groupBy("user_id", bins.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("k"))
    p = c.withColumn("p", F.col("k") / F.sum("k").over(by))
    return p.groupBy("user_id").agg((F.round(-F.sum(F.col("p") * F.log2("p")), 6) + 0.0).alias("interval_entropy"))


@query(
    _R
    + """SELECT source, count(*) AS records, count(DISTINCT author_id) AS authors, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us,
  round(100 * avg(CASE WHEN parent_id IS NOT NULL THEN 1.0 ELSE 0 END), 1) AS threaded_pct, CAST(floor(quantile_cont(length(text), 0.5)) AS BIGINT) AS median_chars,
  count(DISTINCT lang) AS langs FROM r GROUP BY source"""
)
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("records"), F.countDistinct("author_id").alias("authors"),
        F.unix_micros(F.min("timestamp")).alias("first_us"), F.unix_micros(F.max("timestamp")).alias("last_us"),
        F.round(100 * F.avg(F.col("parent_id").isNotNull().cast("double")), 1).alias("threaded_pct"),
        F.floor(F.percentile(F.length("text"), F.lit(0.5))).cast("bigint").alias("median_chars"), F.countDistinct("lang").alias("langs"),
    )


@query(_R + "SELECT source, CAST(timestamp AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM r GROUP BY ALL")
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy("source", F.to_date("timestamp").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """
WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL),
s AS (SELECT event_type, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY event_type)
SELECT s.event_type, s.day, coalesce(d.n, 0) AS n FROM s LEFT JOIN d ON d.event_type = s.event_type AND d.day = s.day
"""
)
def daily_volume_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day and type, with zero on days without any."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    spine = d.groupBy("event_type").agg(F.sequence(F.min("day"), F.max("day")).alias("days")).select("event_type", F.explode("days").alias("day"))
    return spine.join(d, ["event_type", "day"], "left").select("event_type", "day", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query(_R + "SELECT posts, count(*) AS authors FROM (SELECT author_id, count(*) AS posts FROM r GROUP BY author_id) GROUP BY posts")
def posts_per_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = latest(spark, sf_dir).groupBy("author_id").agg(F.count(F.lit(1)).alias("posts"))
    return each.groupBy("posts").agg(F.count(F.lit(1)).alias("authors"))


@query(_R + "SELECT author_id, count(*) AS posts FROM r GROUP BY author_id ORDER BY posts DESC, author_id LIMIT 10")
def top_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy("author_id").agg(F.count(F.lit(1)).alias("posts")).orderBy(F.desc("posts"), "author_id").limit(10)


@query(
    _R
    + """SELECT coalesce(lang, 'none') AS lang, sum(CASE WHEN source = 'reddit' THEN 1 ELSE 0 END)::BIGINT AS reddit, sum(CASE WHEN source = 'mastodon' THEN 1 ELSE 0 END)::BIGINT AS mastodon,
  sum(CASE WHEN source = 'news' THEN 1 ELSE 0 END)::BIGINT AS news, sum(CASE WHEN source = 'gdelt' THEN 1 ELSE 0 END)::BIGINT AS gdelt, sum(CASE WHEN source = 'youtube' THEN 1 ELSE 0 END)::BIGINT AS youtube, count(*) AS total FROM r GROUP BY 1"""
)
def lang_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = ["reddit", "mastodon", "news", "gdelt", "youtube"]
    wide = latest(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).pivot("source", sources).count()
    total = sum((F.coalesce(s, F.lit(0)) for s in sources), F.lit(0))
    return wide.select("lang", *[F.coalesce(s, F.lit(0)).cast("bigint").alias(s) for s in sources], total.cast("bigint").alias("total"))


@query(
    _R
    + """SELECT r.source, round(avg(least(length(text), p99)), 6) AS mean_clipped, round(avg(CASE WHEN length(text) < 40 THEN 1.0 ELSE 0 END), 6) AS short_share,
  round(avg(CASE WHEN author_id LIKE '%:__deleted__' THEN 1.0 ELSE 0 END), 6) AS deleted_share
FROM r JOIN (SELECT source, quantile_cont(length(text), 0.99) AS p99 FROM r GROUP BY source) q ON q.source = r.source GROUP BY r.source"""
)
def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = latest(spark, sf_dir).select("source", F.length("text").alias("n"), "author_id")
    p99 = r.groupBy("source").agg(F.percentile("n", F.lit(0.99)).alias("p99"))
    return r.join(p99, "source").groupBy("source").agg(
        F.round(F.avg(F.least(F.col("n").cast("double"), "p99")), 6).alias("mean_clipped"), share(F.col("n") < 40).alias("short_share"),
        share(F.col("author_id").endswith(":__deleted__")).alias("deleted_share"),
    )


@query(_R + "SELECT domain, count(*) AS n FROM (SELECT unnest(domains) AS domain FROM r) GROUP BY domain ORDER BY n DESC, domain LIMIT 25")
def top_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select(F.explode("domains").alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(25)


@query(_R + "SELECT source, round(avg(CASE WHEN parent_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS parent_share, round(avg(CASE WHEN conversation_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS conversation_share FROM r GROUP BY source")
def threading_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy("source").agg(share(F.col("parent_id").isNotNull()).alias("parent_share"), share(F.col("conversation_id").isNotNull()).alias("conversation_share"))


def reject_reason() -> Column:
    """The first row rule that a record breaks, or null."""
    namespaced = lambda c: F.col(c).isNull() | F.col(c).startswith(F.concat("source", F.lit(":")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(blank("native_id"), "empty_native_id").when(blank("source_detail"), "empty_source_detail").when(blank("author_id"), "empty_author_id")
        .when(F.col("timestamp").isNull(), "missing_timestamp").when(F.coalesce(F.length("text"), F.lit(0)) > 200_000, "text_too_long")
        .when(~(namespaced("id") & namespaced("author_id") & namespaced("parent_id") & namespaced("conversation_id")), "not_namespaced")
    )


@query(
    """SELECT coalesce(CASE WHEN coalesce(trim(native_id) = '', true) THEN 'empty_native_id' WHEN coalesce(trim(source_detail) = '', true) THEN 'empty_source_detail' WHEN coalesce(trim(author_id) = '', true) THEN 'empty_author_id'
  WHEN timestamp IS NULL THEN 'missing_timestamp' WHEN coalesce(length(text), 0) > 200000 THEN 'text_too_long'
  WHEN NOT ((id IS NULL OR starts_with(id, source || ':')) AND (author_id IS NULL OR starts_with(author_id, source || ':')) AND (parent_id IS NULL OR starts_with(parent_id, source || ':')) AND (conversation_id IS NULL OR starts_with(conversation_id, source || ':'))) THEN 'not_namespaced' END, 'valid') AS reason, count(*) AS n FROM records GROUP BY 1"""
)
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").groupBy(F.coalesce(reject_reason(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def normal_lang(lang: Column) -> Column:
    """Primary subtag in lower case; null where it names no language or is no two or three letters."""
    head = F.split(F.lower(F.trim(lang)), "[-_]", 2)[0]
    return F.when(head.isin("und", "unknown", "zxx") | ~head.rlike("^[a-z]{2,3}$"), None).otherwise(head)


@query(
    _R
    + """SELECT CASE WHEN h IN ('und', 'unknown', 'zxx') OR NOT regexp_matches(h, '^[a-z]{2,3}$') THEN NULL ELSE h END AS lang, count(*) AS n
FROM (SELECT regexp_split_to_array(lower(trim(lang)), '[-_]')[1] AS h FROM r) GROUP BY 1"""
)
def normal_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).groupBy(normal_lang(F.col("lang")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _R
    + """SELECT source, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' WHEN length(trim(text)) < 20 THEN 'text_too_short'
  WHEN NOT coalesce(lower(lang) IN ('en', 'es'), true) THEN 'unsupported_language' ELSE 'ok' END AS gate, count(*) AS n FROM r GROUP BY 1, 2"""
)
def language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a scorer skips a record: the first reason that applies."""
    t = F.trim("text")
    gate = F.when(F.col("text").isNull() | (t == ""), "empty_text").when(F.length(t) < 20, "text_too_short").when(~F.coalesce(F.lower("lang").isin("en", "es"), F.lit(True)), "unsupported_language").otherwise("ok")
    return latest(spark, sf_dir).groupBy("source", gate.alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def engagement_total() -> Column:
    """Sum of the metrics that are there; null where none is."""
    parts = [F.col(f"engagement.{c}") for c in ("likes", "shares", "replies", "views")]
    return F.when(F.coalesce(*parts).isNull(), None).otherwise(sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0)))


@query(
    _R
    + """SELECT source, count(*) AS n, count(t) AS measured, sum(t)::BIGINT AS total, round(avg(CASE WHEN t IS NULL THEN 1 ELSE 1 + greatest(0, t) END), 6) AS mean_weight FROM (
  SELECT source, CASE WHEN coalesce(engagement.likes, engagement.shares, engagement.replies, engagement.views) IS NULL THEN NULL
    ELSE coalesce(engagement.likes, 0) + coalesce(engagement.shares, 0) + coalesce(engagement.replies, 0) + coalesce(engagement.views, 0) END AS t FROM r) GROUP BY source"""
)
def engagement_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = latest(spark, sf_dir).select("source", engagement_total().alias("t"))
    weight = F.when(F.col("t").isNull(), 1).otherwise(1 + F.greatest(F.lit(0), "t"))
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("measured"), F.sum("t").cast("bigint").alias("total"), F.round(F.avg(weight), 6).alias("mean_weight"))


@query(
    _R
    + """SELECT author_id, count(*) AS posts, round(avg(coalesce(len(urls), 0)), 6) AS url_rate, round(avg(coalesce(len(hashtags), 0)), 6) AS hashtag_rate, round(avg(coalesce(len(mentions), 0)), 6) AS mention_rate,
  round(avg(CASE WHEN parent_id IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS reply_share,
  CASE WHEN count(parent_id) = 0 THEN NULL ELSE round(count(DISTINCT parent_id) / count(parent_id), 6) END AS reciprocity,
  round(1 - count(DISTINCT trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) / count(*), 6) AS duplicate_rate FROM r GROUP BY author_id"""
)
def content_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per author: list lengths per post, reply share, distinct parents per reply and the share of repeated texts."""
    size = lambda c: F.round(F.avg(F.coalesce(F.size(c), F.lit(0))), 6)
    normal = F.trim(F.regexp_replace(F.lower("text"), "\\s+", " "))
    n = F.count(F.lit(1))
    return latest(spark, sf_dir).groupBy("author_id").agg(
        n.alias("posts"), size("urls").alias("url_rate"), size("hashtags").alias("hashtag_rate"), size("mentions").alias("mention_rate"),
        share(F.col("parent_id").isNotNull()).alias("reply_share"),
        F.when(F.count("parent_id") > 0, F.round(F.countDistinct("parent_id") / F.count("parent_id"), 6)).alias("reciprocity"),
        F.round(1 - F.countDistinct(normal) / n, 6).alias("duplicate_rate"),
    )


@query(
    _R
    + """SELECT author_id, round(count(DISTINCT w) / count(*), 6) AS type_token_ratio FROM (SELECT author_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w FROM r) WHERE w <> '' GROUP BY author_id"""
)
def type_token_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = latest(spark, sf_dir).select("author_id", F.explode(F.split(F.lower("text"), "\\s+")).alias("w")).where("w <> ''")
    counts = words.groupBy("author_id", "w").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("author_id").agg(F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("type_token_ratio"))


@query(
    _R
    + """SELECT x.author_id, round(avg(1 - bit_count(xor(x.simhash, y.simhash)) / 64.0), 6) AS self_similarity
FROM r x JOIN r y ON x.author_id = y.author_id AND x.id < y.id WHERE x.simhash IS NOT NULL AND y.simhash IS NOT NULL GROUP BY x.author_id"""
)
def self_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean similarity of the 64-bit hashes of an author's posts over all pairs, from the counts of each bit (linear, no pairs)."""
    r = latest(spark, sf_dir).where("simhash is not null").select("author_id", "simhash")
    ones = [F.sum(F.shiftrightunsigned("simhash", k).bitwiseAND(F.lit(1))) for k in range(64)]
    counts = r.groupBy("author_id").agg(F.count(F.lit(1)).alias("n"), F.array(*ones).alias("ones")).where("n > 1")
    apart = F.aggregate("ones", F.lit(0).cast("bigint"), lambda s, x: s + x * (F.col("n") - x))
    return counts.select("author_id", F.round(1 - apart / (64 * F.col("n") * (F.col("n") - 1) / 2), 6).alias("self_similarity"))


@query(
    """
WITH f AS (SELECT a.author_id, a.source, a.followers FROM authors a)
SELECT r.source, count(*) AS n, count(f.followers) AS with_followers, round(avg(ln(1 + f.followers)), 6) AS mean_log_followers
FROM records r LEFT JOIN (SELECT author_id, max(followers) AS followers FROM f GROUP BY author_id) f ON f.author_id = r.author_id GROUP BY r.source
"""
)
def author_followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "authors").groupBy("author_id").agg(F.max("followers").alias("followers"))
    return table(spark, sf_dir, "records").join(f, "author_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("followers").alias("with_followers"), F.round(F.avg(F.log(1 + F.col("followers"))), 6).alias("mean_log_followers"))


@query(
    """
WITH o AS (SELECT author_id, source, min(timestamp) AS first_seen, max(timestamp) AS last_seen, count(*) AS n FROM records GROUP BY 1, 2),
a AS (SELECT author_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen, sum(post_count) AS n FROM authors GROUP BY 1)
SELECT coalesce(a.author_id, o.author_id) AS author_id, (coalesce(a.n, 0) + coalesce(o.n, 0))::BIGINT AS post_count,
  epoch_us(least(a.first_seen, o.first_seen)) AS first_us, epoch_us(greatest(a.last_seen, o.last_seen)) AS last_us
FROM a FULL JOIN o ON a.author_id = o.author_id
"""
)
def rollup_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author roll-ups merged with new observations: counts add up, first and last seen widen."""
    new = table(spark, sf_dir, "records").select("author_id", F.col("timestamp").alias("first_seen"), F.col("timestamp").alias("last_seen"), F.lit(1).cast("bigint").alias("n"))
    old = table(spark, sf_dir, "authors").select("author_id", "first_seen", "last_seen", F.col("post_count").alias("n"))
    return old.unionByName(new).groupBy("author_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("post_count"), F.unix_micros(F.min("first_seen")).alias("first_us"), F.unix_micros(F.max("last_seen")).alias("last_us"))


@query("SELECT r.source, count(*) AS orphans FROM (SELECT DISTINCT source, author_id FROM records) r WHERE NOT EXISTS (SELECT 1 FROM authors a WHERE a.author_id = r.author_id) GROUP BY r.source")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "records").select("source", "author_id").distinct()
    return keys.join(table(spark, sf_dir, "authors"), "author_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("orphans"))


@query("SELECT count(*) AS written, (SELECT count(*) FROM records) - count(*) AS duplicates FROM (SELECT DISTINCT id FROM records)")
def dedupe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "records").groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("written"), (F.sum("n") - F.count(F.lit(1))).alias("duplicates"))


@query("SELECT author_id FROM authors UNION SELECT author_id FROM records")
def known_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "authors").select("author_id").union(table(spark, sf_dir, "records").select("author_id")).distinct()


@query(
    """SELECT event_type, count(*) AS n, count(k) AS parsed, round(avg(k), 6) AS mean_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"""
)
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("k").alias("parsed"), F.round(F.avg("k"), 6).alias("mean_k"))


@query(
    """SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) / (SELECT count(value) FROM events), 6) AS pct FROM events WHERE value IS NOT NULL"""
)
def percent_rank_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile rank with average ties, without one window over all rows: ranks come from the counts of distinct values by range."""
    v = table(spark, sf_dir, "events").where("value is not null").select("event_id", "value")
    counts = v.groupBy("value").agg(F.count(F.lit(1)).alias("k")).repartitionByRange("value").sortWithinPartitions("value").withColumn("part", F.spark_partition_id())
    before = counts.groupBy("part").agg(F.sum("k").alias("s")).withColumn("start", F.coalesce(F.sum("s").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inner = F.sum("k").over(W.partitionBy("part").orderBy("value").rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "part").select("value", (F.col("start") + F.col("inner") + 1 + (F.col("k") - 1) / 2).alias("r"))
    total = v.agg(F.count(F.lit(1)).alias("n"))
    return v.join(ranks, "value").crossJoin(F.broadcast(total)).select("event_id", F.round(F.col("r") / F.col("n"), 6).alias("pct"))


@query(
    """
WITH e AS (SELECT user_id, event_type, CAST(floor((epoch(ts) - (SELECT min(epoch(ts)) FROM events)) / 3600) AS BIGINT) AS b FROM events),
k AS (SELECT DISTINCT user_id, event_type || ':' || CAST(b AS VARCHAR) AS key FROM e),
p AS (SELECT x.user_id AS src, y.user_id AS dst, count(*) AS observations FROM k x JOIN k y ON x.key = y.key AND x.user_id < y.user_id GROUP BY 1, 2)
SELECT src, dst, observations, round(0.6 * ln(1 + observations), 5) AS weight FROM p WHERE 0.6 * ln(1 + observations) >= 0.15
"""
)
def co_activity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges between users active with the same event type in the same hour."""
    return pair_edges(active_users(spark, sf_dir))


def active_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, keys: the event types and hours since the first event in which each user was active."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    least = e.agg(F.min("us").alias("us0"))
    hour = F.floor((F.col("us") - F.col("us0")) / 3_600_000_000)
    return keys_by_user(e.crossJoin(F.broadcast(least)).select(F.col("user_id").alias("user"), F.concat("event_type", F.lit(":"), hour.cast("string")).alias("key")))


@query(
    """
WITH e AS (SELECT user_id, event_type, CAST(floor((epoch(ts) - (SELECT min(epoch(ts)) FROM events)) / 3600) AS BIGINT) AS b FROM events),
k AS (SELECT DISTINCT user_id, event_type || ':' || CAST(b AS VARCHAR) AS key FROM e),
p AS (SELECT x.user_id AS src, y.user_id AS dst, round(0.6 * ln(1 + count(*)), 5) AS w FROM k x JOIN k y ON x.key = y.key AND x.user_id < y.user_id GROUP BY 1, 2),
m AS (SELECT sum(w) AS m FROM p),
d AS (SELECT u, sum(w) AS deg FROM (SELECT src AS u, w FROM p UNION ALL SELECT dst, w FROM p) GROUP BY u),
c AS (SELECT u % 5 AS c, sum(deg) AS deg FROM d GROUP BY 1),
i AS (SELECT src % 5 AS c, sum(w) AS inside FROM p WHERE src % 5 = dst % 5 GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m - (deg / (2 * m)) * (deg / (2 * m))), 6) AS modularity FROM c LEFT JOIN i USING (c), m
"""
)
def modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modularity of the co-activity graph for the communities user_id mod 5."""
    nodes = node_sums(active_users(spark, sf_dir), modulus=5)
    both = nodes.groupBy((F.col("node") % 5).alias("c")).agg(F.sum("weight").alias("deg"), (F.sum("inside") / 2).alias("inside"))  # each edge inside has two ends
    m = F.sum("deg") / 2
    sums = both.agg(m.alias("m"), F.sum("inside").alias("i"), F.sum(F.col("deg") * F.col("deg")).alias("d2"))
    return sums.select(F.round(F.col("i") / F.col("m") - F.col("d2") / (4 * F.col("m") * F.col("m")), 6).alias("modularity"))
