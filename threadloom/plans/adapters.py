"""The raw tables of the platforms as records, their drop reasons and authors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import records as R
from threadloom.operators.timestamps import utc_micros
from threadloom.plans.corpus import latest
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


def mapped(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter's projection of the distinct raw rows. Times are read before the distinct, so that they are read once."""
    zones = table(spark, sf_dir, "feed_zones")
    raw, value, unix, adapter = {
        "reddit": ("reddit_convokit_utterances", "timestamp", True, R.reddit_records), "mastodon": ("mastodon_statuses", "created_at", False, R.mastodon_records), "gdelt": ("gdelt_gkg_rows", "date", False, R.gdelt_records),
        "news": ("news_rss_entries", "published", True, R.news_records), "youtube": ("youtube_items", "snippet.publishedAt", False, R.youtube_records),
    }[name]
    rows = table(spark, sf_dir, raw)
    if name == "news":
        rows = rows.join(zones.groupBy("feed").agg(F.min("tz_name").alias("_zone"), F.min("date_order").alias("_order")), "feed", "left")
        for c in ("published", "updated"):
            rows = utc_micros(rows, F.col(c), F.col("_zone"), F.col("_order"), True, f"_{c}").dropDuplicates()
    else:
        rows = utc_micros(rows, F.col(value), unix=unix, out="_us")
    return adapter(rows.dropDuplicates())


def _flat(df: DataFrame) -> DataFrame:
    return df.select("id", "source_detail", "content_type", "text", "author_id", "author_handle", "parent_id", "conversation_id", *[F.col(f"engagement.{k}").alias(k) for k in R.ENGAGEMENT], "reject_reason")


_GONE = "('[deleted]', '[removed]', 'deleted', 'removed', '[deleted by user]')"


@query(
    f"""WITH u AS (SELECT DISTINCT * FROM reddit_convokit_utterances), x AS (SELECT *, (speaker_id IS NULL OR trim(speaker_id) = '' OR lower(trim(speaker_id)) IN {_GONE}) AS gone FROM u)
SELECT 'reddit:' || trim(id) AS id, coalesce(meta.subreddit, corpus, 'unknown') AS source_detail, CASE WHEN reply_to IS NULL THEN 'post' ELSE 'comment' END AS content_type, coalesce(text, '') AS text,
  'reddit:' || CASE WHEN gone THEN '__deleted__' ELSE trim(speaker_id) END AS author_id, CASE WHEN NOT gone THEN trim(speaker_id) END AS author_handle, 'reddit:' || nullif(reply_to, '') AS parent_id, 'reddit:' || nullif(conversation_id, '') AS conversation_id,
  meta.score AS likes, CAST(NULL AS BIGINT) AS shares, CAST(NULL AS BIGINT) AS replies, CAST(NULL AS BIGINT) AS views
FROM x WHERE NOT (id IS NULL OR trim(id) = '') AND NOT (text IS NULL OR trim(text) = '') AND lower(trim(text)) NOT IN {_GONE}"""
)
def reddit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances as records, whatever their time."""
    m = _flat(mapped(spark, sf_dir, "reddit"))
    return m.where(F.coalesce("reject_reason", F.lit("missing_timestamp")) == "missing_timestamp").drop("reject_reason")


@query(
    r"""WITH u AS (SELECT DISTINCT * FROM youtube_items), x AS (SELECT *, concat_ws(chr(10) || chr(10), nullif(trim(snippet.title), ''), nullif(trim(snippet.description), '')) AS text, coalesce(nullif(snippet.channelId, ''), 'unknown') AS channel FROM u)
SELECT 'youtube:' || trim(id) AS id, channel AS source_detail, 'video' AS content_type, text, 'youtube:' || channel AS author_id, CAST(NULL AS VARCHAR) AS author_handle, CAST(NULL AS VARCHAR) AS parent_id, 'youtube:' || trim(id) AS conversation_id,
  TRY_CAST(statistics.likeCount AS BIGINT) AS likes, CAST(NULL AS BIGINT) AS shares, TRY_CAST(statistics.commentCount AS BIGINT) AS replies, TRY_CAST(statistics.viewCount AS BIGINT) AS views
FROM x WHERE NOT (id IS NULL OR trim(id) = '') AND text <> ''"""
)
def youtube_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos as records, whatever their time."""
    m = _flat(mapped(spark, sf_dir, "youtube"))
    return m.where(F.coalesce("reject_reason", F.lit("missing_timestamp")) == "missing_timestamp").drop("reject_reason")


@query()
def mastodon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records_of(mapped(spark, sf_dir, "mastodon"))


@query()
def gdelt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records_of(mapped(spark, sf_dir, "gdelt"))


@query()
def news_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.records_of(mapped(spark, sf_dir, "news"))


@query()
def adapter_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, outcome, n over the five raw tables."""
    return reduce(lambda a, b: a.unionByName(b), [R.outcomes(mapped(spark, sf_dir, n)) for n in ("reddit", "mastodon", "gdelt", "news", "youtube")])


_R = "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, timestamp) AS _n FROM records) WHERE _n = 1)\n"


@query(
    _R
    + """SELECT author_id, min(source) AS source, (max({'a': timestamp, 'b': author_handle}) FILTER (author_handle IS NOT NULL)).b AS handle, count(*) AS post_count, epoch_us(min(timestamp)) AS first_us, epoch_us(max(timestamp)) AS last_us
FROM r WHERE author_id IS NOT NULL AND NOT ends_with(author_id, ':__deleted__') GROUP BY author_id"""
)
def author_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.observed_authors(latest(spark, sf_dir))
    return a.select("author_id", "source", "handle", "post_count", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


@query(_R + "SELECT source, count(*) AS n FROM r WHERE coalesce(length(text), 0) >= CASE source WHEN 'gdelt' THEN 40 ELSE 0 END GROUP BY source")
def length_floor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.length_floor(latest(spark, sf_dir), {"gdelt": 40}).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query(
    _R
    + """, t AS (SELECT source, max(CAST(parent_id IS NOT NULL AS INTEGER)) AS threaded FROM r GROUP BY source)
SELECT r.source, CASE WHEN r.source IN ('gdelt', 'news') THEN 'source_excluded' WHEN author_id IS NULL OR ends_with(author_id, ':__deleted__') THEN 'author_deleted' WHEN threaded = 0 AND r.source <> 'mastodon' THEN 'no_threading' ELSE 'eligible' END AS outcome, count(*) AS n
FROM r JOIN t USING (source) GROUP BY ALL"""
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of each source can show coordination, and why others cannot."""
    e = R.eligible_records(latest(spark, sf_dir))
    return e.groupBy("source", F.coalesce("skip_reason", F.lit("eligible")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, count(*) AS n_links FROM (SELECT DISTINCT id, unnest(list_distinct(regexp_extract_all(content, 'href=\"(https?://[^\"]+)\"', 1))) AS u, content FROM mastodon_statuses) WHERE NOT regexp_matches(content, 'class=\"[^\"]*(hashtag|mention)|rel=\"[^\"]*tag') GROUP BY id")
def plain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses without hashtag and mention links, with the number of their links."""
    s = table(spark, sf_dir, "mastodon_statuses").where(~F.col("content").rlike("class=\"[^\"]*(hashtag|mention)|rel=\"[^\"]*tag"))
    one = s.select("id", "content").distinct().select("id", F.explode(R.page_links(F.col("content"))).alias("u")).groupBy("id")
    return one.agg(F.count(F.lit(1)).alias("n_links"))
