"""Text, URL and near-duplicate queries of the ingest side, narratives and adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.functions import text as T
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


_R = "WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at, timestamp) AS _n FROM records) WHERE _n = 1)\n"


@query(
    """WITH u AS (SELECT DISTINCT url FROM documents WHERE url IS NOT NULL), p AS (SELECT url, regexp_replace(url, '#.*$', '') AS base FROM u),
h AS (SELECT url, lower(regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)', 1)) AS head, base FROM p),
q AS (SELECT url, head, regexp_extract(substr(base, length(head) + 1), '^([^?]*)', 1) AS path, regexp_extract(substr(base, length(head) + 1), '\\?(.*)$', 1) AS query FROM h),
k AS (SELECT url, head, path, array_to_string(list_filter(string_split(query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(?:utm_[^=&#]*|fbclid|gclid|mc_[^=&#]*|igshid|ref_src|ref_url|s|si|cmp|cmpid|smid)(?:=|$)')), '&') AS kept FROM q)
SELECT url, CASE WHEN head = '' THEN url ELSE head || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical FROM k"""
)
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("url is not null").select("url").distinct().select("url", T.canonical_url(F.col("url")).alias("canonical"))


@query(
    """WITH h AS (SELECT lower(regexp_extract(url, '^https?://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM documents WHERE url IS NOT NULL), l AS (SELECT host, string_split(host, '.') AS p FROM h WHERE host <> '' AND NOT regexp_matches(host, '^[0-9.]+$'))
SELECT CASE WHEN len(p) >= 3 AND p[len(p) - 1] IN ('co', 'com', 'org', 'net', 'gov', 'ac', 'edu') AND length(p[len(p)]) = 2 THEN p[len(p) - 2] || '.' || p[len(p) - 1] || '.' || p[len(p)] ELSE p[len(p) - 1] || '.' || p[len(p)] END AS domain, count(*) AS n
FROM l WHERE len(p) >= 2 GROUP BY 1"""
)
def domains_of_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("url is not null").select(T.registrable_domain(F.col("url")).alias("domain"))
    return d.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(_R + "SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^\\w&#])#(\\w{1,139})', 1), lambda x: lower(x)))), ',') AS tags FROM r WHERE regexp_matches(text, '^[\\x00-\\x7f]*$') AND NOT regexp_matches(text, '#\\w+#')")
def text_hashtags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags found in texts of plain letters (the SQL engine knows no other); text_hashtags_all has those of all texts."""
    r = latest(spark, sf_dir).where(F.col("text").rlike("^[\\x00-\\x7f]*$") & ~F.col("text").rlike("#\\w+#"))
    return _tags_of(r)


@query()
def text_hashtags_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashtags found in all texts, in any writing; null texts have none."""
    return _tags_of(latest(spark, sf_dir))


def _tags_of(r: DataFrame) -> DataFrame:
    return r.select("id", F.array_join(F.array_sort(T.hashtags(F.col("text"))), ",").alias("tags"))


@query()
def record_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id with the URLs, hashtags and mentions of its whole text."""
    r = latest(spark, sf_dir)
    return r.select("id", T.text_urls(F.col("text")).alias("urls"), T.hashtags(F.col("text")).alias("tags"), T.mentions(F.col("text")).alias("handles"))


@query()
def status_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mastodon statuses as records: clean text, instance, counts and root conversation."""
    s = table(spark, sf_dir, "mastodon_statuses").dropDuplicates(["id"])
    host = F.when(F.instr("account.acct", "@") > 0, F.substring_index("account.acct", "@", -1))
    return s.select(
        F.concat(F.lit("mastodon:"), "id").alias("id"), T.clean_html("content").alias("text"), host.alias("source_detail"),
        F.concat(F.lit("mastodon:"), "account.id").alias("author_id"), F.concat(F.lit("mastodon:"), "in_reply_to_id").alias("parent_id"),
        F.when(F.col("in_reply_to_id").isNull(), F.concat(F.lit("mastodon:"), "id")).alias("conversation_id"),
        F.struct(F.col("favourites_count").alias("likes"), F.col("reblogs_count").alias("shares"), F.col("replies_count").alias("replies"), F.lit(None).cast("bigint").alias("views")).alias("engagement"),
    )


@query(
    """WITH u AS (SELECT DISTINCT id, speaker_id, conversation_id, reply_to, text, meta.score AS score FROM reddit_convokit_utterances),
c AS (SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' WHEN lower(trim(text)) IN ('[deleted]', '[removed]', 'deleted', 'removed', '[deleted by user]') THEN 'deleted_text' ELSE 'kept' END AS outcome, reply_to FROM u)
SELECT outcome, count(*) AS n, count(reply_to) AS replies FROM c GROUP BY outcome"""
)
def reddit_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of utterances: kept, or the reason of the drop."""
    u = table(spark, sf_dir, "reddit_convokit_utterances").select("id", "speaker_id", "conversation_id", "reply_to", "text", "meta.score").distinct()
    reason = F.when(F.coalesce(F.trim("text") == "", F.lit(True)), "empty_text").when(T.is_deleted_text(F.col("text")), "deleted_text").otherwise("kept")
    return u.select(reason.alias("outcome"), "reply_to").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count("reply_to").alias("replies"))


@query(
    """SELECT theme, count(*) AS n FROM (SELECT unnest(list_distinct(list_filter(list_transform(string_split(themes, ';'), lambda x: trim(string_split(x, ',')[1])), lambda x: x <> ''))) AS theme FROM (SELECT DISTINCT gkgrecordid, themes FROM gdelt_gkg_rows WHERE themes IS NOT NULL)) GROUP BY theme"""
)
def gdelt_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gdelt_gkg_rows").where("themes is not null").select("gkgrecordid", "themes").distinct()
    parts = F.filter(F.transform(F.split("themes", ";"), lambda x: F.trim(F.split(x, ",")[0])), lambda x: x != "")
    return g.select(F.explode(F.array_distinct(parts)).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT round(avg(TRY_CAST(string_split(v2tone, ',')[1] AS DOUBLE)), 6) AS tone, round(avg(TRY_CAST(string_split(v2tone, ',')[4] AS DOUBLE)), 6) AS polarity, count(*) AS n FROM (SELECT DISTINCT gkgrecordid, v2tone FROM gdelt_gkg_rows)"""
)
def gdelt_tone(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "gdelt_gkg_rows").select("gkgrecordid", "v2tone").distinct().withColumn("p", F.split("v2tone", ","))
    num = lambda k: F.round(F.avg(F.get("p", k).try_cast("double")), 6)
    return g.agg(num(F.lit(0)).alias("tone"), num(F.lit(3)).alias("polarity"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT count(*) AS n, count(TRY_CAST(statistics.viewCount AS BIGINT)) AS with_views, sum(TRY_CAST(statistics.viewCount AS BIGINT))::BIGINT AS views, sum(TRY_CAST(statistics.likeCount AS BIGINT))::BIGINT AS likes FROM (SELECT DISTINCT id, statistics FROM youtube_items)"""
)
def youtube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = table(spark, sf_dir, "youtube_items").select("id", "statistics").distinct()
    v, k = F.col("statistics.viewCount").try_cast("bigint"), F.col("statistics.likeCount").try_cast("bigint")
    return y.agg(F.count(F.lit(1)).alias("n"), F.count(v).alias("with_views"), F.sum(v).cast("bigint").alias("views"), F.sum(k).cast("bigint").alias("likes"))


@query(
    """SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(list_transform(tags, lambda t: lower(trim(t.term))))) AS term FROM (SELECT DISTINCT id, tags FROM news_rss_entries WHERE tags IS NOT NULL)) WHERE term <> '' GROUP BY term"""
)
def news_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "news_rss_entries").where("tags is not null").select("id", "tags").distinct()
    return n.select(F.explode(F.array_distinct(F.transform("tags", lambda t: F.lower(F.trim(t.term))))).alias("term")).where("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    _R
    + """, b AS (SELECT id, author_id, simhash, simhash >> 48 & 65535 AS band FROM r WHERE simhash IS NOT NULL AND simhash <> 0)
SELECT x.id AS id_a, y.id AS id_b, bit_count(xor(x.simhash, y.simhash))::INTEGER AS distance FROM b x JOIN b y ON x.band = y.band AND x.id < y.id WHERE x.author_id <> y.author_id AND bit_count(xor(x.simhash, y.simhash)) <= 3"""
)
def simhash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different authors in one 16-bit band whose hashes differ in at most three bits; 0 means no words."""
    b = latest(spark, sf_dir).where("simhash is not null and simhash <> 0").select("id", "author_id", "simhash", F.shiftrightunsigned("simhash", 48).alias("band"))
    o = b.select("band", F.col("id").alias("id_b"), F.col("author_id").alias("author_b"), F.col("simhash").alias("h"))
    d = T.hamming(F.col("simhash"), F.col("h"))
    return b.join(o, "band").where((F.col("id") < F.col("id_b")) & (F.col("author_id") != F.col("author_b")) & (d <= 3)).select(F.col("id").alias("id_a"), "id_b", d.cast("int").alias("distance"))


@query()
def simhash_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit word hash of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", T.similarity_hash("text").alias("simhash"))


@query(
    """WITH d AS (SELECT source, count(*) AS n, count(DISTINCT text) AS k FROM documents GROUP BY source) SELECT source, n, k AS distinct_texts, round(1 - k / n, 6) AS duplicate_rate FROM d"""
)
def duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("distinct_texts"))
    return d.select("source", "n", "distinct_texts", F.round(1 - F.col("distinct_texts") / F.col("n"), 6).alias("duplicate_rate"))


@query("SELECT text AS t, min(doc_id) AS kept, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.col("text").alias("t")).agg(F.min("doc_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
    return d.where("copies > 1")


@query(
    _R
    + """, t AS (SELECT *, epoch_us(timestamp) AS us, hour(timestamp AT TIME ZONE 'UTC') AS h FROM r), m AS (SELECT author_id, quantile_cont(h, 0.5) AS mh, count(*) AS n FROM t GROUP BY author_id HAVING count(*) >= 3)
SELECT t.id, round((us - lag(us) OVER (PARTITION BY t.author_id ORDER BY us, t.id)) / 1e6, 3) AS gap, round(least(abs(h - mh), 24 - abs(h - mh)), 6) AS hour_distance, n AS author_posts, round(ln(1 + length(text)), 6) AS log_chars,
  coalesce(len(urls), 0)::INTEGER AS n_urls, round(CASE WHEN simhash IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY t.author_id, simhash >> 48) / n END, 6) AS self_duplicates FROM t JOIN m ON m.author_id = t.author_id"""
)
def anomaly_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per post: gap, distance to the author's usual hour, sizes and self-duplication; authors of three posts or more."""
    t = latest(spark, sf_dir).withColumn("us", F.unix_micros("timestamp")).withColumn("h", F.hour("timestamp"))
    m = t.groupBy("author_id").agg(F.percentile("h", F.lit(0.5)).alias("mh"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    by = W.partitionBy("author_id")
    far = F.abs(F.col("h") - F.col("mh"))
    same = F.count(F.lit(1)).over(W.partitionBy("author_id", F.shiftright("simhash", 48)))
    return t.join(m, "author_id").select(
        "id", F.round((F.col("us") - F.lag("us").over(by.orderBy("us", "id"))) / 1e6, 3).alias("gap"), F.round(F.least(far, 24 - far), 6).alias("hour_distance"),
        F.col("n").alias("author_posts"), F.round(F.log(1 + F.length("text")), 6).alias("log_chars"), F.coalesce(F.size("urls"), F.lit(0)).alias("n_urls"),
        F.round(F.when(F.col("simhash").isNull(), 0.0).otherwise(same / F.col("n")), 6).alias("self_duplicates"),
    )
