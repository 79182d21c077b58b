"""Raw rows of the platforms as records, with the reason why a row is no record.

Each adapter is one projection: the record's columns and ``reject_reason`` (null for kept rows),
``flags`` for rows that are kept with something missing. ``records_of`` and ``outcomes`` split it.
Null engagement means "not measured". Rows are mapped one by one: repeated rows give repeated
records; a null in any column is handled by its column's rule; no rows give none.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.timestamps import utc_micros

ENGAGEMENT = ("likes", "shares", "replies", "views")
COLUMNS = ("id", "source", "source_detail", "content_type", "text", "author_id", "author_handle", "timestamp", "parent_id", "conversation_id", "engagement", "urls", "domains", "media_urls", "hashtags", "mentions")
DELETED_AUTHOR = "__deleted__"
WATCH_URL = "https://www.youtube.com/watch?v="
NO_LIST = "array<string>"


def no_string() -> Column:
    return F.lit(None).cast("string")


def make_id(source: str, native: Column) -> Column:
    """source:native; null for null."""
    return F.concat(F.lit(f"{source}:"), native)


def blank(c: Column) -> Column:
    """Null, empty or only white space."""
    return F.coalesce(F.trim(c) == "", F.lit(True))


def engagement(**measured: Column) -> Column:
    return F.struct(*[measured.get(k, F.lit(None)).try_cast("bigint").alias(k) for k in ENGAGEMENT])


def joined_text(*parts: Column) -> Column:
    """Non-blank parts, trimmed, with a blank line between."""
    return F.concat_ws("\n\n", *[F.when(~blank(p), F.trim(p)) for p in parts])


def _timed(rows: DataFrame, value: Column, unix: bool = False, zone: Column | None = None, order: Column | None = None, out: str = "_us") -> DataFrame:
    """rows with the instant of ``value`` in ``out``, unless they have it already (read before another step, such as a distinct)."""
    return rows if out in rows.columns else utc_micros(rows, value, zone, order, unix, out)


def _record(rows: DataFrame, source: str, reasons: list[tuple[str, Column]], flags: list[tuple[str, Column]], extra_urls: Column | None = None, **c: Column) -> DataFrame:
    """The projection of an adapter; the first reason that holds is the row's."""
    text, reason = c["text"], F.lit(None).cast("string")
    for name, holds in reversed(reasons):
        reason = F.when(holds, name).otherwise(reason)
    named = F.array_compact(F.array(*[F.when(holds, name) for name, holds in flags])) if flags else F.array().cast(NO_LIST)
    urls = T.text_urls(text)
    if extra_urls is not None:
        urls = F.array_distinct(F.concat(F.array_compact(F.array(T.canonical_url(extra_urls))), urls))
    rows, urls = rows.withColumn("_urls", urls), F.col("_urls")
    tags = F.array_distinct(F.concat(F.coalesce(c.pop("structured_tags", F.lit(None).cast(NO_LIST)), F.array().cast(NO_LIST)), T.hashtags(text)))
    made = {
        "id": make_id(source, c["native"]), "source": F.lit(source), "source_detail": c["detail"], "content_type": c["kind"], "text": text,
        "author_id": make_id(source, c["author"]), "author_handle": c["handle"], "timestamp": c["at"], "parent_id": c.get("parent", no_string()), "conversation_id": c.get("conversation", no_string()),
        "engagement": c.get("counts", engagement()), "urls": urls, "domains": F.array_distinct(F.array_compact(F.transform(urls, T.registrable_domain))),
        "media_urls": F.coalesce(c.get("media", F.lit(None).cast(NO_LIST)), F.array().cast(NO_LIST)), "hashtags": tags, "mentions": T.mentions(text),
    }
    return rows.select(*[made[k].alias(k) for k in COLUMNS], reason.alias("reject_reason"), named.alias("flags"))


def reddit_records(rows: DataFrame) -> DataFrame:
    """Utterances: id, speaker_id, conversation_id, reply_to, timestamp, text, meta.score, meta.subreddit, corpus.

    Deleted authors stay as a sentinel author and a flag; only the score is measured.
    """
    text, speaker = F.coalesce("text", F.lit("")), F.trim("speaker_id")
    gone = blank(speaker) | T.is_deleted_text(speaker)
    rows, at = _timed(rows, F.col("timestamp"), True), F.timestamp_micros("_us")
    return _record(
        rows, "reddit",
        [("missing_id", blank(F.col("id"))), ("deleted_text", T.is_deleted_text(text)), ("empty_text", blank(text)), ("missing_timestamp", at.isNull())],
        [("author_deleted", gone)],
        native=F.trim("id"), text=text, detail=F.coalesce("meta.subreddit", "corpus", F.lit("unknown")), kind=F.when(F.col("reply_to").isNull(), "post").otherwise("comment"),
        author=F.when(gone, F.lit(DELETED_AUTHOR)).otherwise(speaker), handle=F.when(~gone, speaker), at=at,
        parent=make_id("reddit", F.nullif("reply_to", F.lit(""))), conversation=make_id("reddit", F.nullif("conversation_id", F.lit(""))), counts=engagement(likes=F.col("meta.score")),
    )


def mastodon_records(rows: DataFrame) -> DataFrame:
    """Statuses; a boost (a non-null ``reblog`` of the same shape, where the column exists) is a row of its own below the boosted one.

    Text and engagement of a boost are those of the boosted status. A status with neither text nor
    a boost is dropped as media only. A root is its own conversation; replies have none.
    """
    boosts = "reblog" in rows.columns
    pick = lambda name: F.coalesce(F.col(f"reblog.{name}"), F.col(name)) if boosts else F.col(name)
    rows = rows.withColumn("_text", T.clean_html(pick("content")))
    body, boosted = F.col("_text"), F.col("reblog").isNotNull() if boosts else F.lit(False)
    acct, at, rows = F.col("account.acct"), F.timestamp_micros("_us"), _timed(rows, F.col("created_at"))
    parent = F.coalesce(F.when(boosted, F.col("reblog.id")) if boosts else no_string(), F.nullif("in_reply_to_id", F.lit("")))
    return _record(
        rows, "mastodon",
        [("missing_id", blank(F.col("id"))), ("missing_timestamp", at.isNull()), ("media_only", blank(body))],
        [("boost", boosted)],
        structured_tags=F.transform(pick("tags"), lambda t: F.lower(t.getField("name"))),
        native=F.trim("id"), text=body, detail=F.when(F.instr(acct, "@") > 0, F.substring_index(acct, "@", -1)).otherwise("unknown"), kind=F.when(boosted, "boost").when(parent.isNull(), "post").otherwise("reply"),
        author=F.col("account.id"), handle=acct, at=at, parent=make_id("mastodon", parent), conversation=F.when(parent.isNull(), make_id("mastodon", F.trim("id"))),
        counts=engagement(likes=pick("favourites_count"), shares=pick("reblogs_count"), replies=pick("replies_count")),
    )


def page_title(extras: Column) -> Column:
    """The text of the PAGE_TITLE tag, or null."""
    found = F.trim(F.regexp_extract(extras, r"(?is)<PAGE_TITLE>(.*?)</PAGE_TITLE>", 1))
    return F.nullif(found, F.lit(""))


def title_from_url(url: Column) -> Column:
    """The last long path segment without extension, dashes as blanks; '' where it has at most 12 characters."""
    slug = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[a-z]+://[^/]+/(?:.*/)?([^/]+?)(?:\.[A-Za-z]{2,5})?/?$", 1)
    title = F.trim(F.regexp_replace(slug, r"[-_+]+", " "))
    return F.when(F.length(title) > 12, title).otherwise("")


def gdelt_records(rows: DataFrame) -> DataFrame:
    """Knowledge-graph rows: gkgrecordid, date, sourcecommonname, documentidentifier, extras. The outlet is the author.

    Rows that are not on the web are dropped; a title read off the address is flagged.
    """
    url = F.trim("documentidentifier")
    given = page_title(F.col("extras"))
    title, at, rows = F.coalesce(given, title_from_url(url)), F.timestamp_micros("_us"), _timed(rows, F.col("date"))
    outlet = F.lower(F.coalesce(F.nullif(F.trim("sourcecommonname"), F.lit("")), T.registrable_domain(url), F.lit("unknown")))
    return _record(
        rows, "gdelt",
        [("unsupported_type", F.coalesce(~url.startswith("http"), F.lit(True))), ("missing_timestamp", at.isNull()), ("empty_text", blank(title))],
        [("title_from_url_slug", given.isNull())], url,
        native=F.coalesce(F.nullif(F.trim("gkgrecordid"), F.lit("")), url), text=title, detail=outlet, kind=F.lit("article"), author=outlet, handle=outlet, at=at,
    )


def article_id(url: Column) -> Column:
    """Host and path in lower case, without query and closing slash."""
    return F.lower(F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://([^?#]*)", 1), r"/+$", ""))


def news_records(rows: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Feed entries: id, feed, link, title, summary, published, updated, author. zones: feed, tz_name, date_order.

    The outlet's domain is the author; nothing of the engagement is measured.
    """
    if zones is not None:
        one = zones.groupBy("feed").agg(F.min("tz_name").alias("_zone"), F.min("date_order").alias("_order"))
        rows = rows.join(one, "feed", "left")
    zone = (F.col("_zone"), F.col("_order")) if zones is not None else (None, None)
    for c in ("published", "updated"):
        rows = _timed(rows, F.col(c), True, *zone, out=f"_{c}")
    url = F.coalesce(F.nullif(F.trim("link"), F.lit("")), F.nullif(F.trim("id"), F.lit("")))
    rows = rows.withColumn("_text", T.clean_html(joined_text(F.col("title"), F.col("summary"))))
    at, text = F.timestamp_micros(F.coalesce("_published", "_updated")), F.col("_text")
    domain = F.coalesce(T.registrable_domain(url), F.lit("unknown"))
    return _record(
        rows, "news", [("missing_id", blank(url)), ("missing_timestamp", at.isNull()), ("empty_text", blank(text))], [], url,
        native=F.when(url.rlike("^[A-Za-z]+://"), article_id(url)).otherwise(url), text=text, detail=domain, kind=F.lit("article"), author=domain, handle=F.coalesce("author", domain), at=at,
        structured_tags=F.filter(F.transform("tags", lambda t: F.lower(F.trim(t.getField("term")))), lambda t: t != ""),
    )


def youtube_records(rows: DataFrame) -> DataFrame:
    """Videos: id, snippet, statistics. A video is its own conversation; views are measured only here."""
    s, text, at = "snippet.", joined_text(F.col("snippet.title"), F.col("snippet.description")), F.timestamp_micros("_us")
    rows = _timed(rows, F.col("snippet.publishedAt"))
    channel = F.coalesce(F.nullif(F.col(f"{s}channelId"), F.lit("")), F.lit("unknown"))
    return _record(
        rows, "youtube", [("missing_id", blank(F.col("id"))), ("missing_timestamp", at.isNull()), ("empty_text", blank(text))], [],
        structured_tags=F.transform(f"{s}tags", lambda t: F.lower(F.trim(t))),
        native=F.trim("id"), text=text, detail=channel, kind=F.lit("video"), author=channel, handle=no_string(), at=at, conversation=make_id("youtube", F.trim("id")),
        counts=engagement(likes=F.col("statistics.likeCount"), replies=F.col("statistics.commentCount"), views=F.col("statistics.viewCount")), media=F.array(F.concat(F.lit(WATCH_URL), F.trim("id"))),
    )


def comment_records(rows: DataFrame) -> DataFrame:
    """Video comments: id, snippet with textOriginal, textDisplay, authorChannelId, videoId, parentId, likeCount, publishedAt. The parent is the comment answered, else the video."""
    plain = F.nullif(F.trim("snippet.textOriginal"), F.lit(""))
    text, at = F.coalesce(plain, F.col("_text")), F.timestamp_micros("_us")
    rows = _timed(rows.withColumn("_text", T.clean_html("snippet.textDisplay")), F.col("snippet.publishedAt"))
    video = F.col("snippet.videoId")
    return _record(
        rows, "youtube", [("missing_id", blank(F.col("id"))), ("missing_timestamp", at.isNull()), ("empty_text", blank(text))], [],
        native=F.trim("id"), text=text, detail=F.coalesce("snippet.channelId", video, F.lit("unknown")), kind=F.lit("video_comment"),
        author=F.coalesce("snippet.authorChannelId.value", F.lit("unknown")), handle=F.col("snippet.authorDisplayName"), at=at,
        parent=make_id("youtube", F.coalesce("snippet.parentId", video)), conversation=make_id("youtube", video), counts=engagement(likes=F.col("snippet.likeCount")),
    )


def mapped_records(rows: DataFrame, source: str, columns: Mapping[str, str], detail: str = "unknown") -> DataFrame:
    """Rows of any flat file by a map of field to column: id, text, author, timestamp, likes, replies, title. No threading is made up."""
    get = lambda k: F.col(f"`{columns[k]}`").cast("string") if columns.get(k) in rows.columns else no_string()
    text, at, author, rows = joined_text(get("title"), get("text")), F.timestamp_micros("_us"), get("author"), _timed(rows, get("timestamp"), True)
    gone = blank(author) | T.is_deleted_text(author)
    return _record(
        rows, source, [("missing_id", blank(get("id"))), ("deleted_text", T.is_deleted_text(text)), ("empty_text", blank(text)), ("missing_timestamp", at.isNull())], [("author_deleted", gone)],
        native=F.trim(get("id")), text=text, detail=F.coalesce(get("detail"), F.lit(detail)), kind=F.lit("post"), author=F.when(gone, F.lit(DELETED_AUTHOR)).otherwise(F.trim(author)), handle=F.when(~gone, F.trim(author)), at=at,
        counts=engagement(likes=get("likes"), replies=get("replies")),
    )


def records_of(mapped: DataFrame) -> DataFrame:
    """The kept rows of an adapter's projection, as records."""
    return mapped.where("reject_reason is null").select(*COLUMNS)


def outcomes(mapped: DataFrame) -> DataFrame:
    """source, outcome, n: rows kept, dropped by reason, and kept with each flag (``flag:`` before its name)."""
    each = F.concat(F.array(F.coalesce("reject_reason", F.lit("kept"))), F.when(F.col("reject_reason").isNull(), F.transform("flags", lambda f: F.concat(F.lit("flag:"), f))).otherwise(F.array().cast(NO_LIST)))
    return mapped.select("source", F.explode(each).alias("outcome")).groupBy("source", "outcome").agg(F.count(F.lit(1)).alias("n"))


def observed_authors(records: DataFrame) -> DataFrame:
    """author_id, source, handle, post_count, first_seen, last_seen: what the records say of each author but deleted ones.

    The handle is the latest one seen; ties go to the greatest.
    """
    known = records.where(F.col("author_id").isNotNull() & ~F.col("author_id").endswith(f":{DELETED_AUTHOR}"))
    latest = F.max(F.when(F.col("author_handle").isNotNull(), F.struct("timestamp", "author_handle"))).getField("author_handle")
    return known.groupBy("author_id").agg(F.min("source").alias("source"), latest.alias("handle"), F.count(F.lit(1)).alias("post_count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def length_floor(records: DataFrame, floors: Mapping[str, int]) -> DataFrame:
    """Records whose text has at least their source's least number of characters; sources without one stay."""
    least = F.lit(0)
    for source, n in floors.items():
        least = F.when(F.col("source") == source, n).otherwise(least)
    return records.where(F.coalesce(F.length("text"), F.lit(0)) >= least)


def eligible_records(records: DataFrame, excluded: tuple[str, ...] = ("gdelt", "news")) -> DataFrame:
    """The records with ``skip_reason``: null for those that can show coordination.

    Excluded sources, deleted authors, and sources (but mastodon) of which no record has a parent.
    """
    threaded = records.groupBy("source").agg(F.max(F.col("parent_id").isNotNull()).alias("_threaded"))
    flat = ~F.col("_threaded") & (F.col("source") != "mastodon")
    reason = F.when(F.col("source").isin(*excluded), "source_excluded").when(F.col("author_id").isNull() | F.col("author_id").endswith(f":{DELETED_AUTHOR}"), "author_deleted").when(flat, "no_threading")
    return records.join(F.broadcast(threaded), "source", "left").withColumn("skip_reason", reason).drop("_threaded")  # a row per source


def page_links(content: Column) -> Column:
    """http addresses of the links of HTML that are no hashtags or mentions, in order, each once."""
    anchors = F.regexp_extract_all(content, F.lit(r"(?i)(<a\b[^>]*>)"), F.lit(1))
    real = F.filter(anchors, lambda a: ~a.rlike(r"(?i)class=[\"'][^\"']*\b(?:hashtag|mention)\b") & ~a.rlike(r"(?i)rel=[\"'][^\"']*\btag\b"))
    links = F.transform(real, lambda a: F.regexp_replace(F.regexp_extract(a, r"(?i)href=[\"'](https?://[^\"']+)", 1), "&amp;", "&"))
    return F.coalesce(F.array_distinct(F.filter(links, lambda u: u != "")), F.array().cast(NO_LIST))
