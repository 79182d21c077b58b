"""Adapters from raw rows to records on small fixtures."""

import datetime as dt

from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators import records as R


def test_reddit_rows_and_reasons(spark):
    shape = "id string, speaker_id string, conversation_id string, reply_to string, timestamp string, text string, meta struct<score: bigint, subreddit: string>, corpus string, source string"
    rows = [
        ("a", "Ann", "a", None, "1700000000", "Look https://x.example/a?utm_source=q&B=1 #Tag", (5, "news"), "c", "clash"),
        ("b", "[deleted]", "a", "a", "1700000000000", "answer", (None, None), "c", None),
        ("c", "Bob", "a", "a", "1700000001", "[removed]", None, None, None),
        ("d", "Bob", "a", "a", None, "late", None, None, None),
        ("", "Bob", "a", "a", "1700000001", "no id", None, None, None),
        ("e", "Bob", None, None, "1700000001", "  ", None, None, None),
    ]
    mapped = R.reddit_records(spark.createDataFrame(rows, shape))
    kept = {r["id"]: r for r in R.records_of(mapped).collect()}
    assert set(kept) == {"reddit:a", "reddit:b"}
    a, b = kept["reddit:a"], kept["reddit:b"]
    assert (a["source_detail"], a["content_type"], a["author_id"], a["engagement"]["likes"], a["hashtags"], a["urls"], a["domains"]) == ("news", "post", "reddit:Ann", 5, ["tag"], ["https://x.example/a?B=1"], ["x.example"])
    assert (b["author_id"], b["author_handle"], b["parent_id"], b["source_detail"], b["engagement"]["likes"]) == ("reddit:__deleted__", None, "reddit:a", "c", None)
    assert a["timestamp"] == b["timestamp"]
    got = {r["outcome"]: r["n"] for r in R.outcomes(mapped).collect()}
    assert got == {"kept": 2, "flag:author_deleted": 1, "deleted_text": 1, "missing_timestamp": 1, "missing_id": 1, "empty_text": 1}
    authors = R.observed_authors(R.records_of(mapped)).collect()
    assert [(r["author_id"], r["post_count"]) for r in authors] == [("reddit:Ann", 1)]


def test_boosts_take_text_and_counts_of_the_boosted(spark):
    status = "id: string, content: string, favourites_count: bigint, reblogs_count: bigint, replies_count: bigint, tags: array<struct<name: string>>"
    shape = "id string, content string, favourites_count bigint, reblogs_count bigint, replies_count bigint, tags array<struct<name: string>>, created_at string, in_reply_to_id string, account struct<id: string, acct: string>, reblog struct<" + status + ">"
    rows = [
        ("1", "<p>own &amp; text</p>", 1, 2, 3, [("Cat",)], "2024-05-01T10:00:00Z", None, ("7", "ann@x.example"), None),
        ("2", None, 0, 0, 0, None, "2024-05-01T10:00:00Z", None, ("8", "bob"), ("1", "<p>own &amp; text</p>", 1, 2, 3, None)),
        ("3", "<p></p>", 0, 0, 0, None, "2024-05-01T10:00:00Z", None, ("8", "bob"), None),
    ]
    mapped = R.mastodon_records(spark.createDataFrame(rows, shape))
    kept = {r["id"]: r for r in R.records_of(mapped).collect()}
    assert set(kept) == {"mastodon:1", "mastodon:2"} and kept["mastodon:2"]["text"] == "own & text"
    assert (kept["mastodon:2"]["content_type"], kept["mastodon:2"]["parent_id"], kept["mastodon:2"]["engagement"]["likes"]) == ("boost", "mastodon:1", 1)
    assert (kept["mastodon:1"]["conversation_id"], kept["mastodon:1"]["source_detail"], kept["mastodon:1"]["hashtags"]) == ("mastodon:1", "x.example", ["cat"])


def test_titles_links_and_maps(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(R.title_from_url(F.lit("https://a.example/2024/the-long-title-here.html?x=1"))) == "the long title here"
    assert get(R.title_from_url(F.lit("https://a.example/short"))) == "" and get(R.page_title(F.lit("<PAGE_TITLE> A b </PAGE_TITLE>"))) == "A b"
    page = '<a href="https://a.example/x?a=1&amp;b=2">x</a><a class="mention hashtag" href="https://b.example/t">#t</a><a href="mailto:q@x">q</a>'
    assert get(R.page_links(F.lit(page))) == ["https://a.example/x?a=1&b=2"] and get(R.page_links(F.lit(None).cast("string"))) == []
    assert get(T.is_short_link(F.lit("https://bit.ly/3"))) and not get(T.is_short_link(F.lit(None).cast("string")))
    flat = spark.createDataFrame([("1", "body", "ann", "2024-01-02 03:04:05", "7"), ("2", "body", None, "2024-01-02", "x")], "post_id string, selftext string, user string, created string, score string")
    kept = R.records_of(R.mapped_records(flat, "reddit", {"id": "post_id", "text": "selftext", "author": "user", "timestamp": "created", "likes": "score", "title": "missing"})).orderBy("id").collect()
    assert [(r["author_handle"], r["engagement"]["likes"], r["parent_id"]) for r in kept] == [("ann", 7, None), (None, None, None)]
    assert kept[0]["timestamp"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_word_hashes_equal_the_stored_ones(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/records.parquet").where("simhash is not null and text is not null").select("text", "simhash")
    wrong = rows.where(T.similarity_hash("text") != F.col("simhash")).count()
    assert rows.count() > 1000 and wrong == 0
