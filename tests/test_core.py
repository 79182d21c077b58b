"""The general operators on small fixtures, against brute force and against SQL."""

import datetime as dt
import glob
import os
import random
import unicodedata
from zoneinfo import ZoneInfo

import duckdb
import pytest
from pyspark.sql import functions as F

from threadloom.functions import text as T
from threadloom.operators.hierarchy import descendants, hierarchy
from threadloom.operators.ranking import rank_within
from threadloom.operators.timestamps import utc_micros
from threadloom.plans import registry
from threadloom.sources.store import ScoredTable, merge_status, read_records, upsert, write_records

SMALL = "/root/testdata/sf0.001"


def brute_hierarchy(rows):
    parents = {}
    for i, p in rows:
        if i is not None and (i not in parents or (p is not None and (parents[i] is None or p < parents[i]))):
            parents[i] = p
    out = {}
    for i in parents:
        path, x = [i], i
        while parents[x] in parents and parents[x] is not None:
            x = parents[x]
            if x in path:
                out[i] = (min(path[path.index(x) :]), -1)
                break
            path.append(x)
        else:
            out[i] = (x, len(path) - 1)
    return out


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"n{k:03}", f"n{rng.randrange(k):03}" if k and rng.random() < 0.9 else None) for k in range(120)]
    rows += [(f"c{k}", f"c{(k + 1) % 17}") for k in range(17)] + [("below", "c3"), ("self", "self"), ("lost", "gone")]
    rows += rows[:20] + [(None, "n001"), ("n005", None)]
    chain = [(f"x{k:03}", f"x{k - 1:03}" if k else None) for k in range(60)]
    df = spark.createDataFrame(rows + chain, "id string, parent_id string").withColumn("depth", F.lit("clash"))
    found = hierarchy(df, paths=True).collect()
    assert {r["id"]: (r["root_id"], r["depth"]) for r in found} == brute_hierarchy(rows + chain)
    paths = {r["id"]: r["path"] for r in found}
    assert paths["x059"] == [f"x{k:03}" for k in range(60)] and paths["below"] is None and paths["lost"] == ["lost"]
    under = {(r["ancestor_id"], r["id"]): r["distance"] for r in descendants(df).collect()}
    assert under[("x000", "x059")] == 59 and len([k for k in under if k[0] == "x050"]) == 9


def test_hierarchy_of_chains_below_loops(spark):
    rows = [(f"l{k}-{j}", f"l{k}-{1 - j}") for k in range(30) for j in range(2)]  # three in four have no splitter
    rows += [(f"d{k}-{j:02}", f"d{k}-{j - 1:02}" if j else f"l{k}-{k % 2}") for k in range(30) for j in range(3 + k)]
    found = hierarchy(spark.createDataFrame(rows, "id string, parent_id string"), paths=True).collect()
    assert len(found) == len(rows) and {r["id"]: (r["root_id"], r["depth"]) for r in found} == brute_hierarchy(rows)
    assert {r["path"] for r in found} == {None}


def test_hierarchy_of_nothing(spark):
    assert hierarchy(spark.createDataFrame([], "id string, parent_id string")).collect() == []


def utc(*a):
    return int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 10**6)


TIMES = [
    ("Tue, 06 Jun 2023 02:55:41 GMT", None, None, utc(2023, 6, 6, 2, 55, 41)),
    ("23 Sep 23 22:41 +0000", None, None, utc(2023, 9, 23, 22, 41)),
    ("Thu, 26 Oct 2023 10:50:00 PDT", None, None, utc(2023, 10, 26, 17, 50)),
    ("01/21/2024 04:33 AM", "America/New_York", "mdy", utc(2024, 1, 21, 9, 33)),
    ("04/05/2024 02:59", "Europe/London", "dmy", utc(2024, 5, 4, 1, 59)),
    ("12.05.2023 12:29", "Europe/Berlin", "dmy", utc(2023, 5, 12, 10, 29)),
    ("2025年1月6日 13:08", "Asia/Tokyo", "dmy", utc(2025, 1, 6, 4, 8)),
    ("30 de marzo de 2024, 23:56", "Europe/Madrid", "dmy", utc(2024, 3, 30, 22, 56)),
    ("16. März 2024, 00:48 Uhr", "Europe/Berlin", "dmy", utc(2024, 3, 15, 23, 48)),
    ("12 mars 2023 à 19:19", "Europe/Paris", "dmy", utc(2023, 3, 12, 18, 19)),
    ("April 26, 2025, 12:53 am", None, None, utc(2025, 4, 26, 0, 53)),
    ("2023-10-01t08:55:04z", None, None, utc(2023, 10, 1, 8, 55, 4)),
    ("2023-05-22T04:16:54.010908000Z", None, None, utc(2023, 5, 22, 4, 16, 54, 10908)),
    ("2024-10-27 02:30:00", "Europe/Berlin", None, utc(2024, 10, 27, 0, 30)),  # occurs twice: the first
    ("2024-03-31 02:30:00", "Europe/Berlin", None, utc(2024, 3, 31, 1, 30)),  # skipped: offset before
    ("2024-02-29T24:00:00", None, None, utc(2024, 3, 1)),
    ("20231219083000.0", None, None, utc(2023, 12, 19, 8, 30)),
    ("20240728", None, None, utc(2024, 7, 28)),
    ("  2023-08-10T14:10Z ", None, None, utc(2023, 8, 10, 14, 10)),
    ("2023-06-17 23:50:18-03:30", None, None, utc(2023, 6, 18, 3, 20, 18)),
    ("2023-02-29T08:00:00Z", None, None, None), ("2024-13-05T08:07:36Z", None, None, None), ("0000-00-00 00:00:00", None, None, None),
    ("Fri, 25:61", None, None, None), ("2.02405E+13", None, None, None), ("20231", None, None, None), ("", None, None, None), (None, None, None, None),
    ("1970-01-01T00:00:00Z", None, None, None), ("2031-01-01T00:00:00Z", None, None, None), ("13/13/2024 10:00 PM", None, None, None), ("x" * 100_000, None, None, None),
]


def test_times(spark):
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(TIMES)], "k int, v string, tz string, o string, want bigint")
    wrong = utc_micros(df, F.col("v"), F.col("tz"), F.col("o")).where("not (utc_us <=> want)").collect()
    assert wrong == []


def test_unix_times(spark):
    rows = [("1726430665", utc(2024, 9, 15, 20, 4, 25)), ("1724478548435", 1724478548435000), ("1686607197807282", 1686607197807282), ("1.688312093E9", 1688312093000000), ("1733505030.162", 1733505030162000), ("0", None), ("-1", None), ("1e3", None), ("NaN", None), ("9" * 20, None)]
    df = spark.createDataFrame(rows, "v string, want bigint")
    assert utc_micros(df, F.col("v"), unix=True).where("not (utc_us <=> want)").collect() == []


def test_times_against_zoneinfo(spark):
    rng, rows = random.Random(3), []
    for _ in range(200):
        zone = rng.choice(["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "America/Bogota"])
        t = dt.datetime(2023, 1, 1) + dt.timedelta(minutes=rng.randrange(3 * 525600))
        at = t.replace(tzinfo=ZoneInfo(zone), fold=0)
        rows.append((t.strftime(rng.choice(["%Y-%m-%dT%H:%M:%S", "%d %b %Y %H:%M:%S", "%B %d, %Y, %I:%M %p"])), zone, int(at.timestamp() * 10**6)))
    df = spark.createDataFrame(rows, "v string, tz string, want bigint")
    assert utc_micros(df, F.col("v"), F.col("tz")).where("not (utc_us <=> want)").collect() == []


def test_rank_within_a_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2990, F.col("id").cast("string")).alias("g"), "id")
    ranks = {}
    for r in rank_within(df, ["g"], F.xxhash64("id"), 8).collect():
        ranks.setdefault(r["g"], []).append(r["rank"])
    assert sorted(ranks["hot"]) == list(range(2500)) and sorted(ranks[None]) == list(range(10))


def test_text_functions(spark):
    df = spark.createDataFrame([("See HTTPS://A.Example/x?utm_source=q&id=7#top, and (https://b.test/y). #Tag #tag @bob @bob@x.test",)], "t string")
    r = df.select(T.text_urls(F.col("t")).alias("u"), T.hashtags(F.col("t")).alias("h"), T.mentions(F.col("t")).alias("m"), T.registrable_domain(F.lit("https://www.a.co.uk/x")).alias("d")).first()
    assert r["u"] == ["https://b.test/y"] and r["h"] == ["tag"] and r["m"] == ["bob@x.test"] and r["d"] == "a.co.uk"
    assert T.tidy(T.strip_markup("<p>a&amp;lt;b</p><p>c​d</p>")) == "a<b\ncd"
    assert T.word_hash("") == 0 and T.word_hash("one two three four") == T.word_hash("One two  three four")


def brute_tags(text):
    """By hand, one character at a time: letters, marks, decimal digits and connectors make a tag of up to 139."""
    word = lambda c: unicodedata.category(c)[0] in "LM" or unicodedata.category(c) in ("Nd", "Nl", "Pc")
    tags, k = set(), 0
    while k < len(text or ""):
        end = k + 1
        if text[k] == "#" and not (k and (word(text[k - 1]) or text[k - 1] == "&")):
            while end < len(text) and word(text[end]) and end - k <= 139:
                end += 1
            if end > k + 1:
                tags.add(text[k + 1 : end].lower())
        k = end
    return ",".join(sorted(tags))


def test_hashtags_of_all_texts(spark, tmp_path):
    texts = ["#Größe und #ÉTÉ, #été", "#a#b #c", "é#x &#39; &#y", "#日本語 と#東京 、#大阪", "#हिन्दी #Привет_мир!", "plain #Tag #tag", "# #", "#" + "ü" * 200, "", None, "no tag"]
    one = spark.read.parquet(f"{SMALL}/records.parquet").limit(1)
    rows = spark.createDataFrame([(f"t{k}", t) for k, t in enumerate(texts)], "i string, t string").crossJoin(one)
    rows.select(*[F.col({"id": "i", "text": "t"}.get(c, c)).alias(c) for c in one.columns]).write.parquet(f"{tmp_path}/records.parquet")
    got = {r["id"]: r["tags"] for r in registry.queries()["text_hashtags_all"](spark, str(tmp_path)).collect()}
    assert got == {f"t{k}": brute_tags(t) for k, t in enumerate(texts)}


def test_corpus_and_upsert(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/records.parquet")
    root = f"file://{tmp_path}/corpus"
    first = write_records(rows, root)
    assert first["written"] == rows.select("id").distinct().count()
    assert write_records(rows, root) == {"written": 0, "duplicates": rows.count()}
    assert read_records(spark, root, ["reddit"]).where("source <> 'reddit'").isEmpty()

    from pyspark.sql import types as Ty

    schema = Ty.StructType().add("k", "string").add("x", "float").add("at", "timestamp")
    contract = ScoredTable("scores", schema, ("k",), ("at",))
    new = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, x float").withColumn("at", F.current_timestamp())
    assert upsert(spark, f"file://{tmp_path}/s", contract, new)["written"] == 2
    again = upsert(spark, f"file://{tmp_path}/s", contract, new.withColumn("at", F.current_timestamp()))
    assert again["unchanged"] == 2 and not again["written"] + again["updated"]
    changed = spark.createDataFrame([("a", 2.0)], "k string, x float")
    assert upsert(spark, f"file://{tmp_path}/s", contract, changed) == {"written": 0, "updated": 1, "unchanged": 0, "kept": 1, "dropped": 0}
    with pytest.raises(ValueError, match="unexpected"):
        upsert(spark, f"file://{tmp_path}/s", contract, changed.withColumn("y", F.lit(1)))
    assert merge_status(changed, changed, ["k"], merge=False).first()["status"] == "unchanged"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    df = registry.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    got = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    assert got == sorted(tuple(map(plain, r)) for r in want.fetchall())
