"""Evaluation, narrative, file and state operators on small fixtures."""

import datetime as dt
import json
import zipfile

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from threadloom.operators import coordination as C
from threadloom.operators import evaluation as E
from threadloom.operators import narratives as N
from threadloom.operators.neighbours import first_of_kind
from threadloom.sources import files, state


def test_folds_and_holdouts_keep_groups(spark):
    df = spark.range(400).select(F.col("id"), F.concat(F.lit("g"), (F.col("id") % 37).cast("string")).alias("g"), (F.col("id") % 37 % 2).cast("string").alias("y"), (F.col("id") % 5).cast("string").alias("d"))
    df = df.withColumn("g", F.when(F.col("id") != 7, F.col("g")))
    rows = E.grouped_kfold(df, "g", "y", 4).collect()
    assert len(rows) == 400 and {r["fold"] for r in rows} == {0, 1, 2, 3}
    folds = {}
    for r in rows:
        if r["g"]:
            folds.setdefault(r["g"], set()).add(r["fold"])
    assert all(len(f) == 1 for f in folds.values())
    sizes = np.bincount([r["fold"] for r in rows])
    assert sizes.max() - sizes.min() <= 24
    with pytest.raises(ValueError):
        E.grouped_kfold(df.where("g = 'g1'"), "g", "y", 4)
    held = E.domain_holdout(df, "d", ["1", "2"], "g").groupBy("d", "split").count().collect()
    assert {r["d"] for r in held if r["split"] == "test"} == {"1", "2"} == {r["d"] for r in held if r["d"] in "12"}
    mixed = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train"), (None, "test")], "k string, s string")
    assert [tuple(r) for r in E.overlap(mixed, "s", "k").collect()] == [("k", "a", ["test", "train"])]


def test_fusion_ignores_what_is_not_measured(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (0.2, 0.4), (float("nan"), 0.5)], "a double, b double")
    assert [r[0] for r in df.select(E.fused([F.col("a"), F.col("b")])).collect()] == [1.0, None, pytest.approx(0.3), 0.5]
    assert {r["column"]: r["share"] for r in E.coverage(df, ["a", "b"]).collect()} == {"a": 0.75, "b": 0.5}
    assert E.pair_coverage(df, ["a", "b"]).first()["share"] == 0.5
    got = {r["configuration"]: (r["share"], r["mean"]) for r in E.ablation(df.where("a is null or not isnan(a)"), {"both": ["a", "b"], "none": ["x"]}).collect()}
    assert got == {"both": (pytest.approx(0.666667), 0.65), "none": (0.0, None)}
    one = spark.createDataFrame([([0.1, 0.9, None, 0.5],), ([],), (None,)], "s array<double>")
    assert [r[0] for r in one.select(E.top_mean(F.col("s"), 2)).collect()] == [0.7, 0.0, None]
    assert spark.range(1).select(E.dominant({"x": F.lit(1.0), "y": F.lit(1.0), "z": F.lit(None)})).first()[0] == "x"
    rules = {"short": F.col("a") < 0.5, "odd": F.col("b") > 9}
    assert {r["category"]: r["n"] for r in E.categories(df, rules).collect()} == {"short": 1, "odd": 0, "uncategorized": 3}


def test_calibrators_and_intervals(spark):
    rng = np.random.default_rng(3)
    s = rng.random(600)
    rows = [(int(i), float(x), int(rng.random() < x**2)) for i, x in enumerate(s)]
    df = spark.createDataFrame([*rows, (999, None, 1)], "id bigint, s double, y int")
    for method in ("platt", "isotonic"):
        c = E.Calibrator.from_state(E.Calibrator.fit(df, "s", "y", method).state())
        got = df.orderBy("s").select("s", c.transform(F.col("s")).alias("p")).collect()
        p = [r["p"] for r in got if r["s"] is not None]
        assert c.method == method and got[0]["p"] is None and all(b >= a - 1e-9 for a, b in zip(p, p[1:])) and 0 <= p[0] and p[-1] <= 1
        assert abs(np.mean(p) - np.mean([r[2] for r in rows])) < 0.03
    assert E.Calibrator.fit(df.where("y = 1"), "s", "y").method == "none"
    mean = F.sum(F.col("w") * F.col("y")) / F.sum("w")
    got = E.bootstrap(df.where("s is not null"), mean, "id", draws=60)
    assert got["low"] < got["value"] < got["high"] and got["high"] - got["low"] < 0.12
    assert np.isnan(E.bootstrap(df.limit(3), mean, "id")["low"])


def test_narrative_measures(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(f"r{k}", "n1" if k < 4 else "n2", f"a{k % 2}", "reddit" if k % 3 else "news", t + dt.timedelta(hours=k), ["x.example"], ["tag", f"t{k}"], [1.0, float(k)], 0.1 * k, 1.0) for k in range(6)]
    df = spark.createDataFrame(rows, "id string, narrative_id string, author_id string, source string, timestamp timestamp, domains array<string>, hashtags array<string>, v array<double>, p double, w double")
    one = {r["narrative_id"]: r for r in N.narrative_rows(df).collect()}
    assert (one["n1"]["size"], one["n1"]["n_authors"], one["n1"]["platforms"], one["n1"]["top_hashtags"][0]) == (4, 2, ["news", "reddit"], "tag")
    values, weights = np.array([0.0, 0.1, 0.2, 0.3]), np.ones(4)
    want = np.interp(0.75, (np.cumsum(weights) - 0.5) / 4, values)
    levels = {r["narrative_id"]: r["threshold"] for r in N.weighted_percentile(df, "narrative_id", "p", "w", 0.75).collect()}
    assert levels["n1"] == pytest.approx(want)
    assert {r["narrative_id"]: r["severity"] for r in N.severity(df, "narrative_id", "p", "w").collect()} == {"n1": pytest.approx(0.3), "n2": pytest.approx(0.5)}
    centers = N.centroids(df, "narrative_id", "v")
    center = {r["narrative_id"]: r["centroid"] for r in centers.collect()}
    mean = np.array([1.0, 1.5])
    assert np.allclose(center["n1"], mean / np.linalg.norm(mean))
    best = N.representatives(df, centers, "narrative_id", "v", "source", "id", 2).where("narrative_id = 'n1'").orderBy("rank").collect()
    assert [r["id"] for r in best] == ["r2", "r3"]  # the nearest of reddit, then the nearest of news
    old = spark.createDataFrame([("o1", [1.0, 0.0]), ("o2", [0.0, 1.0])], "id string, centroid array<double>")
    new = spark.createDataFrame([("m1", [0.99, 0.1]), ("m2", [1.0, 0.0]), ("m3", [-1.0, 0.0])], "id string, centroid array<double>")
    assert [tuple(r)[:2] for r in N.carry_ids(new, old).collect()] == [("m2", "o1")]
    get = lambda c: spark.range(1).select(c).first()[0]
    assert get(N.label_of(F.lit("See https://x.example now. Then more."))) == "See now." and get(N.label_of(F.lit(None))) == "(untitled narrative)"
    assert len(get(N.label_of(F.lit("word " * 60)))) <= 90 and get(N.prepared(F.lit("a  bb ccc"), 5)) == ("a bb", True)
    assert N.mint_id([0.1, 0.2]) == N.mint_id([0.10000001, 0.2]) != N.mint_id([0.2, 0.1])


def test_files_and_labels(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,news_url\n1,"two\nlines ""q""",https://www.x.example/a\n,Text,\n,,\n', encoding="utf-8")
    news = files.labelled_news([(files.read_csv(spark, f"{tmp_path}/a.csv"), 1)]).orderBy("text").collect()
    assert [(r["claim_id"], r["outlet"]) for r in news][1] == ("1", "x.example") and news[1]["text"] == 'two\nlines "q"' and news[0]["outlet"] is None
    lines = '{"id": 1, "t": "x"}\nbroken\n'
    (tmp_path / "b.zst").write_bytes(zstandard.compress(lines.encode()))
    got = files.read_zstd_lines(spark, f"{tmp_path}/b.zst", "id bigint, t string").collect()
    assert [(r["id"], r["_corrupt_record"] is None) for r in got] == [(1, True), (None, False)]
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("c.tsv", 'a\t"b\n1\t2\t3\t4\n')
    assert [tuple(r) for r in files.read_zipped_tsv(spark, f"{tmp_path}/c.zip", ["x", "y", "z"]).collect()] == [("a", '"b', None), ("1", "2", "3")]
    (tmp_path / "d.json").write_text(json.dumps({"data": [{"id": 1}, {"id": 2}]}))
    assert sorted(r["id"] for r in files.read_json(spark, f"{tmp_path}/d.json").collect()) == [1, 2]
    (tmp_path / "e.tsv").write_text("1\tfalse\tA claim\ts\tAnn\n2\thalf-true\tOther\ts\tBob\n3\tTrue\tThird\ts\t\n")
    rated = files.six_way_statements(files.read_tsv(spark, f"{tmp_path}/e.tsv", files.SIX_WAY_COLUMNS)).orderBy("text").collect()
    assert [(r["text"], r["label"]) for r in rated] == [("A claim", 1), ("Third", 0)] and rated[1]["split_group"].startswith("unknown-")
    claims = spark.createDataFrame([("Same", 1), ("same", 0), ("Sure", 1), ("Sure", 1), (None, 1)], "c string, y int")
    assert [tuple(r)[:2] for r in files.consistent_claims(claims, "c", "y").collect()] == [("Sure", 1)]
    assert [r["stance"] for r in files.stance_pairs(spark.createDataFrame([("t", "x", " FAVOR "), ("t", "y", "?")], "a string, b string, c string"), "a", "b", "c").collect()] == ["support"]
    users = spark.createDataFrame([("1", "5"), ("2", "x")], "id string, followers_count string")
    assert [(r["split_group"], r["followers"]) for r in files.account_rows({"spam": (users, 1), "people": (users, 0)}).orderBy("split_group").collect()] == [("genuine:1", 5), ("genuine:2", None), ("spam", 5), ("spam", None)]


def test_state_survives_and_resets(spark, tmp_path):
    m = state.Manifest(f"{tmp_path}/m.json")
    m.update("scores", 3, {"bot": "1"})
    m.artifact("model", sha256="x")
    assert m.summary()[0]["rows"] == 3 and "model" in m.read()["artifacts"]
    c = state.Cursor(f"{tmp_path}/c.json")
    c.mark_done("u")
    assert c.bump("n") == 1 and state.Cursor(f"{tmp_path}/c.json").is_done("u") and not c.is_done("v")
    day = [dt.date(2024, 1, 1)]
    q = state.Quota(f"{tmp_path}/q.json", 10, lambda: day[0])
    assert q.charge(8, "search") == 2 and q.count("search") == 1
    with pytest.raises(RuntimeError):
        q.charge(3)
    day[0] = dt.date(2024, 1, 2)
    assert q.charge(3) == 7 and q.count("search") == 0
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree/a").write_text("1")
    (tmp_path / "tree/b").write_text("2")
    assert state.tree_digest(spark, f"{tmp_path}/tree")[1] == 2
    table = spark.createDataFrame([("a", {"bot": "1", "x": "2"}), ("b", {"bot": "0"}), ("c", None)], "k string, model_versions map<string,string>")
    assert [r["k"] for r in E.already_scored(table, ["k"], {"bot": "1"}).collect()] == ["a"]


def test_evidence_links_accounts_and_hubs(spark):
    t = dt.datetime(2024, 1, 1, 0, 10)
    shape = "id string, author_id string, timestamp timestamp, urls array<string>, domains array<string>, hashtags array<string>, parent_id string"
    rows = [(f"r{k}", f"a{k}", t, ["u"] if k < 3 else None, None, ["x", "y"] if k in (3, 4) else ["x"], "p" if k in (0, 5) else None) for k in range(6)]
    rows += [("late", "a9", t + dt.timedelta(hours=5), ["u"], None, None, None), ("gone", "reddit:__deleted__", t, ["u"], None, None, None), ("none", None, t, ["u"], None, None, None), rows[0]]
    df = spark.createDataFrame(rows, shape)
    pairs = {(r["src"], r["dst"], r["kind"]): r["observations"] for r in C.record_edges(df).collect()}
    assert pairs == {("a0", "a1", "cotweet"): 1, ("a0", "a2", "cotweet"): 1, ("a1", "a2", "cotweet"): 1, ("a3", "a4", "hashtag_seq"): 1, ("a0", "a5", "temporal"): 1}
    hubs = [r for r in C.record_edges(df, most=2).collect() if r["kind"] == "cotweet"]
    assert len(hubs) == 3 and all("key:" in r["src"] + r["dst"] for r in hubs)
    two = spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "src string, dst string, weight double")
    split = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "node string, community string")
    assert C.modularity(two, split) == pytest.approx(0.5) and C.modularity(two.where("false"), split) is None
    moved = C.shuffled_times(df.where("author_id is not null"), 1)
    times = lambda d: sorted((r["author_id"], r["timestamp"]) for r in d.select("author_id", "timestamp").collect())
    assert times(moved) == times(df.where("author_id is not null"))


def test_first_of_kind_is_the_greedy_choice(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 6)
    rows = []
    for k in range(160):
        h = int(base[rng.integers(6)])
        for _ in range(rng.integers(0, 4)):
            h ^= 1 << int(rng.integers(0, 20))
        rows.append((f"r{k:03}", h if k % 11 else None if k % 2 else 0))
    near = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1") <= 3
    reps, want = [], {}
    for key, h in rows:
        hit = next((r for r, g in reps if h and near(h, g) and (h >> 48) == (g >> 48)), key)
        want[key] = hit
        if hit == key and h:
            reps.append((key, h))
    df = spark.createDataFrame([*rows, rows[3], (None, 5)], "id string, simhash bigint")
    assert {r["id"]: r["representative"] for r in first_of_kind(df).collect()} == want
    assert first_of_kind(df.where("false")).collect() == []
