"""The training-data operators on small fixtures: brute force, planted cases and held-out accuracy."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import language, leakage, mixing, neardup, sentences, splits, subsets, truncation

SMALL = "/root/testdata/sf0.001"
WORDS = "river council report video claim share harbour letter mayor census ballot ferry tower grain school clinic archive desk radio story query budget".split()


def sentence(rng, n=9):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def test_similar_pairs_against_brute_force(spark):
    rng = random.Random(4)
    base = [sentence(rng, 50).split() for _ in range(25)]
    rows = []
    for k, words in enumerate(base):
        rows.append((f"a{k}", " ".join(words)))
        for j in range(3):
            changed = list(words)
            for _ in range(rng.randrange(9)):
                changed[rng.randrange(len(changed))] = rng.choice(WORDS)
            rows.append((f"b{k}-{j}", "  ".join(changed).upper()))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1]), ("copy1", rows[0][1]), ("short", "one two"), ("none", None), ("empty", ""), (None, rows[1][1]), ("han", "词" * 80)]
    df = spark.createDataFrame(rows, "id string, text string").withColumn("doc", F.lit("clash"))
    got = {(r["id_a"], r["id_b"]) for r in neardup.similar_ids(*neardup.similar_pairs(df, 3, 0.5, 36)).collect()}
    sets = {}
    for i, t in rows:
        w = neardup.words_of(t or "")
        if i and len(w) >= 36 and "词" not in t:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert got == want and ("copy1", "copy2") in got


def test_similar_pairs_in_large_nodes(spark):
    n, shared = 300, " ".join(f"shared{k}" for k in range(44))
    rows = [(f"d{k:03}", shared + " " + " ".join(f"own{k}x{j}" for j in range(18))) for k in range(n)]  # any two: 42 of 78 shingles
    members, pairs = neardup.similar_pairs(spark.createDataFrame(rows, "id string, text string"), 3, 0.5, 36)
    assert members.count() == n and pairs.count() > 0.97 * n * (n - 1) / 2


def test_no_pairs_of_nothing(spark):
    members, pairs = neardup.similar_pairs(spark.createDataFrame([], "id string, text string"))
    assert members.collect() == [] and pairs.collect() == []


def test_components_against_union_find(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [("z1", "z2"), ("z2", "z3"), ("z3", "z1"), (None, "n1"), ("q", "q")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_normal_keys(spark):
    rows = [("reddit: U/Bena_1g ", "reddit:bena_1g"), ("reddit:/u/bena_1G", "reddit:bena_1g"), ("mastodon:12\t", "mastodon:12"), ("youtube:UCa ", "youtube:UCa"), ("reddit:__deleted__", None), (None, None)]
    df = spark.createDataFrame(rows, "k string, want string")
    assert df.where(~splits.normal_author(F.col("k")).eqNullSafe(F.col("want"))).collect() == []
    same = spark.createDataFrame([(" 31.0", "31"), ("0031 ", "31"), ("0", "0"), ("", None)], "k string, want string")
    assert same.where(~splits.normal_body(F.col("k")).eqNullSafe(F.col("want"))).collect() == []
    users = spark.createDataFrame([("u0100391", "100391"), (" U100391", "100391"), ("100391", "100391")], "k string, want string")
    assert users.where(~splits.normal_user(F.col("k")).eqNullSafe(F.col("want"))).collect() == []


@pytest.mark.parametrize("sizes", [{1: 1000}, {7: 3, 5: 2, 1: 1}, {100: 1, 3: 40, 2: 9}, {500: 1, 1: 500}, {}])
def test_subset_sums(sizes):
    plan = splits.subset_sum_plan(sizes)
    assert {s: sum(p.get(s, 0) for p in plan) for s in sizes} == sizes and all(n >= 0 for p in plan for n in p.values())
    total = sum(s * c for s, c in sizes.items())
    if total:
        items = [s for s, c in sizes.items() for _ in range(c)]
        reach = {0}
        for s in items:
            reach |= {r + s for r in reach if r + s <= total}
        got = sum(s * n for s, n in plan[1].items())
        assert abs(got - total / 10) <= min(abs(r - round(total / 10)) for r in reach) + 1


def test_splits_keep_components_together(spark):
    rows = splits.assign_splits(spark, SMALL).collect()
    by = {(r["table_name"], r["key"]): r["split"] for r in rows}
    for r in splits.same_split_pairs(spark, SMALL).collect():
        assert by[(r["table_name"], r["key_a"])] == by[(r["table_name"], r["key_b"])] and r["key_a"] < r["key_b"]


def test_every_row_gets_a_split(spark, tmp_path):
    counts = {}
    for name, column in (("authors", None), ("records", "author_id"), ("train_stances", "body_id"), ("users", "id")):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if column:
            lot = F.pmod(F.xxhash64(*rows.columns), F.lit(3))
            rows = rows.withColumn(column, F.when(lot == 0, F.lit(None)).when(lot == 1, F.lit(" ") if name != "records" else F.lit("reddit:__deleted__")).otherwise(F.col(column)))
            rows = rows.withColumn("id", F.when(F.length("text") % 2 == 0, F.col("id"))) if name == "records" else rows
            counts[name] = rows.count()
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    grouped = {(r["table_name"], r["key"], r["split"]): r["n_rows"] for r in splits.split_rows(spark, str(tmp_path)).collect()}
    assert {t: sum(n for k, n in grouped.items() if k[0] == t) for t in counts} == counts
    assert all({k[2] for k in grouped if k[0] == t and k[1] is None} == set(splits.SPLITS) for t in counts)
    single = splits.row_splits(spark, str(tmp_path)).groupBy("table_name", "key", "split").count().collect()
    assert {(r["table_name"], r["key"], r["split"]): r["count"] for r in single} == grouped


@pytest.mark.parametrize("seed", range(4))
def test_fit_lengths(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(3, 60): rng.randrange(1, 6) for _ in range(8)}
    total = sum(n * c for n, c in counts.items())
    target = rng.randrange(total)
    take = mixing.fit_lengths(target, counts)
    assert all(0 <= k <= counts[n] for n, k in take.items())
    reach = {0}
    for n, c in counts.items():
        reach = {r + n * k for r in reach for k in range(c + 1)}
    assert abs(sum(n * k for n, k in take.items()) - target) <= min(abs(r - target) for r in reach) + 3


def test_mix_reports_what_it_selects(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    selection, shares = mixing.mix(docs, spark.read.parquet(f"{SMALL}/mix_targets.parquet"))
    got = {r["source"]: r["t"] for r in selection.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    report = shares.collect()
    assert {r["source"]: r["tokens"] for r in report if r["tokens"]} == got
    assert abs(sum(r["reached_share"] for r in report) - 1) < 1e-9


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    held = docs.where("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("row_id"), F.col("lang").alias("label"), "text")
    sample = language.labelled_sample(docs.where("doc_id % 4 <> 0"))
    found = {}
    for r in language.detect(held, sample).collect():
        found.setdefault(r["row_id"], set()).add(r["lang"])
    right = sum(found.get(r["row_id"]) == {r["label"]} for r in held.collect())
    assert right / held.count() > 0.97


def test_language_of_mixed_and_odd_texts(spark):
    sample = language.labelled_sample(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [
        ("mixed", None, "The council told the archive that nobody could confirm the claim about the ballots. Nach Angaben des Archivs prüften Freiwillige die Behauptung über die Wasserproben."),
        ("short", None, "no way"), ("none", None, None), ("empty", None, ""), ("link", None, "https://a.example/b"), ("long", "en", "The mayor said that the report was wrong. " * 3000),
    ]
    got = {}
    for r in language.detect(spark.createDataFrame(rows, "row_id string, label string, text string"), sample).collect():
        got.setdefault(r["row_id"], set()).add(r["lang"])
    assert got == {"mixed": {"en", "de"}, "long": {"en"}}


def test_truncation_on_held_out_cuts(spark):
    rows = [(r["text"], []) for r in spark.read.parquet("/root/testdata/sf0.01/records.parquet").select("text").distinct().limit(3000).collect()]
    weights, known = truncation.train(rows[:2400])
    rng, right, n = random.Random(9), 0, 0
    for text, limits in rows[2400:]:
        for piece, bucket, cut in truncation.examples(text, limits, rng):
            slots, kind = truncation.features(piece, known)
            right += (weights[slots + truncation.limit_slots(bucket, kind)].sum() > 0) == cut
            n += 1
    assert right / n > 0.85


def test_truncation_of_odd_rows(spark):
    schema = "id string, source string, source_detail string, text string"
    rows = [("a", None, None, None), ("b", "news", None, ""), (None, "news", "x", "The mayor said it."), ("c", "news", "x", "The mayor said that the re…" * 2000)]
    assert truncation.score(spark.createDataFrame(rows, schema)).count() == 4
    assert truncation.score(spark.createDataFrame([], schema)).count() == 0


def test_leaks_of_many_edited_copies(spark):
    rng = random.Random(12)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(63)]
    edited = lambda k: [w if (j + k) % 8 else f"new{rng.randrange(10**6)}" for j, w in enumerate(words)]
    other = [w for _ in range(12) for w in rng.sample(words, len(words))]  # the same words in no order
    docs = [(1, [w for k in range(12) for w in edited(k)]), (2, edited(0) + other + edited(3)), (3, other)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id bigint, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    assert sorted(map(tuple, leakage.find_leaks(df, items).collect())) == [(1, 5), (2, 5)]


def test_leaks(spark):
    rng = random.Random(2)
    opener = "rate the statement on the six step scale from plainly false to wholly true and give one reason "
    items = [(k, opener + sentence(rng, 60)) for k in range(8)] + [(99, None)]
    words = items[3][1][len(opener) :].split()
    near = list(words[5:45])
    for k in (6, 14, 22, 30):
        near[k] = "changed"
    far = list(words[5:45])
    for k in range(0, 40, 4):
        far[k] = "changed"
    docs = [
        (1, sentence(rng, 40) + " " + " ".join(words[10:24]).upper().replace(" ", ",\n ") + " " + sentence(rng, 40)),
        (2, sentence(rng, 20) + " " + " ".join(words[10:23]) + " " + sentence(rng, 20)), (3, sentence(rng, 20) + " " + " ".join(near) + " " + sentence(rng, 20)),
        (4, " ".join(far)), (5, opener + sentence(rng, 30)), (6, None), (7, ""), (8, items[5][1]), (8, items[5][1]), (9, sentence(rng, 9000) + " " + items[0][1]),
    ]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 3), (3, 3), (8, 5), (9, 0)]
    assert leakage.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).collect() == []


CORPUS = {"dr": "t", "prof": "t", "inc": "a", "p.m": "a", "no": "n", "u.s": "a", "nr": "n"}
SENTENCES = [
    "Dr. Vol met J. R. Lem of Hadi Inc. at 6 p.m.|The row no. 65 was wrong.|It rose to 3.5 points.",
    "Ann wrote: “Nobody counted twice. We opened every box.”|Two weeks later it rained.",
    "“Is this true?” asked Ben in Rome.|(The entry was corrected. Later again.)|It ends here. 👀 #tag",
    "A heading\n\n|The first line\ngoes on here.|The next one is.Wait, what?!|So it goes ... but on it went.",
    "这是真的吗？|“没有人数两遍。我们查过每个箱子。”他说。|比例升到22.1%。",
    "葵さんは「二度は数えていない。全部見た。」と書いた。|（後で直した。）",
    "ในเมืองนี้มีคน 15 คน|ไม่มีใครรู้ว่าเขาเห็นอะไร",
    "क्या यह सच है?|किसी ने दो बार नहीं गिना।|हमने सब जांचा।",
    "هل هذا صحيح؟|كتب هام: «لم يحسب أحد مرتين. فحصنا.»|قبل أن ترد.",
    "Am 3. Mai kam Prof. Bu nach Rom.|Die Nr. 41 fehlt.",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_sentences(marked):
    parts = [p.strip() for p in marked.split("|")]
    glue = "" if any("一" <= c <= "鿿" for c in marked) else " "
    text = glue.join(marked.split("|")).replace("is. Wait", "is.Wait")
    got = [text[a:b] for a, b in sentences.segment(text, CORPUS)]
    want = [x for p in parts for x in (p.split(".Wait") if ".Wait" in p else [p])]
    if len(want) != len(parts):
        want = [w + "." if w.endswith("one is") else "Wait" + w if w.startswith(", what") else w for w in want]
    assert got == want


def test_sentences_of_documents(spark):
    docs = spark.createDataFrame([(1, "One. Two."), (1, "One. Two."), (2, None), (3, "  \n "), (4, "word " * 50_000)], "doc_id bigint, text string")
    got = sorted(tuple(r) for r in sentences.split_sentences(docs).collect())
    assert got == [(1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9), (4, 0, 249_999)]
    assert sentences.split_sentences(docs.where("false")).collect() == []


def test_leaks_at_the_edit_budget():
    """Passages with as many edits as allowed are found in any document; the same answer for any block of items."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    lead = [rng.choice(words) for _ in range(16)]
    items = [(i, (lead if i % 3 == 0 else []) + [rng.choice(words) for _ in range(rng.randint(35, 90))]) for i in range(40)]
    docs, truth = [], set()
    for n in range(300):
        i, w = rng.choice(items)
        w = w[16:] if i % 3 == 0 else w
        m = rng.choice([30, 34, 35, rng.randint(30, len(w)), len(w)])
        at = rng.randint(0, len(w) - m)
        spots = set(rng.sample(range(1, m - 1), m // 7))
        kept = [y for k, x in enumerate(w[at : at + m]) for y in ([x] if k not in spots else rng.choice([[], ["zz" + x], ["zzz", x]]))]
        around = [rng.choice(words) for _ in range(rng.choice([0, 40, 2000]))]
        cut = rng.randint(0, len(around))
        docs.append((n, around[:cut] + kept + around[cut:]))
        truth.add((n, i))
    docs += [(1000 + k, lead + [rng.choice(words) for _ in range(60)]) for k in range(20)]  # shared wording alone
    whole = set(leakage.local_leaks(docs, [x for block in leakage.indexes(items) for x in block]))
    assert whole == truth
    assert whole == {x for block in leakage.indexes(items, block=7) for x in leakage.local_leaks(docs, block)}


def test_spacing_of_an_edited_passage_is_no_edit():
    """Passages with as many edits as allowed are found however the document joins and splits the words between the edits."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(1, 9))) for _ in range(900)]
    items = [(i, [rng.choice(words) for _ in range(rng.randint(35, 90))]) for i in range(40)]

    def spaced(run, often):
        out = []
        for w in run:
            if out and rng.random() < often:
                out[-1] += w
            elif len(w) > 1 and rng.random() < often:
                cut = rng.randint(1, len(w) - 1)
                out += [w[:cut], w[cut:]]
            else:
                out.append(w)
        return out

    docs, truth = [], set()
    for n in range(300):
        i, w = rng.choice(items)
        m = rng.choice([30, 35, rng.randint(30, len(w))])
        at = rng.randint(0, len(w) - m)
        spots = [-1, *sorted(rng.sample(range(1, m - 1), m // 7)), m]
        kept = []
        for a, b in zip(spots, spots[1:]):
            kept += spaced(w[at + a + 1 : at + b], rng.choice([0.03, 0.15])) + ([] if b == m else rng.choice([[], ["zz" + w[at + b]], ["zzz", w[at + b]]]))
        around = [rng.choice(words) for _ in range(rng.choice([0, 40, 800]))]
        cut = rng.randint(0, len(around))
        docs.append((n, around[:cut] + kept + around[cut:]))
        truth.add((n, i))
    docs.append((1000, spaced([w for k, w in enumerate(items[0][1]) if k % 5], 0.1)))  # one edit in five
    assert set(leakage.local_leaks(docs, [x for block in leakage.indexes(items) for x in block])) == truth


def test_chinese_passages_count_in_characters():
    item = "虽然收到4510条投诉蔚棠峨岭的志愿者核对了柏琦霓关于通信铁塔的说法翊枫港没有人能证实"
    run = "收到4510条投诉蔚棠峨岭的志愿者核对了柏琦霓关"
    assert len(run) == 24
    made = [x for block in leakage.indexes([(1, leakage.tokens(item))]) for x in block]
    docs = [(1, leakage.tokens("今天" + run + "后来改正")), (2, leakage.tokens("今天" + run[:-1] + "后来改正"))]
    assert leakage.local_leaks(docs, made) == [(1, 1)]


def test_the_lemma_bound_is_a_bound():
    """No edited stretch keeps fewer q-grams than the bound says."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    item = leakage.Item(1, words, np.zeros(60, bool), np.zeros(47, bool))
    starts = np.cumsum([0] + [len(w) for w in words])
    counts, loose, _ = leakage.lemma(item, leakage.WORDS, 8)
    for _ in range(400):
        n = rng.randint(30, 59)
        x = rng.randint(0, 60 - n)
        hit = set(rng.sample(range(x, x + n), n // 7))
        kept = 0
        for k in range(x, x + n):
            end = int(np.searchsorted(starts, starts[k] + 8))
            kept += bool(counts[k]) and end <= x + n and not hit & set(range(k, end))
        assert kept >= loose


def test_the_document_overrules_the_corpus():
    corpus = {"art": "m", "bzw": "m", "usw": "a", "der": "c"}
    units = lambda t: [t[a:b] for a, b in sentences.segment(t, corpus)]
    assert units("He sells art. Nobody buys art here.") == ["He sells art.", "Nobody buys art here."]
    assert units("See art. 5 and art. Nine of it.") == ["See art. 5 and art. Nine of it."]
    # A proper name after an abbreviation never seen at an end goes on; a common word does not.
    assert units("Rom bzw. Hamburg sind da. In Hamburg regnet es.") == ["Rom bzw. Hamburg sind da.", "In Hamburg regnet es."]
    assert units("Rom bzw. Der Zug kam. Es war der Zug.") == ["Rom bzw.", "Der Zug kam.", "Es war der Zug."]
    assert units("Brot usw. Hamburg ist da.") == ["Brot usw.", "Hamburg ist da."]


def test_closest_sums_in_bounded_memory():
    sizes = {10**6 + 7 * k: 50 for k in range(300)} | {10 * k: 30 for k in range(1, 400)} | {1: 9}
    target = 9_876_543_210
    took = subsets.closest(sizes, target)
    assert all(0 < n <= sizes[s] for s, n in took.items()) and abs(sum(s * n for s, n in took.items()) - target) <= 1
    assert subsets.closest({}, 5) == {} and subsets.closest({7: 2}, 0) == {} and subsets.closest({4: 1, 9: 1}, 6) == {4: 1}


def test_segments_of_a_mixed_text(spark):
    english = "The council counted every letter in the office on Monday. Nobody had asked for the numbers before. "
    german = "Der Rat hat am Montag alle Briefe im Amt gezählt. Niemand hatte vorher nach den Zahlen gefragt. "
    known = [("en", english)] * 3 + [("de", german)] * 3
    text = english + german
    rows = [("mixed", text), ("one", english), ("short", "two words"), ("none", None), ("empty", ""), ("mixed", text)]
    got = language.detect_segments(spark.createDataFrame(rows, "row_id string, text string"), known).orderBy("row_id", "start_pos").collect()
    spans = [(r["row_id"], r["lang"], text[r["start_pos"] : r["end_pos"]]) for r in got]
    want = [("mixed", "en", english.strip()), ("mixed", "de", german.strip())]
    assert [(i, lang, t.strip()) for i, lang, t in spans if i == "mixed"] == [x for x in want for _ in (0, 1)]
    assert [x[:2] for x in spans if x[0] != "mixed"] == [("one", "en")] and all(0 < r["confidence"] <= 1 for r in got)
