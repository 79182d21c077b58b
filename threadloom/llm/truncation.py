"""Texts that were cut short by a length limit or a broken transfer.

Intact sentences inside a bounded sample of texts are the negatives, with and without their stop,
dots, tags, links or emoji; the same sentences cut artificially are the positives, part of them at
the length limits that the corpus itself shows. A hashed logistic regression on closing words and
characters, punctuation and length-to-limit scores every record.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadloom.llm.sampling import bounded_sample
from threadloom.session import Scratch
from threadloom.tables import table

#: At most so many texts are read to train; so many weights; training rounds.
SAMPLE, SLOTS, ROUNDS = 20_000, 1 << 18, 8
THRESHOLD = 0.5

_STOP = ".!?。！？।؟"
_CLOSE = "\"'”’»)）」』]“"
_MARKS = re.compile(r"(?:\s*(?:\[(?:…|\.\.\.)\]|\((?:more|…|\.\.\.)\)|\[\+\d+ chars\]|&#?\w{0,6}|\ufffd+|…|\.\.\.+|\.\.))$")
_TAIL = re.compile(r"(?:\s+(?:via\s+)?[#@][\w.@-]+|\s*[←-➿⬀-⯿️‍\U0001f000-\U0001faff]+|\s+https?://[!-~]+)$")
_LINK = re.compile(r"https?://[!-~]*$")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[^\w\s]")
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿]")
_INNER = re.compile(r"(?<=[^.\s\d][.!?।؟…])[\"”»’)]*\s+(?=\S)|(?<=[。！？])(?=\S)")
_THAI = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
_OPEN, _SHUT = "([«“„「（", ")]»”“」）"


def _shape(word: str, known: frozenset[str]) -> str:
    low = word.lower()
    if low in known:
        return low
    if word[0].isdigit():
        return "9"
    return ("Aa" if word[0].isupper() else "aa") + str(min(len(word), 4))


def features(text: str, known: frozenset[str]) -> tuple[list[int], int]:
    """Hashed features of a text's end and its class: 0 stop, 1 tail of tags, links or emoji, 2 mark, 3 plain."""
    t = text.rstrip()
    f = []
    core, n_tail = t, 0
    while m := _TAIL.search(core):
        core, n_tail = core[: m.start()], n_tail + 1
        if n_tail == 1:
            last = m.group().strip()
            f.append("tail " + ("link" if "://" in last else "tag" if last[-1].isalnum() or last[0] in "#@v" else "emoji"))
            if "://" in last:
                host, _, path = last.partition("://")[2].partition("/")
                f.append(f"host {host.rpartition('.')[2] if '.' in host else '-'} {bool(path)}")
                f.append("path " + re.sub(r"[a-z]+", "a", re.sub(r"\d+", "9", path))[-12:])
    if not n_tail and (m := _LINK.search(core)):
        f.append("linkonly")
    mark = _MARKS.search(core)
    if mark:
        f.append("mark " + re.sub(r"\d+", "9", mark.group()))
        core = core[: mark.start()]
    end = core.rstrip(_CLOSE + " ")
    stop = bool(end) and (end[-1] in _STOP or (mark is None and core[-1:] in "。！？।"))
    kind = 0 if stop and not n_tail and not mark else 1 if n_tail and not mark else 2 if mark else 3
    f.append(f"kind {kind} stop {stop} mark {bool(mark)}")
    if core[-1:] in _CLOSE:
        f.append(f"close {core[-2:]} {stop}")
    opened = sum(core.count(c) for c in _OPEN) - sum(core.count(c) for c in _SHUT)
    f.append(f"open {max(-1, min(opened, 2))}")
    f.append(f"end {core[-1:] if core and not core[-1].isalnum() else 'a'}")
    tail = core[-90:]
    words = _WORD.findall(tail)
    if words and not stop:
        shapes = [_shape(w, known) for w in words[-5:]]
        for n in range(1, 6):
            if len(shapes) >= n:
                f.append(f"w{n} " + " ".join(shapes[-n:]))
                f.append(f"w{n}m{bool(mark)} " + " ".join(shapes[-n:]))
        w = words[-1].lower()
        f.append(f"suffix {w[-3:]} {w in known}")
        if _UNSPACED.search(tail[-6:]):
            for n in range(1, 8):
                f.append(f"c{n} " + tail[-n:])
    elif not words:
        f.append("empty")
    n = len(words) if len(core) < 90 else 99
    f.append(f"words {min(n, 4)}")
    if stop and words:
        f.append("stopword " + " ".join(_shape(w, known) for w in words[-2:]))
    f.append("bias")
    return [zlib.crc32(x.encode()) % SLOTS for x in f], kind


def limit_slots(bucket: int, kind: int) -> list[int]:
    return [zlib.crc32(f"limit {bucket}".encode()) % SLOTS, zlib.crc32(f"limit {bucket} {kind}".encode()) % SLOTS]


def known_words(texts: list[str]) -> frozenset[str]:
    """Words in at least a thousandth of the texts (and three), so that names fall to their shape."""
    seen: Counter = Counter()
    for t in texts:
        seen.update({w.lower() for w in _WORD.findall(t)})
    least = max(3, len(texts) // 1000)
    return frozenset(w for w, n in seen.items() if n >= least)


def examples(text: str, limits: list[int], rng: random.Random) -> Iterator[tuple[str, int, bool]]:
    """(text, limit bucket, cut?) made from one text's own sentences."""
    whole = text.rstrip()
    if len(whole) <= 16 and whole:  # short replies are complete
        yield whole, 0, False
        return
    ends = [m.start() for m in _INNER.finditer(text)]
    if not ends:
        ends = [m.start() for m in _THAI.finditer(text)]
    if whole and whole[-1] in _STOP + "”»」":
        ends.append(len(whole))
    if not ends:
        return
    k = rng.randrange(len(ends))
    base, start = text[: ends[k]].rstrip(), (ends[k - 1] if k else 0)
    bare = base.rstrip(_STOP + "…") if rng.random() < 0.9 else base
    roll = rng.random()
    word = "".join(rng.choice("abdegiklmnoprstuvz") for _ in range(rng.randint(4, 9)))
    tails = [f" #{word}", f" #{word} #{word[::-1]}", f" @{word}", f" via @{word}", f" https://{word}.example/{word[::-1]}", f" https://{word}.test/{word}/{word[:3]}.html?id={rng.randint(1, 9999)}", " " + rng.choice("😂🤔🔥🙄👀")]
    if roll < 0.25:
        good = base
    elif roll < 0.6:
        good = bare
    elif roll < 0.72:
        good = bare + rng.choice(["…", "...", " …", "…"])
    else:
        good = (base if rng.random() < 0.6 else bare) + rng.choice(tails)
    yield good, 1 if len(good) in limits else 0, False
    inner = len(bare) - start
    if inner < 12:
        return
    fits = [x for x in limits if start + 4 < x < len(bare) - 1] if rng.random() < 0.7 else []
    roll = rng.random()
    if fits:
        at = rng.choice(fits)
        yield text[:at], 1, True
        return
    at = start + rng.randint(5, inner - 2)
    piece = text[:at]
    if roll < 0.3 and " " in piece[start:].strip():
        piece = piece[: piece.rindex(" ")]
    if roll > 0.9:
        piece = base + rng.choice(tails[4:6])
        piece = piece[: -rng.randint(2, max(3, len(piece) - len(base) - 6))]
    elif roll > 0.84:
        piece = base + " (" + text[start : start + rng.randint(4, max(5, inner - 4))].strip()
    else:
        piece = piece.rstrip() + rng.choice(["", "", "", "", "", "…", "…", "...", "[…]", " (more)", f" [+{rng.randint(20, 4000)} chars]", "&#82", "&#8", "\ufffd", "\ufffd"])
    yield piece, 0, True


def train(rows: list[tuple[str, list[int]]], seed: int = 5) -> tuple[np.ndarray, frozenset[str]]:
    """Weights of the hashed logistic regression and the known words; a zero model for an empty sample."""
    known, rng = known_words([t for t, _ in rows]), random.Random(seed)
    X, y = [], []
    for text, limits in rows:
        for piece, bucket, cut in examples(text, limits, rng):
            slots, kind = features(piece, known)
            X.append(slots + limit_slots(bucket, kind))
            y.append(cut)
    w = np.zeros(SLOTS + 1)
    if not X:
        return w[:-1].astype(np.float32), known
    width = max(map(len, X))
    pad = np.full((len(X), width), SLOTS)
    for i, x in enumerate(X):
        pad[i, : len(x)] = x
    target, grad2, order = np.array(y, float), np.full(SLOTS + 1, 1e-3), np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for batch in np.array_split(order.permutation(len(X)), max(1, len(X) // 256)):
            at = pad[batch]
            p = 1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30)))
            g = np.zeros(SLOTS + 1)
            np.add.at(g, at, ((p - target[batch]) / len(batch))[:, None])
            used = np.unique(at)
            g[used] += 1e-5 * w[used]
            grad2[used] += g[used] ** 2
            w[used] -= 0.1 * g[used] / np.sqrt(grad2[used])
            w[SLOTS] = 0
    return w[:-1].astype(np.float32), known


def length_limits(lengths: DataFrame) -> DataFrame:
    """source, source_detail, length: lengths at which far more texts end than around them.

    lengths: one row per source, source_detail and length with the count n. Each length is held
    against those within 15 of it; there are at most as many rows per source as distinct lengths.
    """
    around = W.partitionBy("source", "source_detail").orderBy("length").rangeBetween(-15, 15)
    near = lengths.withColumn("around", (F.sum("n").over(around) - F.col("n")) / 30.0)
    return near.where("n >= 4 and n >= 6 * (around + 0.3)").select("source", "source_detail", "length")


def score(df: DataFrame) -> DataFrame:
    """id, source, source_detail, p_cut for every row of a table with id, source, source_detail, text.

    Null and empty texts have no end to lack: p_cut 0. Repeated rows are all scored; null sources
    count as a source of their own; whole texts are read.
    """
    spark = df.sparkSession
    rows = df.select("id", "source", "source_detail", "text")
    limits = Scratch(spark, "truncation").save(length_limits(rows.groupBy("source", "source_detail", F.length("text").alias("length")).agg(F.count(F.lit(1)).alias("n")).where("length is not null")), "limits")
    sample = bounded_sample(rows.where("text is not null"), "id", SAMPLE, 9, rows.count())
    own = limits.groupBy("source", "source_detail").agg(F.collect_list("length").alias("limits"))
    same = lambda a, b: a.source.eqNullSafe(b.source) & a.source_detail.eqNullSafe(b.source_detail)
    drawn = sample.join(own, same(sample, own), "left").select(sample["id"], "text", "limits").collect()
    weights, known = train([(r["text"], r["limits"] or []) for r in sorted(drawn, key=lambda r: (r["id"] or "", r["text"]))])
    model = spark.sparkContext.broadcast((weights, known))  # SLOTS weights and the words of the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, vocabulary = model.value
        for pdf in batches:
            logits, kinds = [], []
            for t in pdf.pop("text"):
                if isinstance(t, str) and t.strip():
                    slots, kind = features(t, vocabulary)
                    logits.append(float(w[slots].sum()))
                    kinds.append(kind)
                else:
                    logits.append(-99.0)
                    kinds.append(0)
            yield pdf.assign(logit=logits, kind=kinds)

    ends = rows.select("*", F.length("text").alias("length")).mapInPandas(run, "id string, source string, source_detail string, length int, logit double, kind int")
    at = limits.select(F.col("source").alias("l_source"), F.col("source_detail").alias("l_detail"), F.col("length").alias("l_length"))
    joined = ends.join(at, ends.source.eqNullSafe(at.l_source) & ends.source_detail.eqNullSafe(at.l_detail) & (ends.length == at.l_length), "left")
    add = lambda b: F.element_at(F.create_map(*[F.lit(x) for k in range(4) for x in (k, float(weights[limit_slots(b, k)].sum()))]), F.col("kind"))
    logit = F.col("logit") + F.when(F.col("l_length").isNull(), add(0)).otherwise(add(1))
    scored = Scratch(spark, "truncation").save(joined.select("id", "source", "source_detail", "kind", logit.alias("logit")), "scored")
    return fit_rates(scored)


def fit_rates(scored: DataFrame, rounds: int = 4) -> DataFrame:
    """id, source, source_detail, p_cut: the scores under each source's own rate of cut texts.

    The training set is balanced, the sources are not: expectation-maximisation over a histogram of
    the scores estimates the rate by source and kind of end, then by source_detail, where few texts
    lean on the source's rate.
    """
    bucket = F.round(F.col("logit") * 4) / 4
    cells = Scratch(scored.sparkSession, "truncation").save(scored.groupBy("source", "source_detail", "kind", bucket.alias("at")).agg(F.count(F.lit(1)).alias("n")), "cells")
    logit_of = lambda c: F.log(c / (1 - c))

    def maximise(cells: DataFrame, keys: list[str], parent: str, weight: float) -> DataFrame:
        """The cells with a column rate, by keys; parent names the column to which few texts lean."""
        by = W.partitionBy(*keys)
        now = cells.withColumn("rate", F.col(parent))
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.col("at") + logit_of(F.col("rate")))))
            now = now.withColumn("rate", F.least(F.lit(0.97), F.greatest(F.lit(0.01), (F.sum(p * F.col("n")).over(by) + weight * F.col(parent)) / (F.sum("n").over(by) + weight))))
        return now

    coarse = cells.groupBy("source", "kind", "at").agg(F.sum("n").alias("n")).withColumn("half", F.lit(0.5))
    coarse = maximise(coarse, ["source", "kind"], "half", 4.0).groupBy("source", "kind").agg(F.max("rate").alias("base"))
    coarse = coarse.select(F.col("source").alias("c_source"), F.col("kind").alias("c_kind"), "base")
    fine = cells.join(coarse, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("kind") == F.col("c_kind")))
    fine = maximise(fine, ["source", "source_detail", "kind"], "base", 20.0).groupBy("source", "source_detail", "kind").agg(F.max("rate").alias("rate"))
    fine = fine.select(F.col("source").alias("f_source"), F.col("source_detail").alias("f_detail"), F.col("kind").alias("f_kind"), "rate")
    both = scored.join(fine, F.col("source").eqNullSafe(F.col("f_source")) & F.col("source_detail").eqNullSafe(F.col("f_detail")) & (F.col("kind") == F.col("f_kind")))
    return both.select("id", "source", "source_detail", (1 / (1 + F.exp(-(F.col("logit") + logit_of(F.col("rate")))))).alias("p_cut"))


def is_cut() -> Column:
    return F.col("p_cut") >= THRESHOLD


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "records")).where(is_cut() & F.col("id").isNotNull()).select("id").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, source_detail, n_records, n_cut, cut_rate over distinct ids."""
    each = score(table(spark, sf_dir, "records")).groupBy("id", "source", "source_detail").agg(F.max("p_cut").alias("p_cut"))
    return each.groupBy("source", "source_detail").agg(F.count(F.lit(1)).alias("n_records"), F.sum(is_cut().cast("bigint")).alias("n_cut"), F.round(F.avg(is_cut().cast("double")), 6).alias("cut_rate"))
