"""Languages of documents and of the passages of mixed ones.

Each text is cut into sentence-like units. A unit has a log-likelihood under every language's
character n-grams. Expectation-maximisation over the units estimates a text's language
proportions; a language stays in the set only if the likelihood it adds exceeds a penalty and
it covers at least about a sentence.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.sampling import bounded_sample
from threadloom.tables import table

LANGS = ("en", "de", "fr", "es", "pt", "ru", "zh", "ja", "ar", "hi", "th")
# ISO 639-2/3 forms of the languages.
ISO3 = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "rus": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja", "ara": "ar", "arb": "ar", "hin": "hi", "tha": "th"}
#: At most so many labelled documents are read to count n-grams.
SAMPLE = 8000
#: A further language must add so much log-likelihood (plus a half for each halving of the unit count), and so many words or unspaced characters.
PENALTY, LEAST_WORDS, LEAST_SIGNS = 9.0, 5, 9
ROUNDS = 8

_SKIP = re.compile(r"https?://[!-~]+|www\.[!-~]+|[#@][\w.@-]+|&#?\w{1,8};?")
_CUT = re.compile(r"(?<=[.!?…؟])[\"”»’)\]]*\s+|(?<=[。！？।])|[\n«»“”„()\[\]（）「」\"]|\s/\s")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿々]")
_LINK = re.compile(r"<a\b[^>]*>.*?</a>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_MARKED = re.compile(r"[ऀ-෿؀-ۿ]")


def visible_text(content: str) -> str:
    """HTML without tags, links, hashtags and mentions."""
    return html.unescape(_TAG.sub(" ", _LINK.sub(" ", content)))


def _words(unit: str) -> list[str]:
    return [w for x in unit.split() for w in _MARKED.findall(x) and [x.strip("।,.:;!?،؛؟'\"-–")] or _WORD.findall(x)]


def _grams(word: str) -> list[str]:
    if _UNSPACED.search(word):
        return [word[i : i + 2] for i in range(len(word))]
    padded = f" {word} "
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


class NgramModel:
    """Log-likelihoods of words under each language."""

    def __init__(self, texts: list[tuple[str, str]]):
        counts = [Counter() for _ in LANGS]
        for lang, text in texts:
            into = counts[LANGS.index(lang)]
            for unit in _CUT.split(_SKIP.sub(" ", text)):
                for word in _words(unit or ""):
                    into.update(_grams(word.lower()))
        for k, lang in enumerate(LANGS):  # a language without samples is known by its script alone
            if not counts[k]:
                counts[k].update({g: 1 for g in _SCRIPTS.get(lang, "")})
        self.index = {g: i for i, g in enumerate(dict.fromkeys(g for c in counts for g in c))}
        table = np.full((len(self.index) + 1, len(LANGS)), 0.0)
        for k, c in enumerate(counts):
            n = sum(c.values())
            table[:, k] = np.log(0.2 / (n + 0.2 * len(table)))
            for g, m in c.items():
                table[self.index[g], k] = np.log((m + 0.2) / (n + 0.2 * len(table)))
        table[-1] = table[-1].mean()  # an unseen n-gram says nothing
        for k, lang in enumerate(LANGS):
            if lang not in {x for x, _ in texts}:
                table[-1, k] -= 1
        self.table = table.astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(LANGS)), np.float32)

    def __getstate__(self):
        return {"index": self.index, "table": self.table}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._forget()

    def ids(self, words: list[str]) -> list[int]:
        """Row numbers of the words' likelihoods; frequent words are scored once."""
        memo, out = self.memo, []
        for w in words:
            k = memo.get(w)
            if k is None:
                if len(memo) >= 400_000:
                    k = None
                    memo.clear()
                k = memo[w] = len(memo)
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                get, last = self.index.get, len(self.table) - 1
                self.rows[k] = self.table[[get(g, last) for g in _grams(w.lower())]].sum(0)
            out.append(k)
        return out


_SCRIPTS = {
    "ru": "абвгдежзиклмнопрстуфхцчшщыэюя", "zh": "的一是不了人我在有他这中大来上国", "ja": "のにはをたがでてとしれさいるなも",
    "ar": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "hi": "कखगघचछजझटठडढतथदधनपफबभमयरलवशषसह", "th": "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวศสหอ",
}


def _units(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentence-like units of a text; links, tags and handles divide units too."""
    at = 0
    for m in _CUT.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def infer(texts: list[str], model: NgramModel) -> Iterator[tuple[int, str, float, float, int]]:
    """(text number, language, share of the words, confidence, units) for every language of every text with enough words."""
    for found, _ in _solve(texts, model):
        yield from found


def segments(texts: list[str], model: NgramModel) -> Iterator[tuple[int, int, int, str, float]]:
    """(text number, start, end, language, confidence): neighbouring units of one language of the text, with code-point offsets.

    A unit gets the kept language that is likeliest for it; the confidence is the mean of its units' by words.
    """
    for found, (first, doc, spans, weight, likely) in _solve(texts, model):
        kept: dict[int, list[int]] = {}
        for i, lang, *_ in found:
            kept.setdefault(i, []).append(LANGS.index(lang))
        for a, b in zip(first, np.r_[first[1:], len(doc)]):
            langs = kept.get(int(doc[a]))
            if not langs:
                continue
            part = likely[a:b][:, langs]
            best = part.argmax(1)
            sure = part[np.arange(b - a), best] / np.maximum(part.sum(1), 1e-30)
            runs = np.flatnonzero(np.r_[True, best[1:] != best[:-1]])
            for x, y in zip(runs, np.r_[runs[1:], b - a]):
                yield int(doc[a]), spans[a + x][0], spans[a + y - 1][1], LANGS[langs[best[x]]], float(np.average(sure[x:y], weights=weight[a + x : a + y]))


def _solve(texts: list[str], model: NgramModel) -> Iterator[tuple[list, tuple]]:
    """The languages of a batch of texts, and its units with their spans and likelihoods."""
    doc, sizes, signs, idlists, spans = [], [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        start, n_words, n_signs = len(doc), 0, 0
        clean = _SKIP.sub(lambda m: " " * len(m.group()), text)  # offsets stay
        for x, y in _units(clean):
            unit = clean[x:y]
            words = _words(unit)
            if words:
                s = 0 if unit.isascii() else len(_UNSPACED.findall(unit))
                spans.append((x, y))
                ids = model.ids(words)
                idlists.append(model.rows[ids].sum(0))
                doc.append(i)
                sizes.append(len(words))
                signs.append(s)
                n_signs += s
                n_words += len(words) if s * 2 < len(unit) else 0
        if n_words < 6 and n_signs < 10:
            del doc[start:], sizes[start:], signs[start:], idlists[start:], spans[start:]
    if not doc:
        return
    L, doc_, size, sign = np.array(idlists), np.array(doc), np.array(sizes, float), np.array(signs)
    first = np.flatnonzero(np.r_[True, doc_[1:] != doc_[:-1]])
    at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(doc_)]))
    weight = np.maximum(size, sign / 2)
    L = L - L.max(1, keepdims=True)
    P = np.full((len(first), len(LANGS)), 1 / len(LANGS))
    total = np.add.reduceat(weight, first)
    for _ in range(ROUNDS):
        R = np.exp(L + np.log(P)[at])
        R /= R.sum(1, keepdims=True)
        P = np.add.reduceat(R * weight[:, None], first) / total[:, None] + 1e-12
    joint = np.exp(np.maximum(L, -80)) * P[at]
    both = joint.sum(1)
    words = np.add.reduceat(R * size[:, None], first)
    chars = np.add.reduceat(R * sign[:, None], first)
    units = np.diff(np.r_[first, len(doc_)])
    best, found = P.argmax(1), []
    for k, lang in enumerate(LANGS):
        without = (both - joint[:, k]) / np.maximum(1 - P[at, k], 1e-9)
        gain = np.add.reduceat(np.log(both + 1e-35) - np.log(without + 1e-35), first)
        enough = (chars[:, k] >= LEAST_SIGNS) if lang in ("zh", "ja", "th") else (words[:, k] >= LEAST_WORDS)
        keep = (best == k) | (enough & (gain > PENALTY + 0.5 * np.log2(units)))
        for j in np.flatnonzero(keep):
            found.append((int(doc_[first[j]]), lang, float(P[j, k]), float(1 - np.exp(-max(0.0, min(gain[j], 50.0)))), int(units[j])))
    yield found, (first, doc_, spans, weight, R)


def named_language(label: Column) -> Column:
    """The two-letter code that a label names; null where it names none of LANGS."""
    head = F.split(F.lower(F.trim(label)), "[-_]", 2)[0]
    known = {x: x for x in LANGS} | ISO3
    return F.element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), head)


def labelled_sample(labelled: DataFrame, lang: str = "lang", text: str = "text", limit: int = SAMPLE) -> list[tuple[str, str]]:
    """At most ``limit`` (language, text) pairs, chosen by hash."""
    rows = labelled.select(named_language(F.col(lang)).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    return [(r["l"], r["t"]) for r in bounded_sample(rows, "t", limit, 3, rows.count()).collect()]


def trained(spark: SparkSession, sample: list[tuple[str, str]]):
    """The broadcast model of a sample of labelled texts; its size is bounded by that of SAMPLE texts."""
    return spark.sparkContext.broadcast(NgramModel(sample))


def _texts(pdf: pd.DataFrame, html_text: bool) -> list[str]:
    return [(visible_text(t) if html_text else t) if isinstance(t, str) else "" for t in pdf["text"]]


def detect(df: DataFrame, model, html_text: bool = False) -> DataFrame:
    """row_id, label, lang, share, confidence from row_id, label, text; model: a sample of labelled texts or what ``trained`` gives.

    One row per language of the text or of a passage of about a sentence or more. Null, empty and
    very short texts (under six words, or ten characters of unspaced scripts) give no row;
    repeated rows are all answered; whole texts are read.
    """
    if isinstance(model, list):
        model = trained(df.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(infer(_texts(pdf, html_text), model.value))
            at = [r[0] for r in rows]
            if rows:
                yield pd.DataFrame({"row_id": pdf["row_id"].to_numpy()[at], "label": pdf["label"].to_numpy()[at], "lang": [r[1] for r in rows], "share": [r[2] for r in rows], "confidence": [r[3] for r in rows]})

    return df.select("row_id", "label", "text").mapInPandas(run, "row_id string, label string, lang string, share double, confidence double")


def detect_segments(df: DataFrame, model, html_text: bool = False) -> DataFrame:
    """row_id, start_pos, end_pos, lang, confidence: the passages of one language of each text, from row_id and text.

    Offsets count code points of the text (of the visible text where html_text is set), the end is
    exclusive. Texts that ``detect`` gives no language have no passage; a repeated row repeats its passages.
    """
    if isinstance(model, list):
        model = trained(df.sparkSession, model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(segments(_texts(pdf, html_text), model.value))
            if rows:
                ids = pdf["row_id"].to_numpy()[[r[0] for r in rows]]
                yield pd.DataFrame({"row_id": ids, "start_pos": [r[1] for r in rows], "end_pos": [r[2] for r in rows], "lang": [r[3] for r in rows], "confidence": [r[4] for r in rows]})

    return df.select("row_id", "text").mapInPandas(run, "row_id string, start_pos int, end_pos int, lang string, confidence double")


def _tables(spark: SparkSession, sf_dir: str):
    """The model, and (name, row_id, label, text; whether the text is HTML) of the two tables."""
    known = table(spark, sf_dir, "documents").select("lang", "text").unionByName(table(spark, sf_dir, "eval_items").select("lang", "text"))
    model = trained(spark, labelled_sample(known))
    records = table(spark, sf_dir, "records").select(F.col("id").alias("row_id"), named_language(F.col("lang")).alias("label"), "text")
    statuses = table(spark, sf_dir, "mastodon_statuses").select(F.col("id").alias("row_id"), named_language(F.col("language")).alias("label"), F.col("content").alias("text"))
    return model, (("records", records, False), ("mastodon_statuses", statuses, True))


def all_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, label (as named), lang, share, confidence over records and mastodon_statuses."""
    model, tables = _tables(spark, sf_dir)
    parts = [detect(rows, model, is_html).withColumn("table_name", F.lit(name)) for name, rows, is_html in tables]
    return parts[0].unionByName(parts[1]).where("row_id is not null")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_languages(spark, sf_dir)
    return found.where(F.coalesce(F.col("label") != F.col("lang"), F.lit(True))).select("table_name", "row_id", "lang").distinct()


def p1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_languages(spark, sf_dir).groupBy("table_name", "row_id", "lang").agg(F.max("share").alias("share"), F.max("confidence").alias("confidence"))


def p1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, start_pos, end_pos, lang, confidence: every passage of one language of the texts."""
    model, tables = _tables(spark, sf_dir)
    parts = [detect_segments(rows, model, is_html).withColumn("table_name", F.lit(name)) for name, rows, is_html in tables]
    return parts[0].unionByName(parts[1]).where("row_id is not null").select("table_name", "row_id", "start_pos", "end_pos", "lang", "confidence")
