"""Sentence units of documents in many languages, scripts and layouts.

Full stops are decided by what their words do elsewhere, unambiguously: in the same document first,
then in the whole corpus. A word is an abbreviation if it carries its stop before small letters or
digits, and an ordinary word if it stands without a stop. After an abbreviation a capital ends the
sentence, but not if it begins a proper name and the abbreviation was never seen at a sentence's end;
a name is a word that the document has with a capital inside a sentence and never in small letters.
Other marks follow the rules of their scripts. Quotations and brackets hold their stops together;
blank lines always divide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import Scratch
from threadloom.tables import table

#: Least share of all stops, or of all documents, for a word to be kept as the corpus's evidence: at
#: most 1 / share words are broadcast, whatever the size of the corpus.
STOP_SHARE, DOCUMENT_SHARE = 1e-6, 1e-3
#: Longer runs of letters and stops are no words.
LONGEST_WORD = 200

_BLANK = re.compile(r"[^\S\n]*\r?\n(?:[^\S\n]*\r?\n)+[^\S\n]*|\s*[ \f]\s*")
_EVENT = re.compile("[.!?…。！？｡।॥؟۔]+|[“”„«»\"「」『』(（[)）\\]]|[^\\S\\n]*\\n?[^\\S\\n]+(?=[฀-๿])")
_PAIR = {"«": "»", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]"}
_SHUT = "”»」』)）]\"“"
_TAIL = re.compile(r"\s*(?:[←-⇿⌀-➿⬀-⯿️‍⃣\U0001f000-\U0001faff]+|(?:via\s+)?[#@][\w.@-]*\w|https?://[!-~]+)")
_EMOJI = re.compile(r"\s*[←-⇿⌀-➿⬀-⯿️‍⃣\U0001f000-\U0001faff]+")
_DOTTED = re.compile(r"\.(?=\s+[a-zß-öø-ÿа-яё]|[,;:])")
# A word with what its stop stands before (a letter or digit, or a mark), or without a stop.
_COUNTED = re.compile(r"(?<![\w.’'])((?:[^\W\d_]\.)*[^\W\d_]++)(?:\.(?:(?=\s+(\w))|(?=([,;:])))|(?![\w.’']))")
_STOPPED = re.compile(r"\.\s+([^\W\d_]+)")
_ELIDED = re.compile(r"(?<=[^\W\d_])[’'](?=[^\W\d_])")
_NAME = re.compile(r"[^\W\d_]+")
_INSIDE = re.compile(r"(?<=[^\W_])[,;]?\s+([^\W\d_]+)")
_OPENERS = "“„«\"(（[¿¡'‘「『—–- "
# German month names, before which a day number's stop ends nothing.
_MONTH = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember)\b")
_LINK = re.compile(r"https?://[!-~]*|www\.[!-~]*")
_THAI = re.compile(r"[฀-๿]")


def _quotes(text: str, a: int, b: int, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(opening, closing) positions of the outermost matched quotations and brackets of a block."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for m in re.finditer("[“”„«»\"「」『』(（[)）\\]]", text[a:b]):
        at, c = a + m.start(), m.group()
        if c == '"' or c == "“":
            c = "”" if stack and stack[-1][0] in ("”" if c == '"' else "“", "“”"[c == '"']) and (c == '"' or stack[-1][0] == "“") else "open"
        if c == "open" or c in _PAIR or c == "„":
            want = "“" if text[at] == "„" else "”" if text[at] in "\"“" else _PAIR[text[at]]
            stack.append((want, at))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == c or {stack[k][0], c} == {"“", "”"}:
                    out.append((stack[k][1], at))
                    del stack[k:]
                    break
    out.sort()
    outer: list[tuple[int, int]] = []
    for x in out:
        if not outer or x[0] > outer[-1][1]:
            outer.append(x)
    return outer


def _next_kind(text: str, at: int, end: int) -> str:
    """What follows: '' nothing, 'l' a small letter, 'u' a capital, 'd' a digit, 'o' a letter without case, 'x' else."""
    while at < end and (text[at].isspace() or text[at] in _OPENERS):
        at += 1
    if at >= end:
        return ""
    c = text[at]
    return "l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" if c.isalpha() else "x"


class Evidence:
    """What the words of one document, and then of the corpus, are: abbreviations, ordinary words, names."""

    def __init__(self, text: str, corpus: dict[str, str]):
        self.text, self.corpus = text, corpus
        self._words: dict[str, int] | None = None
        self._dotted: set[str] | None = None
        self._names: set[str] | None = None

    def plain(self, word: str) -> bool:
        """Does the document hold the word without a stop?"""
        if self._words is None:
            self._words = {m[0]: 1 for m in _COUNTED.findall(_ELIDED.sub(" ", self.text)) if not m[1] and not m[2]}
        return word in self._words

    def dotted(self, low: str) -> bool:
        """Does the document hold the word with a stop inside a sentence?"""
        if self._dotted is None:
            self._dotted = {_word_before(self.text, m.start()).lower() for m in _DOTTED.finditer(self.text)}
        return low in self._dotted

    def kind(self, w: str) -> str:
        """The kind of the abbreviation that w is before a stop, or ''."""
        if not w or w.isdigit():
            return ""
        if len(w) == 1 and w.isalpha():
            return "i"
        low = w.lower()
        known = self.corpus.get(low, "")
        if known in ("t", "n"):
            return "" if known == "t" and w.islower() else known
        if self.dotted(low):
            return known if known in ("a", "m") else "" if known or self.plain(w) else "a"
        return known if known in ("a", "m") and not self.plain(w) else ""

    def name(self, word: str) -> bool:
        """Is the capitalised word a proper name: by the document, or no common word of the corpus?"""
        low = word.lower()
        if self.plain(low):
            return False
        if self._names is None:
            self._names = set(_INSIDE.findall(self.text))
        return word in self._names or self.corpus.get(low) != "c"


def segment(text: str, corpus: dict[str, str]) -> list[tuple[int, int]]:
    """(start, end) code-point offsets of the units of a text.

    corpus: words in lower case with "t" for titles (a name follows), "n" for abbreviations only before
    numbers, "a" for others that also end sentences, "m" for those that were never seen to, and "c"
    for common words.
    """
    units: list[tuple[int, int]] = []
    evidence = Evidence(text, corpus)
    at, blocks = 0, []
    for m in _BLANK.finditer(text):
        blocks.append((at, m.start()))
        at = m.end()
    blocks.append((at, len(text)))
    for a, b in blocks:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a >= b:
            continue
        links = [m.span() for m in _LINK.finditer(text, a, b)]
        quotes = _quotes(text, a, b, links)
        start, q, pos, li = a, 0, a, 0
        while pos < b:
            m = _EVENT.search(text, pos, b)
            if not m:
                break
            p, e, c = m.start(), m.end(), m.group()
            while li < len(links) and links[li][1] <= p:
                li += 1
            if li < len(links) and links[li][0] <= p < links[li][1] - (links[li][1] >= b or True) and c[0] not in _SHUT:
                if not (p + len(c) >= links[li][1] and c[0] in ".!?…"):
                    pos = links[li][1] if c[0] in ".!?" else e
                    continue
            while q < len(quotes) and quotes[q][1] < p:
                q += 1
            if q < len(quotes) and quotes[q][0] <= p <= quotes[q][1]:
                op, cl = quotes[q]
                if p < cl:  # inside: on to its end
                    pos = cl
                    if p == op and cl == op:
                        pos = e
                    continue
                # at the closing mark: does the quotation end its sentence?
                k = cl - 1
                while k > op and (text[k].isspace() or text[k] in _SHUT):
                    k -= 1
                ended = text[k] in ".!?…。！？｡।॥؟۔"
                if text[k] == "." and ended and evidence.kind(_word_before(text, k)):
                    ended = text[op] not in "(（["
                first = text[start:op].strip(" \t\n—–-") == ""
                stop = cl + 1
                q += 1
                if stop < b and text[stop] in ".!?…。！？｡।॥؟۔,;:，、؛،；：":
                    pos = stop  # the sentence's own mark decides
                    continue
                bracket = text[op] in "(（["
                if not ended or (first and not bracket) or (bracket and not first):
                    pos = stop
                    continue
                if text[op] in "「『" or (not bracket and _next_kind(text, stop, b) == "l"):
                    pos = stop
                    continue
            elif c[0].isspace():
                left = text[p - 1] if p > a else ""
                if "\n" in c and not c.replace("\n", ""):
                    pos = e
                    continue
                if not _THAI.match(left) or text[e : e + 1].isdigit():
                    pos = e
                    continue
                if _TAIL.match(text, p, b):
                    pos = e
                    continue
                stop = p
            elif c[0] in "“”„«»\"「」『』(（[)）]":
                pos = e
                continue
            else:
                stop = e
                if "." in c or "…" in c:
                    if not _ends(text, p, e, b, c, evidence):
                        pos = e
                        continue
                elif c[-1] in "!?" and _next_kind(text, e, b) == "l":
                    pos = e
                    continue
                while stop < b and text[stop] in "”»」』)）]’" and not any(x[0] == stop for x in quotes[q : q + 1]):
                    stop += 1
            # tails of tags, links and emoji belong to the sentence before
            while (t := _EMOJI.match(text, stop, b)) and t.end() > stop:
                stop = t.end()
            far = stop
            tags_only = True
            while t := _TAIL.match(text, far, b):
                far = t.end()
                tags_only &= "#" in t.group() or bool(_EMOJI.fullmatch(t.group()))
            if far > stop and (far >= b or tags_only):
                stop = far
            if stop > start and text[start:stop].strip():
                _add(units, text, start, stop)
            while stop < b and text[stop].isspace():
                stop += 1
            start = pos = stop
        if start < b:
            if units and a < start and not _TAIL.sub("", text[start:b]).strip():
                units[-1] = (units[-1][0], b)
            else:
                _add(units, text, start, b)
    return units


def _add(units: list[tuple[int, int]], text: str, a: int, b: int) -> None:
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    if b > a:
        units.append((a, b))


def _word_before(text: str, p: int) -> str:
    """The run of letters, digits and stops that ends at p, from its first letter or digit on."""
    k, least = p, max(0, p - LONGEST_WORD)
    while k > least and ((c := text[k - 1]).isalnum() or c in "._"):
        k -= 1
    while k < p and not text[k].isalnum():
        k += 1
    return text[k:p]


def _ends(text: str, p: int, e: int, b: int, c: str, evidence: Evidence) -> bool:
    """Does the cluster c of full stops at p..e end a sentence?"""
    after = text[e] if e < b else ""
    kind = _next_kind(text, e, b)
    if after and after in _SHUT and after not in "\"“":
        kind = _next_kind(text, e + 1, b)
    if not kind:
        return True
    if len(c) > 1 or c == "…":
        return kind != "l"
    if after and not after.isspace() and after not in _SHUT + "#@":
        # no space: only a small letter, digit or closing mark before and a capital after
        before = text[p - 1] if p else ""
        if not ((before.islower() or before.isdigit() or before in _SHUT) and (after.isupper() or after in "“„«¿¡(\"" or ord(after) > 0x2190)):
            return False
        if before.isdigit() and after.isdigit():
            return False
        w = _word_before(text, p)
        if "." in w and len(w.split(".")[-1]) <= 1:
            return False
    if kind == "l":
        return False
    if p and "ऀ" <= text[p - 1] <= "ॿ":
        return False
    w = _word_before(text, p)
    if w.isdigit() and len(w) <= 2:
        rest = text[e:b].lstrip()
        return not _MONTH.match(rest)
    abbreviation = evidence.kind(w)
    if not abbreviation or abbreviation == "n" and kind != "d":
        return True
    if kind == "d" or abbreviation in ("i", "t"):
        return False
    if kind == "u" and abbreviation == "m":
        following = _NAME.search(text, e, b)
        return not (following and evidence.name(following.group()))
    return kind in ("u", "x", "o")


def word_counts(documents: DataFrame) -> DataFrame:
    """word, kind, n: in all documents, how often each word carries a stop before small letters or marks (low),
    digits or capitals (up), stands without one (bare), carries one before a capital that the document also
    has in small letters (ends), and the documents that hold it in small letters (df); the word '' counts documents.
    Counted in each batch before anything is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: Counter = Counter()
            docs: Counter = Counter()
            ends: Counter = Counter()
            for text in pdf["text"]:
                if not isinstance(text, str):
                    continue
                text = _ELIDED.sub(" ", text)
                found = _COUNTED.findall(text)
                seen.update(found)
                words = {m[0] for m in found if not m[1] and not m[2]}
                docs.update(w for w in words if w.islower())
                docs[""] += 1
                ends.update(_word_before(text, m.start()) for m in _STOPPED.finditer(text) if m[1][0].isupper() and m[1].lower() in words)
            kinds: Counter = Counter()
            for (word, letter, mark), n in seen.items():
                kind = "low" if mark or letter.islower() else "digit" if letter.isdigit() else "up" if letter.isupper() else "" if letter else "bare"
                if kind:
                    kinds[word, kind] += n
            rows = [(w, k, n) for (w, k), n in kinds.items()] + [(w, "df", n) for w, n in docs.items()] + [(w, "ends", n) for w, n in ends.items()]
            if rows:
                yield pd.DataFrame(rows, columns=["word", "kind", "n"])

    counts = documents.select("text").mapInPandas(run, "word string, kind string, n bigint")
    each = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("low", "digit", "up", "bare", "ends", "df")]
    return counts.groupBy("word").agg(*each)


def corpus_words(documents: DataFrame) -> dict[str, str]:
    """The corpus's abbreviations with their kinds and its common words, in lower case, from counts over all documents.

    Words of less than STOP_SHARE of all stops, or in less than DOCUMENT_SHARE of all documents, are
    left out, so that what the driver holds and broadcasts has a bound.
    """
    scratch = Scratch(documents.sparkSession, "sentences")
    counts = scratch.save(word_counts(documents), "words")
    dotted = F.col("low") + F.col("digit") + F.col("up")
    stops, rows = counts.agg(F.sum(dotted), F.sum(F.when(F.col("word") == "", F.col("df")))).first()
    rare_bare = F.col("bare") <= 0.1 * dotted
    plain = (F.col("low") >= 2) & (F.col("low") >= 0.15 * dotted) & rare_bare
    title = (F.col("up") >= 4) & (F.col("low") + F.col("digit") <= 0.02 * F.col("up")) & (F.col("bare") <= 0.5 * dotted) & F.col("word").rlike(r"^\p{Lu}\p{Ll}{0,3}$|^\p{Lu}{2}$")
    # A word that also stands without a stop must stand before numbers so often that it can't be by chance.
    number = (F.col("digit") >= F.when(rare_bare, 2).otherwise(8)) & (F.col("up") <= 0.1 * F.col("digit"))
    kind = F.when(number & ~plain, "n").when(plain, F.when(F.col("ends") > 0, "a").otherwise("m")).when(title, "t")
    enough = dotted >= STOP_SHARE * (stops or 0)
    common = F.when(F.col("df") >= F.greatest(F.lit(2.0), F.lit(DOCUMENT_SHARE * (rows or 0))), "c")
    found = counts.where("word <> ''").select("word", F.coalesce(F.when(enough, kind), common).alias("kind"), dotted.alias("n")).where("kind is not null")
    out: dict[str, str] = {}
    for r in found.orderBy(F.col("kind") != "c", "n").collect():
        out[r["word"].lower()] = r["kind"]
    scratch.drop("words")
    return out


def split_sentences(documents: DataFrame) -> DataFrame:
    """doc_id, start_pos, end_pos: the sentence units of every document.

    Offsets count code points, the end is exclusive, units have no white space at either end. Null
    and blank texts give no unit; repeated rows give their units again; whole texts are read.
    """
    known = documents.sparkSession.sparkContext.broadcast(corpus_words(documents))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        corpus = known.value
        for pdf in batches:
            rows = [(d, a, b) for d, t in zip(pdf["doc_id"], pdf["text"]) if isinstance(t, str) for a, b in segment(t, corpus)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start_pos", "end_pos"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, start_pos int, end_pos int")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents"))
