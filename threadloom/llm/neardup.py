"""Records whose texts differ by small edits: a chosen-path set similarity join.

Texts become sets of word shingles with minwise tokens. In each of several independent trees a
root chooses three tokens and branches on each two of them; every further node branches on three
tokens that its own hash chooses, so that all its documents branch on the same ones. Nodes of one
document are dropped, small nodes compare their documents exhaustively, large ones branch on.
Candidates pass a comparison of sketches and then an exact one of the shingle sets, from the words.
Copies of a text are one document in the trees and come back by membership.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import Scratch
from threadloom.tables import table

#: Minwise values of a document; tokens to branch on; bits of each value in the sketch.
VALUES, TOKENS, PLANES = 128, 32, 4
#: Independent trees. Two of a root's three tokens agree with probability 3 s^2 - 2 s^3, a half at
#: s = 0.5, so that a pair escapes all roots with probability 0.5^TREES (0.0078; at s = 0.55 0.0031).
#: In larger nodes it must agree on: three slots a node keep 3 s > 1 ways open at s = 0.5.
TREES = 7
#: Nodes of at most so many documents are compared exhaustively; at DEPTH tokens every node is, in blocks of so many.
SMALL, DEPTH = 64, 7
#: The sketch's bound lies so many standard errors below the threshold.
ERRORS = 4.0

_UNSPACED = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿]|[豈-﫿]")
_MARK = re.compile(r"[̀-ͯ֐-߿ऀ-෿⃐-⃿]")
_PLAIN = re.compile(r"[^\W_]+")
_FULL = regex.compile(r"[\p{L}\p{M}\p{Nd}]+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, marks and digits."""
    low = text.lower()
    return (_FULL if _MARK.search(low) else _PLAIN).findall(low)


class Sketcher:
    """Shingle sets, minwise tokens and sketches of batches of texts."""

    def __init__(self, shingle: int):
        rng = np.random.default_rng(20240229)
        self.shingle = shingle
        self.mult = rng.integers(1, 2**63, VALUES, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 2**63, VALUES, dtype=np.uint64)
        self.join = rng.integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)
        self.memo: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    def shingles(self, words: list[str]) -> np.ndarray:
        """Sorted distinct 64-bit codes of the runs of words."""
        c, k = self.codes(words), self.shingle
        h = c[: len(c) - k + 1] * self.join[0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) + c[j : len(c) - k + 1 + j] * self.join[j]
        return np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15))

    def sketch(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """TOKENS minwise values of 32 bits, and PLANES bits of all VALUES as longs, for each set."""
        flat = np.concatenate(sets)
        starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
        low = np.empty((VALUES, len(sets)), np.uint32)
        spread = (flat ^ (flat >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        spread ^= spread >> np.uint64(32)
        for t in range(VALUES):
            low[t] = np.minimum.reduceat(((spread * self.mult[t] + self.add[t]) >> np.uint64(32)).astype(np.uint32), starts)
        mixed = low * np.uint32(0x85EBCA6B)
        planes = [np.packbits((mixed >> np.uint32(31 - k) & np.uint32(1)).astype(np.uint8), axis=0).T.copy().view(np.uint64) for k in range(PLANES)]
        return low[:TOKENS].T.astype(np.int32), np.concatenate(planes, axis=1)


def sketches(df: DataFrame, shingle: int, least_words: int) -> DataFrame:
    """id, doc (hash of the word sequence), words, tokens, payload (doc and sketch) from id and text; no rows for texts that are no cases."""
    made: list[Sketcher] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(Sketcher(shingle))
        sk = made[0]
        for pdf in batches:
            ids, docs, texts, sets = [], [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                if not isinstance(text, str) or i is None or _UNSPACED.search(text):
                    continue
                words = words_of(text)
                if len(words) < max(least_words, shingle):
                    continue
                ids.append(i)
                texts.append(" ".join(words))
                docs.append(xxhash.xxh3_64_intdigest(texts[-1]))
                sets.append(sk.shingles(words))
            if ids:
                tokens, bits = sk.sketch(sets)
                names = np.array(docs, np.uint64)
                payload = [x.tobytes() for x in np.c_[names, bits]]
                yield pd.DataFrame({"id": ids, "doc": names.view(np.int64), "words": texts, "tokens": list(tokens), "payload": payload})

    return df.select("id", "text").mapInPandas(run, "id string, doc bigint, words string, tokens array<int>, payload binary")


def _compare(nodes: DataFrame, most: int) -> DataFrame:
    """doc_a < doc_b: pairs within xs, or between xs and ys where there are any, whose sketches differ in at most ``most`` values."""
    half = VALUES // 64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, (x, y) in enumerate(zip(pdf["xs"], pdf["ys"])):
                shapes.setdefault((len(x), len(y)), []).append(k)
            found = []
            for (n, m), rows in shapes.items():
                i, j = np.triu_indices(n, 1) if not m else (x.ravel() for x in np.meshgrid(np.arange(n), n + np.arange(m)))
                if not len(i):
                    continue
                step = max(1, (1 << 19) // len(i))
                for s in range(0, len(rows), step):
                    joined = b"".join(b"".join([*pdf["xs"].iat[k], *pdf["ys"].iat[k]]) for k in rows[s : s + step])
                    grid = np.frombuffer(joined, np.uint64).reshape(-1, n + m, 1 + half * PLANES)
                    differ = 0
                    for part in range(half):
                        bits = 0
                        for plane in range(PLANES):
                            column = grid[:, :, 1 + plane * half + part]
                            bits |= column[:, i] ^ column[:, j]
                        differ += np.bitwise_count(bits)
                    node, at = np.nonzero(differ <= most)
                    names = grid[:, :, 0].view(np.int64)
                    found.append(np.c_[names[node, i[at]], names[node, j[at]]])
            if found:
                pairs = np.concatenate(found)
                pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
                yield pd.DataFrame({"doc_a": pairs[:, 0], "doc_b": pairs[:, 1]})

    return nodes.mapInPandas(run, "doc_a bigint, doc_b bigint")


def _verify(pairs: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """The pairs doc_a, doc_b with words_a, words_b whose sets of word runs are similar enough."""

    def runs(words: str) -> set[tuple[str, ...]]:
        w = words.split(" ")
        return set(zip(*[w[k:] for k in range(shingle)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets: dict[int, set] = {}
            keep = []
            for a, b, x, y in zip(pdf["doc_a"], pdf["doc_b"], pdf["words_a"], pdf["words_b"]):
                one = sets[a] if a in sets else sets.setdefault(a, runs(x))
                other = sets[b] if b in sets else sets.setdefault(b, runs(y))
                common = len(one & other)
                keep.append(common >= threshold * (len(one) + len(other) - common))
            yield pdf.loc[keep, ["doc_a", "doc_b"]]

    return pairs.mapInPandas(run, "doc_a bigint, doc_b bigint")


def similar_pairs(df: DataFrame, shingle: int = 5, threshold: float = 0.8, least_words: int = 0) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of a table with id and text.

    members: id, doc - the distinct ids and the text they hold, named by a 64-bit hash of its words.
    pairs: doc_a < doc_b with similarity >= threshold between different texts. Similarity is the
    share of the distinct shingles of both that both hold. Null ids or texts, texts of fewer words
    than a shingle or ``least_words`` and texts in Chinese, Japanese or Thai writing are no members;
    repeated rows count once; if one id holds several texts, it is a member of each.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    raw = scratch.save(sketches(df, shingle, least_words), "raw")
    members = scratch.save(raw.select("id", "doc").distinct(), "members")
    docs = scratch.save(raw.groupBy("doc").agg(F.first(F.struct("words", "tokens", "payload")).alias("s")).select("doc", "s.*"), "docs")
    scratch.drop("raw")

    def branch(rows: DataFrame, slots: list) -> DataFrame:
        """A child for each slot of the rows of node, doc, tokens."""
        return rows.select(F.explode(F.array(*[F.xxhash64("node", s, F.get("tokens", s)) for s in slots])).alias("node"), "doc")

    def chosen() -> list:
        """Three different slots, the same for all documents of a node."""
        a, b, c = [F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS - j)).cast("int") for j in (0, 1, 2)]
        b = b + (b >= a).cast("int")
        c = c + (c >= F.least(a, b)).cast("int")
        return [a, b, c + (c >= F.greatest(a, b)).cast("int")]

    def compared(nodes: DataFrame) -> DataFrame:
        """Candidates of nodes; those of more than SMALL documents in pairs of blocks, so that no task holds a node."""
        blocks = F.ceil(F.col("size") / SMALL).cast("int")
        block = F.pmod(F.xxhash64("doc", F.lit(5)), blocks).cast("int")
        spread = nodes.select("node", "doc", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        spread = spread.select("node", "doc", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
        full = spread.join(docs.select("doc", "payload"), "doc")
        sides = [F.collect_list(F.when(F.col("block") == F.col("i"), F.col("payload"))), F.collect_list(F.when(F.col("block") != F.col("i"), F.col("payload")))]
        grouped = full.groupBy("node", "i", "j").agg(sides[0].alias("xs"), sides[1].alias("ys"))
        # Two different blocks need a document of each; one block two.
        return _compare(grouped.where("i = j or (size(xs) > 0 and size(ys) > 0)").select("xs", "ys"), most)

    # A value's bits differ in a sketch with probability (1 - s)(1 - 2^-PLANES).
    differ = (1 - threshold) * (1 - 0.5**PLANES)
    most = int(VALUES * differ + ERRORS * (VALUES * differ * (1 - differ)) ** 0.5)
    two = [(3 * t + x, 3 * t + y) for t in range(TREES) for x, y in ((0, 1), (0, 2), (1, 2))]
    roots = F.array(*[F.xxhash64(F.lit(x), F.lit(y), F.get("tokens", F.lit(x)), F.get("tokens", F.lit(y))) for x, y in two])
    rows, active, small = docs.select(F.explode(roots).alias("node"), "doc"), docs.select("doc", "tokens"), []
    for depth in range(2, DEPTH + 1):
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        nodes = scratch.save(rows.join(sizes, "node").select("node", "size", "doc"), f"nodes{depth}")
        scratch.sweep()
        limit = SMALL if depth < DEPTH else 1 << 62
        small.append(nodes.where(F.col("size") <= limit))
        large = nodes.where(F.col("size") > limit)
        if large.isEmpty():
            break
        # Only documents that still are in large nodes bring their tokens along.
        active = scratch.save(active.join(large.select("doc").distinct(), "doc", "left_semi"), f"active{depth}")
        scratch.drop(f"active{depth - 1}")
        rows = branch(large.join(active, "doc"), chosen())
    candidates = scratch.save(compared(reduce(lambda a, b: a.unionByName(b), small)).distinct(), "candidates")
    scratch.drop(f"active{depth - 1}", *[f"nodes{k + 2}" for k in range(len(small))])
    scratch.sweep()
    words = docs.select("doc", "words")
    one, other = (words.select(F.col("doc").alias(f"doc_{x}"), F.col("words").alias(f"words_{x}")) for x in "ab")
    pairs = scratch.save(_verify(candidates.join(one, "doc_a").join(other, "doc_b"), shingle, threshold), "pairs")
    scratch.drop("docs", "candidates")
    return members, pairs


def similar_ids(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """id_a < id_b: the pairs of different ids whose texts are equal or similar."""
    a = members.select(F.col("doc").alias("doc_a"), F.col("id").alias("x"))
    b = members.select(F.col("doc").alias("doc_b"), F.col("id").alias("y"))
    copies = a.join(b, F.col("doc_a") == F.col("doc_b")).where("x < y").select("x", "y")
    between = pairs.join(a, "doc_a").join(b, "doc_b").where("x <> y").select("x", "y")
    return copies.unionByName(between).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_ids(*similar_pairs(table(spark, sf_dir, "records"), shingle=3, threshold=0.5, least_words=36))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, class_id, n_links: each member id, its class of equal texts and the number of similar other texts."""
    members, pairs = similar_pairs(table(spark, sf_dir, "records"), shingle=3, threshold=0.5, least_words=36)
    ends = pairs.select(F.col("doc_a").alias("doc")).unionByName(pairs.select(F.col("doc_b").alias("doc")))
    links = ends.groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "doc", "left").select("id", F.col("doc").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
