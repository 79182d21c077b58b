"""Mixing sources to target shares of a token budget.

Documents are counted by exact token length. Each source's budget is met by whole passes over
its documents, a proportional part of every length, and a bounded-knapsack search over the
length counts for what remains. Which documents of a length are taken follows from a seeded hash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.subsets import closest
from threadloom.operators.ranking import rank_within
from threadloom.session import Scratch
from threadloom.tables import table

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEED = 11
BUDGET_SHARE = 0.5
# Fixed value: the pre-tokenisation of byte-level BPE vocabularies of 50k entries.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(df: DataFrame, text_col: str = "text", vocabulary: str = TOKENIZER) -> DataFrame:
    """df with n_tokens: tokens of the whole text by a public vocabulary; 0 for null or empty text."""
    names = [c for c in df.columns if c not in (text_col, "n_tokens")]
    kept = df.select(*names, F.col(text_col).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for pdf in batches:
            n = [len(encode(t)) if isinstance(t, str) else 0 for t in pdf.pop("_text")]
            yield pdf.assign(n_tokens=n)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "_text"), "n_tokens bigint"])
    return kept.mapInPandas(count, schema)


def water_fill(total: int, sources: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Budgets that sum to ``total`` where capacities allow: sources at their cap pass their lack on in proportion to share."""
    budget: dict[str, float] = {}
    open_ = {s: share for s, (share, cap) in sources.items() if share > 0 and cap > 0}
    left = float(total)
    while open_:
        scale = left / sum(open_.values())
        full = [s for s, share in open_.items() if share * scale >= sources[s][1]]
        for s in full or list(open_):
            budget[s] = min(float(sources[s][1]), open_[s] * scale)
        if not full:
            break
        for s in full:
            left -= sources[s][1]
            del open_[s]
    return budget


def fit_lengths(target: int, counts: dict[int, int]) -> dict[int, int]:
    """How many documents of each length to take so that the tokens come closest to ``target`` (each at most once)."""
    total = sum(n * c for n, c in counts.items())
    if target >= total:
        return dict(counts)
    take = {n: int(c * target / total) for n, c in counts.items()}
    rest = target - sum(n * k for n, k in take.items())
    for n, k in closest({n: c - take[n] for n, c in counts.items()}, rest).items():
        take[n] += k
    return take


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = TOKENIZER, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: doc_id, source, n_tokens, copies for every document that is used.
    shares: source, target_share, reached_share, tokens, documents, copies_most, available_tokens per target source.
    The budget is ``budget_share`` of the tokens of all documents; what capped or absent sources lack
    goes to the others in proportion to their shares, as far as these allow. Null sources, sources
    without target and targets without documents are not used; repeated target rows count once.
    """
    spark = documents.sparkSession
    sized = Scratch(spark, "mixing").save(token_counts(documents.select("doc_id", "source", "text"), "text", vocabulary), "sized")
    wanted = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).collect()}
    total = sized.agg(F.sum("n_tokens")).first()[0] or 0
    lengths = sized.where(F.col("source").isin(list(wanted))).groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by sources times distinct lengths
    counts: dict[str, dict[int, int]] = {}
    for r in lengths:
        counts.setdefault(r["source"], {})[r["n_tokens"]] = r["n"]
    tokens = {s: sum(n * c for n, c in by.items()) for s, by in counts.items()}
    budget = water_fill(round(total * budget_share), {s: (share or 0.0, tokens.get(s, 0) * (most or 0)) for s, (share, most) in wanted.items()})
    rows, report = [], []
    for s, (share, _) in sorted(wanted.items()):
        have = tokens.get(s, 0)
        passes, rest = divmod(round(budget.get(s, 0)), have) if have else (0, 0)
        take = fit_lengths(rest, counts[s]) if rest else {}
        for n, c in counts.get(s, {}).items():
            if passes or take.get(n):
                rows.append((s, n, passes, take.get(n, 0)))
        reached = passes * have + sum(n * k for n, k in take.items())
        report.append((s, share, reached, passes + bool(take), have))
    whole = sum(r[2] for r in report)
    plan = spark.createDataFrame(rows, "p_source string, p_tokens bigint, passes bigint, extra bigint")
    ranked = rank_within(sized.where(F.col("source").isin(list(wanted))), ["source", "n_tokens"], F.xxhash64("doc_id", F.lit(seed)), max(1, sum(r["n"] for r in lengths) // 50_000))
    copies = F.col("passes") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    selection = ranked.join(plan, (F.col("source") == F.col("p_source")) & (F.col("n_tokens") == F.col("p_tokens"))).select("doc_id", "source", "n_tokens", copies.cast("bigint").alias("copies")).where("copies > 0")
    shares = spark.createDataFrame([(s, share, reached / whole if whole else 0.0, reached, most, have) for s, share, reached, most, have in report], "source string, target_share double, reached_share double, tokens bigint, copies_most bigint, available_tokens bigint")
    return selection, shares


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
