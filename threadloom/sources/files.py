"""Files of records and of public benchmarks: CSV, JSON lines, JSON, zstd and zipped tables, with label maps.

Readers keep Spark's split reading wherever the format allows; zstd and zip archives are read one
file a task. Lines that cannot be read come back as ``_corrupt_record`` rows, never as nothing.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A CSV with a header; fields may hold line breaks and doubled quotes; all columns are strings."""
    return spark.read.options(**({"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"} | options)).csv(path)


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """A table without header and quoting; short rows are padded with nulls, long ones cut to the columns."""
    lines = spark.read.option("encoding", encoding).option("lineSep", "\n").csv(path, sep="\u0001", schema="line string", quote="")
    parts = F.split(F.regexp_replace("line", "\r$", ""), "\t", -1)
    return lines.select(*[F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)])


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON object a line; unreadable lines keep their text in _corrupt_record."""
    reader = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects, or an object whose ``data`` is one."""
    df = spark.read.option("multiLine", True).json(path)
    if df.columns == ["data"]:
        return df.select(F.explode("data").alias("_d")).select("_d.*")
    return df


def _archive(spark: SparkSession, path: str, lines) -> DataFrame:
    """path, line of every text line of archives; lines opens one from its path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                buffer: list[str] = []
                for line in lines(content):
                    buffer.append(line)
                    if len(buffer) == 4096:
                        yield pd.DataFrame({"path": name, "line": buffer})
                        buffer = []
                if buffer:
                    yield pd.DataFrame({"path": name, "line": buffer})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, line string")


def read_zstd_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """zstd-compressed JSON lines with windows of up to 2 GB, as ``schema`` with _corrupt_record for unreadable lines."""

    def lines(content: bytes) -> Iterator[str]:
        with zstandard.ZstdDecompressor(max_window_size=2**31).stream_reader(io.BytesIO(content), read_across_frames=True) as raw:
            for line in io.TextIOWrapper(raw, "utf-8", "replace"):
                if line.strip():
                    yield line

    parsed = F.from_json("line", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return _archive(spark, path, lines).select(parsed.alias("_r")).select("_r.*")


def read_zipped_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Tables without header and quoting inside zip archives; rows are padded or cut to the columns."""

    def lines(content: bytes) -> Iterator[str]:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for name in archive.namelist():
                with archive.open(name) as member:
                    for line in io.TextIOWrapper(member, "utf-8", "replace", newline="\n"):
                        yield line.rstrip("\r\n")

    parts = F.split("line", "\t", -1)
    return _archive(spark, path, lines).select(*[F.nullif(F.get(parts, F.lit(k)), F.lit("")).alias(c) for k, c in enumerate(columns)])


def text_key(text: Column, digits: int = 16) -> Column:
    """The first hex digits of the SHA-1 of the lower-case text."""
    return F.substring(F.sha1(F.lower(text)), 1, digits)


def mapped_label(label: Column, names: Mapping[str, str | int]) -> Column:
    """The label's name in a map, whatever its case and blanks; null for labels outside the map."""
    return F.element_at(F.create_map(*[F.lit(str(x)) for kv in names.items() for x in kv]), F.lower(F.trim(label))) if names else F.lit(None).cast("string")


# Label maps of public benchmarks.
SIX_WAY = {"pants-fire": 1, "false": 1, "barely-true": 1, "mostly-true": 0, "true": 0}
STANCE_LABELS = {"favor": "support", "against": "deny", "none": "discuss"}
EVIDENCE_LABELS = {"supports": "support", "refutes": "deny", "not enough info": "discuss"}
SIX_WAY_COLUMNS = ("id", "label", "statement", "subjects", "speaker", "job", "state", "party", "barely_true", "false", "half_true", "mostly_true", "pants_fire", "context")


def six_way_statements(rows: DataFrame) -> DataFrame:
    """text, label (1 false), group of rated statements: half-true and unknown ratings are left out; a statement without speaker is its own group."""
    y = mapped_label(F.col("label"), SIX_WAY).cast("int")
    group = F.coalesce(F.nullif(F.lower(F.trim("speaker")), F.lit("")), F.concat(F.lit("unknown-"), F.substring(F.sha1("statement"), 1, 10)))
    return rows.select(F.col("statement").alias("text"), y.alias("label"), group.alias("split_group")).where("label is not null and text is not null and trim(text) <> ''")


def labelled_news(parts: Sequence[tuple[DataFrame, int]]) -> DataFrame:
    """text, label, claim_id, outlet from tables of id, title and news_url with one label each; the claim falls back from id to address to text."""
    out = None
    for rows, label in parts:
        url = F.nullif(F.trim("news_url"), F.lit(""))
        host = F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z]+://)?([^/:?#]+)", 1)), r"^www\.", "")
        one = rows.where("title is not null and trim(title) <> ''").select(F.col("title").alias("text"), F.lit(label).alias("label"), F.coalesce(F.nullif(F.trim("id"), F.lit("")), url, text_key(F.col("title"))).alias("claim_id"), F.nullif(host, F.lit("")).alias("outlet"))
        out = one if out is None else out.unionByName(one)
    return out


def consistent_claims(rows: DataFrame, text: str, label: str) -> DataFrame:
    """text, label, claim_id: one row per claim; claims with different labels, and null or empty texts, are left out."""
    known = rows.where(F.col(text).isNotNull() & (F.trim(text) != "") & F.col(label).isNotNull())
    by = known.select(F.col(text).alias("text"), F.col(label).alias("label"), text_key(F.col(text)).alias("claim_id")).groupBy("claim_id")
    return by.agg(F.min("text").alias("text"), F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").select("text", "label", "claim_id")


def stance_pairs(rows: DataFrame, target: str, text: str, label: str, names: Mapping[str, str] = STANCE_LABELS) -> DataFrame:
    """target, text, stance, claim_id; labels outside the map are left out."""
    return rows.select(F.col(target).alias("target"), F.col(text).alias("text"), mapped_label(F.col(label), names).alias("stance"), text_key(F.col(target)).alias("claim_id")).where("stance is not null and text is not null")


def account_rows(campaigns: Mapping[str, tuple[DataFrame, int]]) -> DataFrame:
    """account_id, label, split_group, followers, following, posts of user tables by campaign: bots of a campaign are one group, people each their own."""
    out = None
    for name, (rows, label) in campaigns.items():
        number = lambda c: F.col(c).try_cast("bigint") if c in rows.columns else F.lit(None).cast("bigint")  # noqa: E731, B023
        account = F.trim(F.col("id").cast("string"))
        one = rows.select(account.alias("account_id"), F.lit(label).alias("label"), (F.lit(name) if label else F.concat(F.lit("genuine:"), account)).alias("split_group"), number("followers_count").alias("followers"), number("friends_count").alias("following"), number("statuses_count").alias("posts")).where("account_id is not null and account_id <> ''")
        out = one if out is None else out.unionByName(one)
    return out


def parsed_object(text: Column, schema: str) -> Column:
    """The first JSON object inside a text as ``schema``; null where there is none that can be read."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def to_json_lines(rows: Sequence[Mapping], path: str) -> None:
    """A small file of JSON lines, for fixtures and reports."""
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r, ensure_ascii=False, default=str) + "\n" for r in rows)
