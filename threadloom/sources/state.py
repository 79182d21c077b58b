"""Small state beside the tables: artifact digests, the manifest, cursors and daily quotas, in JSON files.

Each write replaces its file in one rename, so that a crash leaves the old or the new one.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _replace(path: Path, value: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_name(f".{path.name}.{os.getpid()}")
    new.write_text(json.dumps(value, indent=1, sort_keys=True, default=str), encoding="utf-8")
    new.replace(path)


def _read(path: Path) -> dict:
    return json.loads(path.read_text(encoding="utf-8")) if path.exists() else {}


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a folder, hashed where the files are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def tree_digest(spark: SparkSession, path: str) -> tuple[str, int]:
    """The digest over the sorted (relative path, digest) of a folder's files, and their number."""
    root = path.rstrip("/")
    rows = sorted((r["path"].split(root, 1)[-1].lstrip("/"), r["sha256"]) for r in file_digests(spark, path).toLocalIterator())
    whole = hashlib.sha256()
    for name, digest in rows:
        whole.update(f"{name}\0{digest}\n".encode())
    return whole.hexdigest(), len(rows)


class Manifest:
    """What each table holds: rows, model versions, time, and artifacts by key."""

    def __init__(self, path: str):
        self.path = Path(path)

    def update(self, table: str, rows: int, versions: dict[str, str], **extra: object) -> None:
        state = _read(self.path)
        state.setdefault("tables", {})[table] = {"rows": rows, "model_versions": versions, "generated_at": dt.datetime.now(dt.timezone.utc).isoformat(), **extra}
        _replace(self.path, state)

    def artifact(self, key: str, **facts: object) -> dict:
        state = _read(self.path)
        entry = {"recorded_at": dt.datetime.now(dt.timezone.utc).isoformat(), **facts}
        state.setdefault("artifacts", {})[key] = entry
        _replace(self.path, state)
        return entry

    def read(self) -> dict:
        return _read(self.path)

    def summary(self) -> list[dict]:
        return [{"table": t, **x} for t, x in sorted(_read(self.path).get("tables", {}).items())]


class Cursor:
    """Progress of one source: values, counters and finished units."""

    def __init__(self, path: str):
        self.path = Path(path)
        self.state = _read(self.path)

    def set(self, key: str, value: object, flush: bool = True) -> None:
        self.state[key] = value
        if flush:
            _replace(self.path, self.state)

    def get(self, key: str, default: object = None) -> object:
        return self.state.get(key, default)

    def bump(self, key: str, amount: int = 1) -> int:
        self.set(key, int(self.state.get(key, 0)) + amount)
        return self.state[key]

    def mark_done(self, unit: str) -> None:
        if not self.is_done(unit):
            self.set("done", [*self.state.get("done", []), unit])

    def is_done(self, unit: str) -> bool:
        return unit in self.state.get("done", [])


class Quota:
    """Units of a UTC day, charged before a call; a new day begins at zero."""

    def __init__(self, path: str, daily: int, today=lambda: dt.datetime.now(dt.timezone.utc).date()):
        self.path, self.daily, self.today = Path(path), daily, today

    def _now(self) -> dict:
        state, day = _read(self.path), self.today().isoformat()
        return state if state.get("day") == day else {"day": day, "used": 0, "calls": {}}

    def charge(self, units: int, call: str = "unknown") -> int:
        """What is left after the charge; raises before anything is written if it does not fit."""
        state = self._now()
        if state["used"] + units > self.daily:
            raise RuntimeError(f"{call} needs {units} of {self.daily - state['used']} units left today")
        state["used"] += units
        state["calls"][call] = state["calls"].get(call, 0) + 1
        _replace(self.path, state)
        return self.daily - state["used"]

    def count(self, call: str) -> int:
        return self._now()["calls"].get(call, 0)
