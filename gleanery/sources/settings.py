"""Labelled question sets, verdict files and sample keys: TOML files read into tables.

Each kind of file is a list of field rules. All faults of a file are collected and reported together,
and a file with any fault gives no table.
"""

from __future__ import annotations

import tomllib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class ConfigError(ValueError):
    """A file is not usable; the message lists every fault found."""


@dataclass(frozen=True)
class Field:
    """One column: where it comes from, when it is fine, and its value where the file has none."""

    column: str
    kind: str
    key: str
    fine: Callable[[Any], bool]
    absent: Any = None


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _texts(value: Any) -> bool:
    return isinstance(value, list) and all(map(_text, value))


def _flag(value: Any) -> bool:
    return isinstance(value, bool)


QUESTION = (
    Field("qid", "string", "id", _text),
    Field("question", "string", "question", _text),
    Field("answerable", "boolean", "answerable", _flag, True),
    Field("sources", "array<string>", "sources", _texts, []),
    Field("hard_negative", "boolean", "hard_negative", _flag, False),
)
VERDICT = (
    Field("qid", "string", "id", _text),
    Field("verdict", "string", "verdict", _text),
    Field("input_sha256", "string", "input_sha256", _text),
)
SAMPLED = (Field("set", "string", "set", _text), Field("qid", "string", "id", _text))


def _parsed(path: Path) -> dict[str, Any]:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as exc:
        raise ConfigError(f"{path.name}: {exc}") from exc


def _rows(path: Path, tables: Any, fields: Iterable[Field], faults: list[str]) -> list[list[Any]]:
    out = []
    for at, table in enumerate(tables if isinstance(tables, list) else []):
        row = []
        for f in fields:
            value = table.get(f.key, f.absent) if isinstance(table, dict) else None
            if not f.fine(value):
                faults.append(f"{path.name}, entry {at + 1}: {f.key} is {value!r}")
            row.append(value)
        out.append(row)
    if not out:
        faults.append(f"{path.name}: no entries")
    return out


def _frame(spark: SparkSession, rows: list[list[Any]], schema: str, faults: list[str]) -> DataFrame:
    if faults:
        raise ConfigError("; ".join(faults))
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def _schema(fields: Iterable[Field]) -> str:
    return ", ".join(f"{f.column} {f.kind}" for f in fields)


def read_questions(spark: SparkSession, path: Path, name: str) -> tuple[str, DataFrame]:
    """(pinned commit, labelled questions) of the set `name`; only answerable questions have sources."""
    raw, faults = _parsed(path), []
    rows = _rows(path, raw.get("question"), QUESTION, faults)
    commit = raw.get("pinned_commit")
    if not _text(commit):
        faults.append(f"{path.name}: pinned_commit is {commit!r}")
    for row in rows:
        qid, _, yes, sources, _ = row
        if yes is True and not sources:
            faults.append(f"{path.name}: {qid} is answerable but has no sources")
        if yes is not True:
            row[3] = []
        row[4] = row[4] is True and yes is False
    if not any(r[2] is True for r in rows):
        faults.append(f"{path.name}: nothing is answerable")
    numbered = [[name, *r, at] for at, r in enumerate(rows)]
    return commit, _frame(spark, numbered, f"set string, {_schema(QUESTION)}, position int", faults)


def read_verdicts(spark: SparkSession, path: Path, form: str, prompt_sha256: str) -> DataFrame:
    """(qid, verdict, input_sha256) as written; `verdict_faults` compares them with the questions."""
    raw, faults = _parsed(path), []
    for key, want in (("format", form), ("prompt_sha256", prompt_sha256)):
        if raw.get(key) != want:
            faults.append(f"{path.name}: {key} is {raw.get(key)!r} where {want!r} is needed")
    rows = _rows(path, raw.get("verdict"), VERDICT, faults)
    return _frame(spark, rows, _schema(VERDICT), faults)


def read_key(spark: SparkSession, path: Path) -> DataFrame:
    """(run_id, set, qid) of a sample key, a table for each run."""
    raw, faults = _parsed(path), []
    rows = _rows(path, list(raw.values()), SAMPLED, faults)
    return _frame(spark, [[k, *r] for k, r in zip(raw, rows)], f"run_id string, {_schema(SAMPLED)}", faults)
