"""Run configuration: environment variables in it, paths relative to it, the kinds of sources there are."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from weftline.model import Options

_VARIABLE = re.compile(r"\$\{(\w+)\}")


@dataclass(frozen=True)
class SourceKind:
    suffixes: tuple[str, ...]
    read: Callable[[SparkSession, str], DataFrame] | None = None


#: Kinds of sources and their files; ``register`` adds more.  Those analysed elsewhere arrive as packages.
KINDS: dict[str, SourceKind] = {
    "angular": SourceKind((".ts", ".html")), "dotnet-api": SourceKind((".cs", ".config", ".json")), "dotnet-batch": SourceKind((".cs", ".config", ".json", ".csv")), "plsql": SourceKind((".sql", ".pks", ".pkb", ".prc", ".fnc", ".trg")),
    "sql-file": SourceKind((".sql",)), "sql-loader": SourceKind((".ctl",)), "xml-sql": SourceKind((".xml",)), "catalog": SourceKind((".csv",)), "jobs": SourceKind((".csv",)), "package": SourceKind((".csv",)),
}


def register(name: str, kind: SourceKind) -> None:
    KINDS[name] = kind


def supported() -> list[str]:
    return sorted(KINDS)


def dotenv(path: str) -> dict[str, str]:
    """NAME=value lines; quotes around values are taken off, comments and blank lines skipped."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines() if Path(path).exists() else []:
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not name.startswith("#"):
            out[name.strip()] = value.strip().strip("\"'")
    return out


def expanded(value: object, env: Mapping[str, str]) -> object:
    """``value`` with ${NAME} filled in everywhere; a name that isn't set is an error."""
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [expanded(v, env) for v in value]
    if not isinstance(value, str):
        return value
    missing = [n for n in _VARIABLE.findall(value) if n not in env]
    if missing:
        raise ValueError(f"not set: {', '.join(missing)}")
    return _VARIABLE.sub(lambda m: env[m.group(1)], value)


def load(path: str, env: Mapping[str, str] | None = None) -> dict:
    """A configuration with variables filled in, root and output absolute, and source types checked."""
    at = Path(path).resolve()
    config = expanded(json.loads(at.read_text(encoding="utf-8")), {**dotenv(str(at.parent / ".env")), **(os.environ if env is None else env)})
    assert isinstance(config, dict)
    for key in ("root", "output", "inputData"):
        if config.get(key):
            config[key] = str((at.parent / config[key]).resolve())
    unknown = {s.get("type") for s in config.get("sources", [])} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown source types: {sorted(map(str, unknown))}; there are {', '.join(supported())}")
    return config


def options(config: dict) -> Options:
    """Bounds and thresholds of a configuration's ``enrichment`` and ``limits``, checked."""
    e, li = config.get("enrichment") or {}, config.get("limits") or {}
    given = {"flow_max_depth": e.get("flowMaxDepth"), "max_flow_targets": e.get("maxFlowTargetsPerEntry"), "min_resolution_confidence": e.get("minimumResolutionConfidence"), "max_file_bytes": li.get("maxFileBytes"), "max_tree_lines": li.get("maxTreeLines"), "max_snippet_chars": li.get("maxSnippetChars"), "max_issues_per_type": li.get("maxIssuesPerTypePerFile"), "chunk_bytes": li.get("chunkBytes")}
    given = {k: v for k, v in given.items() if v is not None}
    if e.get("flowEntryTypes"):
        given["flow_entry_types"] = frozenset(e["flowEntryTypes"])
    if any(not isinstance(v, frozenset) and v <= 0 for v in given.values()):
        raise ValueError("bounds must be positive")
    return Options(**given)
