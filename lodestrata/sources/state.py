"""Snapshots on disk: Parquet by scan, and the JSON document that other tools read."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "1.1"
REQUIRED = "version", "repo", "last_scan", "files"
SNAPSHOT = (
    "path string, language string, hash string, ast_hash string, "
    "definitions array<struct<name: string, type: string, line: int, is_public: boolean, parameters: array<string>, return_type: string>>, "
    "imports array<string>, change_type string, semantic_category string, last_modified timestamp"
)


def default() -> dict:
    return {"version": VERSION, "repo": {}, "last_scan": None, "files": {}, "readme_sections": {}, "dependency_graph": {}}


def load(path: str | Path) -> dict:
    """The document at path; the default one if it is missing, empty, not an object, or lacks a key."""
    try:
        found = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return default()
    if not isinstance(found, dict) or any(k not in found for k in REQUIRED):
        return default()
    if found["version"] == "1.0":
        found["version"] = VERSION
    return default() | found


def save(path: str | Path, document: dict) -> None:
    """Written beside its place and then moved there, so that readers never see half of it."""
    at = Path(path)
    at.parent.mkdir(parents=True, exist_ok=True)
    new = at.with_suffix(".new")
    new.write_text(json.dumps(document, indent=2), encoding="utf-8")
    new.replace(at)


def files_of(spark: SparkSession, document: dict) -> DataFrame:
    """The snapshot in a document."""
    rows = []
    for path, x in document["files"].items():
        defs = [(d["name"], d["type"], d.get("line"), d.get("is_public", not d["name"].startswith("_")), d.get("parameters") or [], d.get("return_type")) for d in x.get("definitions") or []]
        seen = x.get("last_modified")
        rows.append((path, x.get("language"), x.get("hash"), x.get("ast_hash"), defs, x.get("imports") or [], x.get("change_type"), x.get("semantic_category"), datetime.fromisoformat(seen) if seen else None))
    return spark.createDataFrame(rows, SNAPSHOT)


def document_of(snapshot: DataFrame, edges: DataFrame, repo: dict, now: datetime | None = None) -> dict:
    """The document of a snapshot and its import graph; a report for one repository, so it fits the driver."""
    out = default() | {"repo": repo, "last_scan": (now or datetime.now(UTC)).isoformat()}
    for r in snapshot.orderBy(F.split("path", "/")).toLocalIterator():
        x = r.asDict(recursive=True)
        path, seen = x.pop("path"), x.pop("last_modified", None)
        own = {k: v for k, v in x.items() if k in SNAPSHOT and v not in (None, [], "")}
        own["hash"] = x.get("hash") or ""
        if seen:
            own["last_modified"] = seen.isoformat()
        out["files"][path] = own
    from ..operators import graph

    forward = {r["path"]: list(r["dependencies"]) for r in graph.adjacency(edges).toLocalIterator()}
    back = {r["path"]: list(r["dependencies"]) for r in graph.adjacency(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).toLocalIterator()}
    nodes = {p: {"imports": x.get("imports", []), "language": x.get("language")} for p, x in out["files"].items()}
    out["dependency_graph"] = {"nodes": nodes, "dependencies": forward, "dependents": back}
    return out


def graph_of(spark: SparkSession, document: dict) -> tuple[DataFrame, DataFrame]:
    """nodes (path, imports, language) and edges (src, dst) of the import graph that a document has."""
    own = document.get("dependency_graph") or {}
    nodes = [(p, x.get("imports") or [], x.get("language")) for p, x in (own.get("nodes") or {}).items()]
    edges = [(p, q) for p, to in (own.get("dependencies") or {}).items() for q in to]
    return spark.createDataFrame(nodes, "path string, imports array<string>, language string"), spark.createDataFrame(edges, "src string, dst string")


def append(snapshot: DataFrame, folder: str, scan_id: str) -> None:
    """The snapshot as one partition of a Parquet table, from which readers prune the others."""
    snapshot.write.mode("overwrite").parquet(f"{folder}/scan_id={scan_id}")


def read(spark: SparkSession, folder: str, scan_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows if scan_id is None else rows.where(F.col("scan_id") == scan_id)
