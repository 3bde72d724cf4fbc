"""Working trees as DataFrames.

Spark's own file source leaves out empty files and names that begin with `_` or `.`; so the driver lists names only,
without descending into ignored folders, and executors read and hash the contents.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


def _git(folder: str | os.PathLike, *words: str) -> str | None:
    """What git prints, null if it fails or is not installed."""
    try:
        done = subprocess.run(["git", *words], cwd=folder, capture_output=True, text=True, check=False)
    except OSError:
        return None
    return None if done.returncode else done.stdout


class RepositoryNotFound(Exception):
    """The folder is no working tree."""


@dataclass(frozen=True)
class Repository:
    root: str
    name: str
    branch: str
    commit: str

    @classmethod
    def at(cls, folder: str | os.PathLike = ".") -> Repository:
        root = Path(folder).resolve()
        if not (root / ".git").exists():
            raise RepositoryNotFound(str(root))

        def git(*words: str) -> str:
            return (_git(root, *words) or "").strip() or "unknown"

        return cls(str(root), root.name, git("rev-parse", "--abbrev-ref", "HEAD"), git("rev-parse", "--short", "HEAD"))

    def columns(self) -> dict:
        return {k: F.lit(v) for k, v in vars(self).items()}


def names(root: str) -> Iterator[str]:
    """Paths of regular files relative to root, ignored folders left out."""
    out = lambda x: x in paths.IGNORED or x.endswith(paths.IGNORED_END)
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(x for x in folders if not out(x))
        for x in sorted(files):
            if not out(x) and os.path.isfile(os.path.join(folder, x)):
                yield os.path.relpath(os.path.join(folder, x), root).replace(os.sep, "/")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path of every file that isn't ignored."""
    return spark.createDataFrame([(x,) for x in names(root)], "path string")


def in_string_order(listed: DataFrame) -> DataFrame:
    """path of the files that are scanned, in the order of strings, in which `a.py` precedes `a/b.py`."""
    return source_files(listed).select("path").orderBy("path")


def source_files(listed: DataFrame) -> DataFrame:
    """path, path_parts and language of files that are scanned."""
    own = listed.where(paths.is_source(F.col("path")) & ~paths.is_ignored(F.col("path")))
    return own.select("path", paths.parts(F.col("path")).alias("path_parts"), paths.language(F.col("path")).alias("language"))


def contents(listed: DataFrame, root: str) -> DataFrame:
    """listed with content; files that can't be read have none.  root must be a folder that every executor sees."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                data = []
                for x in part.column("path"):
                    try:
                        data.append(Path(root, x.as_py()).read_bytes())
                    except OSError:
                        data.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], [*part.schema.names, "content"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in listed.schema)
    return listed.mapInArrow(run, f"{kinds}, content binary")


def log_text(root: str, limit: int = 100, since: str | None = None) -> str:
    """The commit log as text, empty without a repository."""
    words = ["log", f"--max-count={limit}", "--pretty=format:%H|%an|%at|%s", "--numstat"] + ([f"--since={since}"] if since else [])
    return (_git(root, *words) or "").strip()


def logs(spark: SparkSession, root: str, limit: int = 100, since: str | None = None) -> DataFrame:
    """repo, text of one repository, for history.parse_log()."""
    return spark.createDataFrame([(root, log_text(root, limit, since))], "repo string, text string")
