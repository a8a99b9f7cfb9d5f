"""Git as a source: tracked files, the commit at HEAD and the blobs that it holds. The command runs on the driver, once a call; what it
lists are names and ids, a row each."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, timeout=600, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None


def head(root: str) -> str | None:
    """The commit at HEAD; None outside of a repository or before its first commit."""
    out = _git(root, "rev-parse", "--verify", "-q", "HEAD")
    return out.strip() if out else None


def head_blob(root: str, path: str) -> str | None:
    """The id of a path's committed blob; None if HEAD doesn't hold it."""
    out = _git(root, "rev-parse", "--verify", "-q", f"HEAD:{path}")
    return out.strip() if out else None


def tracked(spark: SparkSession, root: str) -> DataFrame:
    """path: the files that Git tracks; none outside of a repository."""
    names = sorted({p for p in (_git(root, "ls-files", "-z") or "").split("\0") if p})
    return spark.createDataFrame([(p,) for p in names], "path string")


def committed(spark: SparkSession, root: str) -> DataFrame:
    """path, blob: every file of the commit at HEAD, by one listing; submodules are no files."""
    rows = []
    for line in (_git(root, "ls-tree", "-r", "-z", "HEAD") or "").split("\0"):
        meta, _, path = line.partition("\t")
        if path and meta.split()[1] == "blob":
            rows.append((path, meta.split()[2]))
    return spark.createDataFrame(rows, "path string, blob string")
