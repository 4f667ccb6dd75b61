"""Sources that ask git: the base of a change, its diff, and a tree's listing.

These run on the driver, as a repository is a folder there; what they return is a
DataFrame of one change or of the tree's files, and everything after is a plan."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

MOST_OUTPUT = 64 << 20  # bytes of a diff; a larger one is the change's own fault


def git(repo: str, *args: str) -> str:
    """What git prints; CalledProcessError where it fails."""
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout.decode(errors="replace")


def ensure_base(repo: str, base: str) -> bool:
    """Whether the base can be resolved, after a fetch of its branch where it is remote. A
    fetch that fails is no error: the base may be there already."""
    remote, _, branch = base.partition("/")
    if branch:
        subprocess.run(["git", "-C", repo, "fetch", "--quiet", remote, f"{branch}:refs/remotes/{base}"], capture_output=True)
    return subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "--quiet", f"{base}^{{commit}}"], capture_output=True).returncode == 0


def change(spark: SparkSession, repo: str, base: str, head: str = "HEAD", change_id: str = "", most: int = MOST_OUTPUT) -> DataFrame:
    """One row: id, patch and stat of what head adds since it left base (a three-dot diff);
    error says why there is none: no repository, no such base, or too large."""
    schema = "id string, patch string, stat string, error string"
    row = (change_id, None, None)
    try:
        patch, stat = git(repo, "diff", f"{base}...{head}"), git(repo, "diff", "--stat=400", f"{base}...{head}")
    except (OSError, subprocess.CalledProcessError) as e:
        return spark.createDataFrame([(*row, f"git: {getattr(e, 'stderr', b'') or e}")], schema)
    if len(patch.encode()) > most:
        return spark.createDataFrame([(*row, "too large")], schema)
    return spark.createDataFrame([(change_id, patch, stat, None)], schema)


def listing(repo: str) -> list[str]:
    """Tracked files and new ones that are not ignored, in order; none outside of a repository."""
    try:
        out = git(repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard")
    except (OSError, subprocess.CalledProcessError):
        return []
    return sorted({p for p in out.split("\0") if p})


def working_tree(spark: SparkSession, repo: str) -> DataFrame:
    """path, content, refused of the listed files; see :func:`files.tree_files`."""
    from .files import tree_files

    return tree_files(spark, repo, listing(repo))
