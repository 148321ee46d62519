"""Commit graph: first parents, descendants, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import closure


def children(commits: DataFrame) -> DataFrame:
    """(parent, child) over first parents, from (sha, first_parent)."""
    return commits.filter("first_parent is not null").select(F.col("first_parent").alias("parent"), F.col("sha").alias("child")).distinct()


def descendants(commits: DataFrame, sha: str) -> DataFrame:
    """(sha, depth): commits that have ``sha`` among their first ancestors."""
    root = commits.sparkSession.createDataFrame([(sha,)], "node string")
    return closure(children(commits), root).select(F.col("node").alias("sha"), "depth")


def listing(found: DataFrame, subjects: DataFrame) -> DataFrame:
    """(sha, subject) in order of sha; a commit without a known subject keeps its row."""
    return found.join(subjects, "sha", "left").select("sha", F.coalesce("subject", F.lit("")).alias("subject")).orderBy("sha")
