"""Several tables that become visible together.

A table is a folder of parts ``run=<id>``, each written by one run and never changed
by another; writing a part again replaces it. A commit is a small table of the parts
that belong together, written after them. Readers take the newest complete commit,
so they see products, history and ledger of the same run or of none.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Commit(NamedTuple):
    version: int
    parts: dict[str, list[str]]

    def with_parts(self, version: int, appended: dict[str, str], replaced: dict[str, str]) -> Commit:
        """The next commit: parts that join those of a table, and parts that take their place."""
        parts = {name: list(own) for name, own in self.parts.items()}
        for name, run in appended.items():
            parts[name] = [*(p for p in parts.get(name, []) if p != run), run]
        return Commit(version, parts | {name: [run] for name, run in replaced.items()})


def write_part(df: DataFrame, path: str, table: str, run: str, partition_by: str | None = None) -> None:
    """One run's rows of a table; a repeated run replaces its own rows and no other's."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{table}/run={run}")


def write_commit(spark: SparkSession, path: str, commit: Commit) -> None:
    """Make a commit visible; a row per part, so it is small."""
    rows = [(name, place, run) for name, own in sorted(commit.parts.items()) for place, run in enumerate(own)]
    spark.createDataFrame(rows, "table string, place int, run string").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/version={commit.version}")


def complete_versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The folders ``version=<n>`` below ``path`` that were written to their end."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(root)] if files.exists(root) else []
    return {int(p.getName().split("=")[1]): p.toString() for p in found if p.getName().startswith("version=") and files.exists(hadoop.Path(p, "_SUCCESS"))}


def newest_commit(spark: SparkSession, path: str, before: int | None = None) -> Commit | None:
    """The newest complete commit, or the newest before a version; None if there is none."""
    done = {v: p for v, p in complete_versions(spark, f"{path}/commits").items() if before is None or v < before}
    if not done:
        return None
    parts: dict[str, list[str]] = {}
    for r in spark.read.parquet(done[max(done)]).orderBy("table", "place").collect():
        parts.setdefault(r["table"], []).append(r["run"])
    return Commit(max(done), parts)


def committed(spark: SparkSession, path: str, commit: Commit, table: str) -> DataFrame | None:
    """A table's rows as of a commit, with their ``run``; None if it has no part."""
    own = commit.parts.get(table)
    if not own:
        return None
    return spark.read.option("basePath", f"{path}/{table}").parquet(*(f"{path}/{table}/run={run}" for run in own)).withColumn("run", F.col("run").cast("string"))
