"""Catalogue tables on storage and report files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder


def rebuild(rows: DataFrame, path: str, source_ids: list[int], kinds: list[str]) -> int:
    """Replace the (source_id, kind) partitions named, also when ``rows`` has none for them.

    ``rows`` is evaluated once, into a staged folder whose partitions then take the place of the old
    ones; so it may itself read ``path``. Returns how many rows were written.
    """
    spark = rows.sparkSession
    staged = new_folder(spark, "rebuild")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("source_id", "kind").parquet(staged)
    for source in source_ids:
        for kind in kinds:
            purge(spark, f"{path}/source_id={source}/kind={kind}")
    for source in children(spark, staged):
        for kind in children(spark, f"{staged}/{source}"):
            move(spark, f"{staged}/{source}/{kind}", f"{path}/{source}/{kind}")
    purge(spark, staged)
    return seen.get["rows"]


def run_stage(
    spark: SparkSession,
    stage: str,
    build: Callable[[], DataFrame],
    path: str,
    source_ids: list[int],
    kinds: list[str],
) -> DataFrame:
    """Rebuild partitions and report one (stage, ms, detail, rows) row, measured in the writing pass.

    A stage that fails leaves its partitions empty rather than stale, and the run goes on.
    """
    start, written = time.monotonic(), None
    try:
        written = rebuild(build(), path, source_ids, kinds)
        detail = "done"
    except Exception as error:
        for source in source_ids:
            for kind in kinds:
                purge(spark, f"{path}/source_id={source}/kind={kind}")
        detail = f"FAILED: {str(error).splitlines()[0]}"
    ms = int((time.monotonic() - start) * 1000)
    return spark.createDataFrame([(stage, ms, detail, written)], "stage string, ms bigint, detail string, rows bigint")


def append_metrics(record: DataFrame, path: str) -> None:
    record.write.mode("append").parquet(path)


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names of the partition folders in a folder."""
    path, fs = _file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def move(spark: SparkSession, staged: str, target: str) -> None:
    """Put a staged partition in the place of an old one."""
    purge(spark, target)
    old, fs = _file_system(spark, staged)
    new, _ = _file_system(spark, target)
    fs.mkdirs(new.getParent())
    if not fs.rename(old, new):
        raise OSError(f"could not move {staged} to {target}")


def purge(spark: SparkSession, folder: str) -> None:
    """Drop one partition folder of a catalogue table."""
    target, fs = _file_system(spark, folder)
    if fs.exists(target):
        fs.delete(target, True)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def write_plan_csv(actions: DataFrame, path: str) -> None:
    actions.write.mode("overwrite").option("header", True).option("quote", '"').option(
        "escape", '"'
    ).csv(path)


def write_plan_json(actions: DataFrame, path: str) -> None:
    actions.write.mode("overwrite").json(path)


def write_duplicate_report(report: DataFrame, path: str) -> None:
    """Exact-duplicate rows as JSON lines: duplicates with their group's canonical and totals."""
    duplicates = report.filter("role <> 'canonical'").select(
        "source_id",
        "key",
        F.struct(
            F.col("canonical_id").alias("asset_id"), F.col("canonical_name").alias("name")
        ).alias("canonical"),
        F.struct("asset_id", "name", "rel_path", "size", "usage_count").alias("duplicate"),
        "group_size",
        "per_file_size",
        "reclaimable_bytes",
    )
    duplicates.write.mode("overwrite").json(path)
