"""Session helpers shared by every operator that needs lineage cuts or written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "asset-atlas", cores: str = "*", shuffle_partitions: int = 8,
                  **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster job brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        # one partition per core already; merging small ones would leave cores idle
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors reach: the one the cluster names, else one beside the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """Fresh path for a written intermediate table."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    writer = df.write
    if partition:
        writer = writer.partitionBy(*partition)
    # the written table replaces the shuffles behind it, so their files go with the write
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    back = spark.read.schema(df.schema).parquet(folder)
    back._stored_at = folder
    return back


def discard(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing will read it again."""
    drop_folder(df.sparkSession, df._stored_at)


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Lineage cut that is evaluated once: a table in the shared folder, safe from lost executors."""
    return stored(df, "cut")
