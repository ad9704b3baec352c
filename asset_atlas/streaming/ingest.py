"""Continuous indexing with Structured Streaming."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.fingerprint import content_hash, svg_stats
from ..functions.names import category, is_image_name
from ..operators.incremental import upsert
from ..schemas import ASSETS
from ..session import cut, drop_folder
from ..sources.files import DECODABLE, DEFAULT_IGNORE, RASTER, raster_features, view_size, with_path_parts
from ..sources.sinks import read_table

MAX_FILES = 1000
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_assets(spark: SparkSession, root: str, source_id: int) -> DataFrame:
    """New image files under ``root`` as catalogue rows without ids."""
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", MAX_FILES)
        .load(root)
        .filter(is_image_name(F.col("path")))
    )
    parts = with_path_parts(files, root, source_id, DEFAULT_IGNORE)
    stats = F.when(F.col("ext") == "svg", svg_stats(F.decode("content", "UTF-8")))
    return (
        parts.withColumn("content_hash", content_hash(F.col("content")))
        .withColumn("sha1", F.sha1("content"))
        .withColumn("s", stats)
        .select(
            "source_id", "abs_path", "rel_path", "dir", "name", "stem", "ext",
            F.col("length").alias("size"),
            F.unix_millis("modificationTime").alias("mtime"),
            "content_hash", "sha1", "s.*", "path",
            *view_size(F.col("s.view_box")),
        )
    )


def with_features(batch: DataFrame) -> DataFrame:
    """Decode the raster files of one micro-batch and complete its rows.

    The stream names the files of a batch on the driver anyway, at most ``MAX_FILES`` of them, so
    the image reader is given just these.
    """
    spark = batch.sparkSession
    if "path" not in batch.columns:
        return batch
    decodable = F.lower("ext").isin(DECODABLE)
    paths = [r["path"] for r in batch.filter(decodable).select("path").collect()]
    if paths:
        images = spark.read.format("image").option("dropInvalid", False).load(paths)
        batch = batch.join(raster_features(images), "abs_path", "left")
    else:
        batch = batch.withColumns({n: F.lit(None).cast(t) for n, t in RASTER.items()})
    size = {c: F.coalesce(c, f"svg_{c}") for c in ("width", "height")}
    batch = batch.withColumns(size).drop("path", "svg_width", "svg_height")
    return batch.withColumn("category", category(F.col("ext"), F.col("width"), F.col("height")))


def write_batch(batch: DataFrame, batch_id: int, table: str) -> None:
    """Store one micro-batch under its own number; a replayed batch overwrites itself.

    Ingest cost follows the batch. The catalogue itself is only touched by ``compact``.
    """
    with_features(batch).write.mode("overwrite").parquet(f"{table}/log/batch={batch_id}")


def start_ingest(
    spark: SparkSession, root: str, source_id: int, table: str, checkpoint: str
) -> StreamingQuery:
    """Log the files present now and stop; restart it to pick up more."""
    return (
        arriving_assets(spark, root, source_id)
        .writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, table: str) -> int:
    """Fold the logged batches into the catalogue; returns how many rows they held.

    Only the partitions of the sources they touch are replaced. The batches are deleted afterwards;
    folding one again, after a crash in between, changes nothing.
    """
    try:
        log = spark.read.option("mergeSchema", True).parquet(f"{table}/log")
    except AnalysisException:
        return 0
    fresh = cut(log)
    batches = [r["batch"] for r in fresh.select("batch").distinct().collect()]
    if not batches:
        return 0
    stored = read_assets(spark, table)
    top = stored.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
    mine = stored.join(fresh.select("source_id").distinct(), "source_id", "left_semi").select(stored.columns)
    merged = cut(upsert(mine, fresh.drop("batch"), F.lit(top)))
    (
        merged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("source_id")
        .parquet(f"{table}/rows")
    )
    for batch in batches:
        drop_folder(spark, f"{table}/log/batch={batch}")
    return fresh.count()


def read_assets(spark: SparkSession, table: str) -> DataFrame:
    """The catalogue as of the last ``compact``."""
    return read_table(spark, f"{table}/rows", ASSETS)


def duplicate_alerts(arriving: DataFrame, assets: DataFrame) -> DataFrame:
    """Arriving files whose content the catalogue already holds, as a stream-static join.

    The static side is one row per content, so a much-copied file raises one alert.
    """
    known = (
        assets.groupBy("content_hash")
        .agg(
            F.min_by("rel_path", F.struct("rel_path", "asset_id")).alias("first_path"),
            F.count("*").alias("copies"),
        )
    )
    return arriving.join(known, "content_hash").select(
        "abs_path", "content_hash", "first_path", "copies"
    )



def arrival_counts(arriving: DataFrame, delay: str | None = None) -> DataFrame:
    """Per content of the stream so far its first path and number of files; a stateful aggregate.

    A file that arrives twice, under one path, counts twice only if its ``arrived`` differs. With a
    ``delay``, contents not seen for that long are forgotten, so the state stays bounded; the same
    content is then a new one when it comes back.
    """
    if delay is not None:
        arriving = arriving.withWatermark("arrived", delay)
        once = arriving.dropDuplicatesWithinWatermark(["abs_path", "content_hash"])
        keys = ["content_hash", F.session_window("arrived", delay).alias("seen")]
    else:
        once, keys = arriving.dropDuplicates(["abs_path", "content_hash"]), ["content_hash"]
    return once.groupBy(*keys).agg(
        F.min_by("abs_path", F.struct("arrived", "abs_path")).alias("first_path"), F.count("*").alias("files")
    )


def start_arrival_alerts(
    arriving: DataFrame, assets: DataFrame, out: str, checkpoint: str, delay: str | None = None
) -> StreamingQuery:
    """Alerts of each batch under its own number: contents that the stream has brought more than once, or
    that the catalogue holds. A later batch repeats a content with its new count."""
    known = assets.groupBy("content_hash").agg(
        F.min_by("rel_path", F.struct("rel_path", "asset_id")).alias("known_path"), F.count("*").alias("copies"))

    def write(batch: DataFrame, number: int) -> None:
        held = batch.join(known, "content_hash", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
        alerts = held.filter((F.col("files") > 1) | (F.col("copies") > 0))
        alerts.select("content_hash", "first_path", "files", "known_path", "copies").write.mode("overwrite").parquet(
            f"{out}/batch={number}")

    # a session window can only be completed, not updated
    mode = "append" if delay is not None else "update"
    return (
        arrival_counts(arriving, delay)
        .writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_alerts(spark: SparkSession, out: str) -> DataFrame:
    """The last alert of each content."""
    rows = spark.read.parquet(out)
    newest = F.max_by(F.struct("first_path", "files", "known_path", "copies"), "batch")
    return rows.groupBy("content_hash").agg(newest.alias("a")).select("content_hash", "a.*")
