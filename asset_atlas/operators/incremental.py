"""Keep stored catalogue tables up to date with a new scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

KEPT_ON_SAME_CONTENT = ["embedding", "embed_status", "white_fraction"]
NEVER_OVERWRITTEN = ["author"]


def diff(scanned: DataFrame, stored: DataFrame, full: bool = False) -> DataFrame:
    """State of every path: new, changed, same or gone. ``full`` treats kept files as changed."""
    left = scanned.select("abs_path", F.col("size").alias("new_size"), F.col("mtime").alias("new_mtime"))
    right = stored.select("abs_path", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    same = (F.col("new_size") == F.col("old_size")) & (F.col("new_mtime") == F.col("old_mtime"))
    state = (
        F.when(F.col("old_size").isNull(), "new")
        .when(F.col("new_size").isNull(), "gone")
        .when(same & F.lit(not full), "same")
        .otherwise("changed")
    )
    return left.join(right, "abs_path", "full_outer").select("abs_path", state.alias("state"))


def dense_ids(rows: DataFrame, key: str, start: Column) -> DataFrame:
    """Add ``asset_id``: start + 1, start + 2, ... in a fixed order, without a global window.

    Rows are numbered inside hash buckets; each bucket starts after the rows of the buckets before
    it. The result depends on the keys only, so a recomputed task assigns the same ids.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    spread = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(parts)))
    counts = spread.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("bucket").orderBy(key)
    return (
        spread.withColumn("local", F.row_number().over(inside))
        .join(F.broadcast(starts), "bucket")
        .withColumn("asset_id", start + F.col("skip") + F.col("local"))
        .drop("bucket", "skip", "local")
    )


def upsert(stored: DataFrame, incoming: DataFrame, top: Column | None = None) -> DataFrame:
    """Merge by path: ids stay, features are replaced, embeddings survive unchanged content only.

    A column the incoming side does not have keeps its stored value while the content is unchanged.
    Several rows for one path (a stream batch) are reduced to the latest by mtime first. New ids
    follow ``top``, the largest id of ``stored`` by default.
    """
    columns = stored.columns
    newest = (
        incoming.groupBy("abs_path")
        .agg(F.max_by(F.struct(*incoming.columns), F.struct("mtime", "size")).alias("row"))
        .select("row.*")
    )
    old = stored.select([F.col(c).alias(f"old_{c}") for c in columns])
    joined = newest.join(old, F.col("abs_path") == F.col("old_abs_path"), "full_outer")
    fresh = F.col("abs_path").isNotNull()
    unchanged = F.col("content_hash").eqNullSafe(F.col("old_content_hash"))

    def merged(c: str) -> Column:
        new = F.col(c) if c in incoming.columns else F.lit(None)
        was = F.col(f"old_{c}")
        if c == "asset_id" or c in NEVER_OVERWRITTEN:
            value = was if c == "asset_id" else F.coalesce(was, new)
        elif c in KEPT_ON_SAME_CONTENT or c not in incoming.columns:
            kept = F.when(unchanged, was)
            value = F.when(fresh & F.col("old_abs_path").isNotNull(), kept).otherwise(
                F.coalesce(was, new)
            )
        else:
            value = F.when(fresh, new).otherwise(was)
        return value.cast(stored.schema[c].dataType).alias(c)

    # read twice below, for known and for new paths
    rows = cut(joined.select(*[merged(c) for c in columns]))
    if top is None:
        top = stored.agg(F.coalesce(F.max("asset_id"), F.lit(0)).alias("m")).scalar()
    known = rows.filter(F.col("asset_id").isNotNull())
    added = dense_ids(rows.filter(F.col("asset_id").isNull()).drop("asset_id"), "abs_path", top)
    return known.unionByName(added.select(*columns))


def delete_missing(stored: DataFrame, scanned: DataFrame, source_id: int) -> DataFrame:
    """Drop rows of a source that the scan no longer sees; other sources are untouched."""
    own = stored.filter(F.col("source_id") == source_id)
    others = stored.filter(F.col("source_id") != source_id)
    return own.join(scanned.select("abs_path"), "abs_path", "left_semi").unionByName(others)


class VanishedSource(RuntimeError):
    """A listing so short that its missing rows are not taken for deleted files."""


def index_run(
    listing: DataFrame,
    stored: DataFrame,
    read_changed: Callable[[DataFrame], DataFrame],
    source_id: int,
    full: bool = False,
    most_gone: float = 1.0,
) -> tuple[DataFrame, DataFrame]:
    """One run over a source: (catalogue, report of (state, n)).

    ``listing`` holds metadata only (abs_path, size, mtime). Files it shares with ``stored`` at the
    same size and time are not read; ``read_changed`` gets the new and changed paths (abs_path,
    state) and returns their complete rows. Rows of files that are gone go, unless they are more
    than ``most_gone`` of the source, or the listing is empty: then nothing is touched.
    """
    own = stored.filter(F.col("source_id") == source_id)
    states = cut(diff(listing, own, full))
    report = states.groupBy("state").agg(F.count("*").alias("n"))
    seen = {r["state"]: r["n"] for r in report.collect()}
    gone, before = seen.get("gone", 0), sum(n for s, n in seen.items() if s != "new")
    if gone and (gone == sum(seen.values()) or gone > most_gone * before):
        raise VanishedSource(f"{gone} of {before} stored files of source {source_id} are not listed")
    top = stored.agg(F.coalesce(F.max("asset_id"), F.lit(0))).first()[0]
    changed = states.filter(F.col("state").isin("new", "changed")).select("abs_path", "state")
    left = own.join(states.filter("state <> 'gone'").select("abs_path"), "abs_path", "left_semi").select(stored.columns)
    merged = upsert(left, read_changed(changed), F.lit(top))
    return merged.unionByName(stored.filter(F.col("source_id") != source_id)), report


def require_root(spark: SparkSession, root: str) -> None:
    """A vanished root must stop the run before its rows are taken for deleted."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"source root does not exist: {root}")


def embedding_targets(assets: DataFrame, full: bool = False) -> DataFrame:
    """Assets that need an embedding: none yet, unknown state or failed before."""
    if full:
        return assets
    return assets.filter(
        F.col("embedding").isNull()
        | F.col("embed_status").isNull()
        | (F.col("embed_status") == "failed")
    )


def apply_renames(assets: DataFrame, renames: DataFrame) -> DataFrame:
    """Move renamed assets (asset_id, new_name) to their new name and paths."""
    joined = assets.join(renames.select("asset_id", "new_name"), "asset_id", "left")
    moved = F.col("new_name").isNotNull()
    folder = F.when(F.col("dir") == "", F.lit("")).otherwise(F.concat("dir", F.lit("/")))
    abs_folder = F.regexp_replace("abs_path", r"[^/]*$", "")
    suffix = F.length("ext") + 1
    new_stem = F.when(
        F.lower("new_name").endswith(F.concat(F.lit("."), F.lower("ext"))),
        F.substring(F.col("new_name"), F.lit(1), F.length("new_name") - suffix),
    ).otherwise(F.col("new_name"))
    updates = {
        "name": F.col("new_name"),
        "stem": new_stem,
        "rel_path": F.concat(folder, F.col("new_name")),
        "abs_path": F.concat(abs_folder, F.col("new_name")),
    }
    changed = [
        F.when(moved, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in assets.columns
    ]
    return joined.select(*changed)


def failure_summary(failures: DataFrame, k: int = 3) -> DataFrame:
    """Most frequent failure reasons."""
    return (
        failures.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(k)
    )


def stage_metrics(stages: DataFrame) -> DataFrame:
    """Stage records (run_id, stage, ms, detail) with failed stages flagged."""
    return stages.withColumn("failed", F.col("detail").startswith("FAILED:"))
