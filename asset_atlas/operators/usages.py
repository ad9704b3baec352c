"""References to image files in code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.comments import commented_at, syntax
from .simjoin import unsent
from .text import code_lines, in_size, regex_hits, snippet

FILE_NAME = r"(?i)[A-Za-z0-9_.-]+\.(?:svg|png|jpe?g|webp|gif)(?![A-Za-z0-9_])"
#: in every line with a file name, and cheaper to look for
FILE_ENDING = r"(?i)\.(?:svg|png|jpe?g|webp|gif)"


def reference_hits(files: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Every image file name in ``files`` with line, column and comment flag. No shuffle.

    Files over ``max_chars`` are left out when it is given; ``text.left_out`` lists them.
    """
    lines = code_lines(files.filter(in_size(max_chars)), keep=FILE_ENDING, offsets=False)
    hits = lines.withColumn("hit", F.explode(regex_hits("line", FILE_NAME)))
    return hits.select(
        "source_id",
        "rel_path",
        "abs_path",
        F.col("hit.tok").alias("name"),
        F.col("line_no").alias("line"),
        F.col("hit.col").alias("col"),
        snippet(F.col("line")).alias("snippet"),
        commented_at(
            F.col("line"),
            F.col("hit.col"),
            syntax(F.lower("ext")),
            F.col("in_js"),
            F.col("in_html"),
        ).alias("commented"),
    )


def scan_usages(files: DataFrame, assets: DataFrame, cap: int | None = None,
                max_chars: int | None = None) -> DataFrame:
    """One row per (reference, asset with that exact file name), all of them unless ``cap`` is given.

    Only hits of names some asset has are kept. All assets that share a name receive the same hits
    in the same order, so a cap is applied per name before the join. Both sides are shuffled by name:
    neither is held whole in the driver, and of a name only its assets are held in a task.
    """
    hits = reference_hits(files, max_chars)
    if cap is not None:
        names = assets.select("source_id", "name").distinct()
        hits = hits.join(unsent(names), ["source_id", "name"], "left_semi")
        order = Window.partitionBy("source_id", "name").orderBy("abs_path", "line", "col")
        hits = hits.withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= cap).drop("seq")
    return hits.join(unsent(assets.select("source_id", "name", "asset_id")), ["source_id", "name"]).select(
        "asset_id", "source_id", "rel_path", "abs_path", "line", "col", "snippet", "commented"
    )


def usage_counts(usages: DataFrame) -> DataFrame:
    return usages.groupBy("asset_id").agg(F.count("*").alias("usage_count"))


def with_usage_count(assets: DataFrame, usages: DataFrame) -> DataFrame:
    """Zero-filled reference count per asset."""
    return assets.join(usage_counts(usages), "asset_id", "left").withColumn(
        "usage_count", F.coalesce("usage_count", F.lit(0))
    )


def unused_assets(assets: DataFrame, usages: DataFrame) -> DataFrame:
    return assets.join(usages.select("asset_id"), "asset_id", "left_anti")


def backfill_abs_path(usages: DataFrame, sources: DataFrame) -> DataFrame:
    """Fill empty absolute paths of old rows from the source root; keep already absolute ones."""
    roots = sources.select(F.col("id").alias("source_id"), "root")
    rooted = F.when(F.col("rel_path").startswith("/"), F.col("rel_path")).otherwise(
        F.concat_ws("/", "root", "rel_path")
    )
    return (
        usages.join(roots, "source_id", "left")
        .withColumn(
            "abs_path",
            F.when(F.coalesce("abs_path", F.lit("")) == "", rooted).otherwise(F.col("abs_path")),
        )
        .drop("root")
    )
