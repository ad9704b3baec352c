"""Catalogue listings, reports and roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .clusters import cluster_heads
from .usages import unused_assets, with_usage_count

SORTS = {
    "name-asc": [F.asc, "name"],
    "name-desc": [F.desc, "name"],
    "size-asc": [F.asc, "size"],
    "size-desc": [F.desc, "size"],
    "mtime-asc": [F.asc, "mtime"],
    "mtime-desc": [F.desc, "mtime"],
}
LIST_COLUMNS = ["asset_id", "name", "ext", "size", "width", "height", "category"]


def sort_keys(sort: str) -> list[Column]:
    """Named grid order; every order ends in the id, so paging is stable."""
    direction, column = SORTS[sort]
    keys = [direction(column)]
    if column != "name":
        keys.append(F.asc("name"))
    return [*keys, F.asc("asset_id")]


def in_folder(folder: str | None) -> Column:
    """The folder itself and everything below it."""
    if not folder:
        return F.lit(True)
    return (F.col("dir") == folder) | F.col("dir").startswith(folder + "/")


def list_by_folder(assets: DataFrame, folder: str, sort: str = "name-asc", limit: int | None = None):
    listed = assets.filter(F.col("dir") == folder).orderBy(*sort_keys(sort))
    return listed if limit is None else listed.limit(limit)


def list_by_source(assets: DataFrame, limit: int | None = None) -> DataFrame:
    listed = assets.orderBy("dir", "name", "asset_id")
    return listed if limit is None else listed.limit(limit)


def asset_totals(assets: DataFrame) -> DataFrame:
    return assets.groupBy("source_id").agg(
        F.count("*").alias("assets"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )


def folder_distribution(assets: DataFrame) -> DataFrame:
    return assets.groupBy("source_id", "dir").agg(F.count("*").alias("n"))


def folder_tree(assets: DataFrame) -> DataFrame:
    """Assets below every folder, the root included, from the per-folder counts."""
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    direct = folder_distribution(assets).withColumn("parts", parts)
    paths = F.transform(
        F.sequence(F.lit(0), F.size("parts")),
        lambda i: F.array_join(F.slice("parts", F.lit(1), i), "/"),
    )
    return (
        direct.select("source_id", "n", F.explode(paths).alias("path"))
        .groupBy("source_id", "path")
        .agg(F.sum("n").alias("n"))
        .withColumn("depth", F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/"))))
    )


def leaf_suggestions(assets: DataFrame, folder: str = "", limit: int = 12) -> DataFrame:
    """Folders below ``folder`` that hold assets directly, fullest first."""
    below = folder_distribution(assets).filter(in_folder(folder) & (F.col("dir") != folder))
    return below.orderBy(F.desc("n"), "dir").limit(limit)


def top_asset_dirs(assets: DataFrame, k: int = 3) -> DataFrame:
    """The k fullest folders; the root folder takes a place but is not listed."""
    order = Window.partitionBy("source_id").orderBy(F.desc("n"), "dir")
    ranked = folder_distribution(assets).withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= k) & (F.col("dir") != ""))


def extensions(assets: DataFrame) -> DataFrame:
    ext = F.regexp_replace(F.lower("ext"), r"^\.", "")
    return assets.select("source_id", ext.alias("ext")).filter("ext <> ''").distinct()


def variant_flags(assets: DataFrame) -> DataFrame:
    """Does a source hold T-shirt or pixel size variants? Both flags from one pass."""
    stem, folder = F.lower("stem"), F.lower("dir")

    def ends(words: str) -> Column:
        return reduce(lambda a, b: a | b, [stem.endswith(f"-{w}") for w in words.split()])

    def holds(words: str) -> Column:
        return reduce(lambda a, b: a | b, [folder.contains(w) for w in words.split()])

    tshirt = ends("sm md lg xl xxl small medium large") | holds("small medium large")
    pixel = ends("16 20 24 32 48 64") | holds("/16 /24 /32 /48 /64")
    return assets.groupBy("source_id").agg(
        F.max(tshirt).alias("has_tshirt_variants"), F.max(pixel).alias("has_pixel_variants")
    )


def embed_health(assets: DataFrame, limit: float = 0.2) -> DataFrame:
    status = F.col("embed_status")
    counts = assets.groupBy("source_id").agg(
        *[F.count_if(status == s).alias(s) for s in ("ok", "failed", "degenerate")]
    )
    total = F.col("ok") + F.col("failed") + F.col("degenerate")
    return counts.withColumn(
        "degraded", (total > 0) & (F.col("failed") > total * F.lit(limit))
    )


def overview(assets: DataFrame, usages: DataFrame, clusters: DataFrame) -> DataFrame:
    """Counts of one source per row. The parts are summed by key, never cross-joined."""
    sizes = assets.select("source_id", F.col("asset_id").alias("canonical_id"), F.col("size").alias("bytes"))
    heads = cluster_heads(clusters)
    reclaim = (
        heads.filter("kind = 'hash'")
        .join(sizes, ["source_id", "canonical_id"])
        .groupBy("source_id")
        .agg(F.sum((F.col("size") - 1) * F.col("bytes")).alias("reclaimable_bytes"))
    )
    groups = heads.groupBy("source_id").agg(
        F.count_if(F.col("kind") == "hash").alias("duplicate_groups"),
        F.count_if(F.col("kind") == "phash").alias("near_clusters"),
        F.count_if(F.col("kind") == "name").alias("name_clusters"),
    )
    totals = assets.groupBy("source_id").agg(
        F.count("*").alias("total_assets"),
        F.sum("size").alias("total_bytes"),
        F.count_distinct("ext").alias("extensions"),
    )
    unused = unused_assets(assets, usages).groupBy("source_id").agg(
        F.count("*").alias("unused_assets"), F.sum("size").alias("unused_bytes")
    )
    parts = [totals, groups, reclaim, unused]
    names = [c for part in parts for c in part.columns if c != "source_id"]
    padded = [
        part.select(
            "source_id",
            *[(F.col(c) if c in part.columns else F.lit(0)).cast("long").alias(c) for c in names],
        )
        for part in parts
    ]
    return (
        reduce(DataFrame.unionByName, padded)
        .groupBy("source_id")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    )


def clusters_touching(members: DataFrame, assets: DataFrame, folder: str | None) -> DataFrame:
    """Whole clusters with at least one member under the folder."""
    if not folder:
        return members
    inside = assets.filter(in_folder(folder)).select("asset_id")
    keys = members.join(inside, "asset_id", "left_semi").select("source_id", "kind", "key").distinct()
    return members.join(keys, ["source_id", "kind", "key"], "left_semi")


def _member_details(members: DataFrame, assets: DataFrame, usages: DataFrame, columns) -> DataFrame:
    details = assets.select("asset_id", *columns)
    return with_usage_count(members.join(details, "asset_id"), usages)


def exact_duplicates(
    members: DataFrame, assets: DataFrame, usages: DataFrame, folder: str | None = None
) -> DataFrame:
    """Member rows of every byte-identical group with the group's size and reclaimable bytes."""
    hashes = clusters_touching(members.filter("kind = 'hash'"), assets, folder)
    rows = _member_details(
        hashes.withColumnRenamed("size", "group_size"), assets, usages, ["name", "rel_path", "ext", "size"]
    )
    heads = rows.filter("role = 'canonical'").select(
        "source_id",
        "key",
        F.col("asset_id").alias("canonical_id"),
        F.col("name").alias("canonical_name"),
        F.col("ext").alias("canonical_ext"),
        F.col("size").alias("per_file_size"),
        (F.col("size") * (F.col("group_size") - 1)).alias("reclaimable_bytes"),
    )
    return rows.join(heads, ["source_id", "key"]).drop("kind", "hamming", "ext")


def exact_duplicate_order() -> list[Column]:
    """Biggest group first; inside a group ``member`` sorts before ``canonical``."""
    return [F.desc("group_size"), F.asc("key"), F.desc("role"), F.asc("rel_path")]


def exact_duplicate_totals(report: DataFrame) -> DataFrame:
    heads = report.filter("role = 'canonical'")
    return heads.groupBy("source_id").agg(
        F.count("*").alias("total_groups"),
        F.sum("group_size").alias("total_files"),
        F.sum("reclaimable_bytes").alias("reclaimable_bytes"),
    )


def near_pair_report(
    pairs: DataFrame, assets: DataFrame, usages: DataFrame
) -> DataFrame:
    """Near pairs with both sides' details; the smallest distance comes first when ordered."""
    counted = with_usage_count(assets, usages)

    def side(prefix: str) -> DataFrame:
        cols = ["name", "rel_path", "ext", "size", "width", "height", "usage_count"]
        return counted.select(
            F.col("asset_id").alias(f"{prefix}_id"),
            *[F.col(c).alias(f"{prefix}_{c}") for c in cols],
        )

    return pairs.join(side("a"), "a_id").join(side("b"), "b_id")


def name_groups_page(
    members: DataFrame,
    assets: DataFrame,
    usages: DataFrame,
    sort: str = "size",
    limit: int = 50,
    offset: int = 0,
    folder: str | None = None,
) -> DataFrame:
    """Members of one page of name groups. Only the page's keys are ordered globally."""
    names = clusters_touching(members.filter("kind = 'name'"), assets, folder)
    heads = cluster_heads(names).select("source_id", "key", "size")
    order = [F.asc("key")] if sort == "alpha" else [F.desc("size"), F.asc("key")]
    page = heads.orderBy(*order, "source_id").offset(offset).limit(limit)
    rows = names.join(page.select("source_id", "key"), ["source_id", "key"], "left_semi")
    return _member_details(
        rows.withColumnRenamed("size", "group_size"),
        assets,
        usages,
        ["name", "stem", "rel_path", "ext", "size", "width", "height", "mtime"],
    ).drop("hamming")


def name_group_totals(
    members: DataFrame, assets: DataFrame, folder: str | None = None
) -> DataFrame:
    names = clusters_touching(members.filter("kind = 'name'"), assets, folder)
    return names.groupBy("source_id").agg(
        F.count_if(F.col("role") == "canonical").alias("total"),
        F.count("*").alias("total_variants"),
    )


def asset_refs(assets: DataFrame, usages: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested ids (asset_id, pos) with reference counts, in request order."""
    rows = wanted.join(assets.select("asset_id", "rel_path", "name", "size"), "asset_id")
    return with_usage_count(rows, usages).orderBy("pos")


def usage_page(usages: DataFrame, asset_id: int, after: int | None, limit: int) -> DataFrame:
    """Keyset page of one asset's references."""
    rows = usages.filter(F.col("asset_id") == asset_id)
    if after is not None:
        rows = rows.filter(F.col("id") > after)
    return rows.orderBy("id").limit(limit)


def ambiguous_names(assets: DataFrame) -> DataFrame:
    """Assets whose file name another asset has too."""
    names = assets.groupBy("name").agg(F.count("*").alias("holders")).filter("holders > 1")
    return assets.join(names, "name")


def kind_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_id", "kind").agg(F.count("*").alias("n"))


def sample_evenly(rows: DataFrame, order: list[str], n: int, parts: int = 256) -> DataFrame:
    """Every (len / n)-th row in ``order``; all rows when there are at most n.

    Positions come from range-partitioned chunks: each chunk is numbered on its own and shifted by
    the rows before it, so no single task sees the whole table.
    """
    numbered = global_positions(rows, order, parts)
    total = rows.agg(F.count("*").alias("total"))
    with_total = numbered.withColumn("total", total.scalar())
    picks = F.ceil(F.col("pos") * n / F.col("total"))
    hit = F.floor(picks * F.col("total") / n) == F.col("pos")
    return with_total.filter((F.col("total") <= n) | (hit & (picks < n))).drop("total")


def global_positions(rows: DataFrame, order: list[str], parts: int = 256) -> DataFrame:
    """0-based position of every row in a total order, without a one-partition window."""
    chunked = cut(
        rows.repartitionByRange(parts, *order).withColumn("chunk", F.spark_partition_id())
    )
    counts = chunked.groupBy("chunk").agg(F.count("*").alias("rows_in_chunk"))
    before = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "chunk", F.coalesce(F.sum("rows_in_chunk").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("chunk").orderBy(*order)
    return (
        chunked.withColumn("local", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "chunk")
        .withColumn("pos", F.col("start") + F.col("local"))
        .drop("chunk", "start", "local")
    )


