"""Duplicate and near-miss clusters as header-free member tables.

Every function returns one row per member with its cluster's size, so a cluster holding a third of
all assets is still just rows, never one collected list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import NEAR_MISS, ciede2000, is_neutral
from ..functions.fingerprint import SVG_NEAR_MAX, is_degenerate_bits, phash_bits
from ..functions.names import canonical_stem
from ..functions.typography import first_family
from ..session import cut
from .graph import connected_components, distance_to, greedy_star, medoid
from .simjoin import delta_e_pairs, hamming_links, range_pairs

MEMBER_COLUMNS = ["source_id", "kind", "key", "size", "asset_id", "role", "hamming"]


def _grouped(assets: DataFrame, key: Column, kind: str, best_by: Column) -> DataFrame:
    keyed = assets.select("source_id", "asset_id", key.alias("key"), best_by.alias("best"))
    heads = (
        keyed.groupBy("source_id", "key")
        .agg(F.count("*").alias("size"), F.min_by("asset_id", "best").alias("canonical_id"))
        .filter(F.col("size") >= 2)
    )
    return keyed.join(heads, ["source_id", "key"]).select(
        "source_id",
        F.lit(kind).alias("kind"),
        "key",
        "size",
        "asset_id",
        F.when(F.col("asset_id") == F.col("canonical_id"), "canonical")
        .otherwise("member")
        .alias("role"),
        F.lit(None).cast("int").alias("hamming"),
    )


def hash_clusters(assets: DataFrame) -> DataFrame:
    """Byte-identical assets; the canonical copy has the first path."""
    return _grouped(assets, F.col("content_hash"), "hash", F.struct("rel_path", "asset_id"))


def name_clusters(assets: DataFrame) -> DataFrame:
    """Assets with one canonical stem; the shortest, then first, stem is canonical."""
    order = F.struct(F.length("stem"), F.col("stem"), F.col("asset_id"))
    return _grouped(assets, canonical_stem(F.col("stem")), "name", order)


def phash_nodes(assets: DataFrame) -> DataFrame:
    """Distinct usable fingerprints per (source, ext): lowest asset id and number of copies."""
    return (
        assets.filter(F.length("phash") == 16)
        .withColumn("bits", phash_bits(F.col("phash")))
        .filter(~is_degenerate_bits(F.col("bits")))
        .groupBy("source_id", "ext", "bits")
        .agg(F.min("asset_id").alias("node"), F.count("*").alias("n"))
    )


def phash_edges(nodes: DataFrame, threshold: int, bands: int | None = None) -> DataFrame:
    """Fingerprints close enough to link, pairs that connect all others left out; SVGs use the tighter
    of the two limits."""
    block = ["source_id", "ext"]
    raster = hamming_links(nodes.filter("ext <> 'svg'"), threshold, block, bands)
    tight = min(threshold, SVG_NEAR_MAX)
    vector = hamming_links(nodes.filter("ext = 'svg'"), tight, block)
    return raster.unionByName(vector)


def phash_clusters(assets: DataFrame, threshold: int = 12, bands: int | None = None) -> DataFrame:
    """Perceptual clusters: linked fingerprints, medoid as canonical, distance to it per member.

    Copies of one fingerprint are a single weighted node until the very last join.
    """
    nodes = cut(phash_nodes(assets))
    pairs = phash_edges(nodes, threshold, bands)
    ids = nodes.select("source_id", "ext", "bits", "node")
    edges = (
        pairs.join(
            ids.withColumnsRenamed({"bits": "bits_a", "node": "u"}), ["source_id", "ext", "bits_a"]
        )
        .join(
            ids.withColumnsRenamed({"bits": "bits_b", "node": "v"}), ["source_id", "ext", "bits_b"]
        )
        .select("u", "v")
    )
    labels = connected_components(edges)
    grouped = nodes.join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    centres = medoid(grouped, ["source_id", "component"]).filter(F.col("size") >= 2)
    placed = grouped.join(centres, ["source_id", "component"]).select(
        "source_id",
        "ext",
        "bits",
        F.concat(F.lit("phash-"), F.col("component")).alias("key"),
        "size",
        "medoid",
        distance_to(F.col("bits"), F.col("medoid_bits")).alias("hamming"),
    )
    members = assets.filter(F.length("phash") == 16).select(
        "source_id", "ext", "asset_id", phash_bits(F.col("phash")).alias("bits")
    )
    return members.join(placed, ["source_id", "ext", "bits"]).select(
        "source_id",
        F.lit("phash").alias("kind"),
        "key",
        "size",
        "asset_id",
        F.when(F.col("asset_id") == F.col("medoid"), "canonical").otherwise("member").alias("role"),
        "hamming",
    )


def all_clusters(assets: DataFrame, threshold: int = 12) -> DataFrame:
    return (
        hash_clusters(assets)
        .unionByName(name_clusters(assets))
        .unionByName(phash_clusters(assets, threshold))
    )


def cluster_heads(members: DataFrame) -> DataFrame:
    """One row per cluster with its canonical asset."""
    return (
        members.filter("role = 'canonical'")
        .withColumnRenamed("asset_id", "canonical_id")
        .drop("role", "hamming")
    )


STYLE_MEMBER_COLUMNS = [
    "source_id", "kind", "key", "canonical", "size", "neutral", "max_distance", "axis", "metric",
    "value", "role", "distance", "usage_count",
]


def _style_members(
    stars: DataFrame, counts: DataFrame, distance: Column, kind: str, axis: str | None, metric: str
) -> DataFrame:
    """Stars (source_id, anchor, variant) to member rows with size and largest distance."""
    pairs = (
        stars.join(
            counts.select("source_id", F.col("value").alias("anchor"), F.col("n").alias("anchor_n")),
            ["source_id", "anchor"],
        )
        .join(
            counts.select("source_id", F.col("value").alias("variant"), F.col("n").alias("variant_n")),
            ["source_id", "variant"],
        )
        .withColumn("distance", distance)
    )
    heads = pairs.groupBy("source_id", "anchor", "anchor_n").agg(
        (F.count("*") + 1).alias("size"), F.max("distance").alias("max_distance")
    )
    rows = pairs.select(
        "source_id",
        F.col("anchor"),
        F.col("variant").alias("value"),
        F.lit("variant").alias("role"),
        "distance",
        F.col("variant_n").alias("usage_count"),
    ).unionByName(
        heads.select(
            "source_id",
            F.col("anchor"),
            F.col("anchor").alias("value"),
            F.lit("canonical").alias("role"),
            F.lit(None).cast("double").alias("distance"),
            F.col("anchor_n").alias("usage_count"),
        )
    )
    head = heads.drop("anchor_n")
    return rows.join(head, ["source_id", "anchor"]).select(
        "source_id",
        F.lit(kind).alias("kind"),
        (F.concat(F.lit(f"{axis}:"), F.col("anchor")) if axis else F.col("anchor")).alias("key"),
        F.col("anchor").alias("canonical"),
        "size",
        (is_neutral("anchor") if kind == "color" else F.lit(None).cast("boolean")).alias("neutral"),
        "max_distance",
        F.lit(axis).cast("string").alias("axis"),
        F.lit(metric).alias("metric"),
        "value",
        "role",
        "distance",
        "usage_count",
    )


def color_counts(style_usages: DataFrame) -> DataFrame:
    return (
        style_usages.filter((F.col("kind") == "color") & F.col("normalized_value").isNotNull())
        .groupBy("source_id", F.col("normalized_value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def type_counts(style_usages: DataFrame) -> DataFrame:
    return (
        style_usages.filter((F.col("kind") == "type") & F.col("normalized_value").isNotNull())
        .groupBy("source_id", "axis", F.col("normalized_value").alias("value"))
        .agg(F.count("*").alias("n"))
    )


def color_clusters(counts: DataFrame, limit: float = NEAR_MISS) -> DataFrame:
    """Greedy near-miss clusters of (source_id, value, n) colours around the most used ones."""
    side = cut(counts.select("source_id", "value", "n"))
    pairs = delta_e_pairs(side.withColumnRenamed("value", "color"), ["source_id"], limit)
    both = pairs.join(
        side.withColumnsRenamed({"value": "color_a", "n": "n_a"}), ["source_id", "color_a"]
    ).join(side.withColumnsRenamed({"value": "color_b", "n": "n_b"}), ["source_id", "color_b"])
    first = (F.col("n_a") > F.col("n_b")) | (
        (F.col("n_a") == F.col("n_b")) & (F.col("color_a") < F.col("color_b"))
    )
    edges = both.select(
        "source_id",
        F.when(first, F.col("color_a")).otherwise(F.col("color_b")).alias("hi"),
        F.when(first, F.col("color_b")).otherwise(F.col("color_a")).alias("lo"),
        F.when(first, F.struct((-F.col("n_a")).alias("r"), F.col("color_a").alias("v")))
        .otherwise(F.struct((-F.col("n_b")).alias("r"), F.col("color_b").alias("v")))
        .alias("hi_rank"),
    )
    stars = greedy_star(edges, ["source_id"])
    return _style_members(stars, side, ciede2000("anchor", "variant"), "color", None, "deltaE")


def size_clusters(counts: DataFrame) -> DataFrame:
    """Font sizes under 1px from a strictly more used size."""
    sizes = cut(
        counts.filter("axis = 'size'")
        .withColumn("px", F.col("value").try_cast("double"))
        .filter(F.col("px").isNotNull())
        .select("source_id", "value", "n", "px")
    )
    edges = range_pairs(sizes, ["source_id"]).withColumn(
        "hi_rank", F.struct((-F.col("hi_n")).alias("r"), F.col("hi_px").alias("v"))
    )
    stars = greedy_star(edges, ["source_id"])
    gap = F.round(F.abs(F.col("variant").cast("double") - F.col("anchor").cast("double")), 3)
    return _style_members(stars, sizes, gap, "type", "size", "px")


def family_clusters(counts: DataFrame) -> DataFrame:
    """Font stacks that agree on the first family but not on the fallbacks."""
    stacks = counts.filter("axis = 'family'").withColumn("first", first_family(F.col("value")))
    heads = (
        stacks.groupBy("source_id", "first")
        .agg(
            F.count("*").alias("size"),
            F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("canonical"),
        )
        .filter(F.col("size") >= 2)
    )
    none = F.lit(None).cast("double")
    return stacks.join(heads, ["source_id", "first"]).select(
        "source_id",
        F.lit("type").alias("kind"),
        F.concat(F.lit("family:"), F.col("first")).alias("key"),
        "canonical",
        "size",
        F.lit(None).cast("boolean").alias("neutral"),
        none.alias("max_distance"),
        F.lit("family").alias("axis"),
        F.lit("stack").alias("metric"),
        "value",
        F.when(F.col("value") == F.col("canonical"), "canonical").otherwise("variant").alias("role"),
        none.alias("distance"),
        F.col("n").alias("usage_count"),
    )


def typography_clusters(counts: DataFrame) -> DataFrame:
    return size_clusters(counts).unionByName(family_clusters(counts))


def near_pairs(members: DataFrame) -> DataFrame:
    """Canonical asset of each perceptual cluster against each other member."""
    phash = members.filter("kind = 'phash'")
    heads = phash.filter("role = 'canonical'").select(
        "source_id", "key", F.col("asset_id").alias("a_id")
    )
    h = F.coalesce("hamming", F.lit(0))
    return (
        phash.filter("role <> 'canonical'")
        .join(heads, ["source_id", "key"])
        .select(
            "source_id",
            "key",
            "a_id",
            F.col("asset_id").alias("b_id"),
            h.alias("hamming"),
            F.when(h <= 4, "high").when(h <= 8, "medium").otherwise("low").alias("confidence"),
            F.when(h <= 4, "very").when(h <= 8, "similar").otherwise("loose").alias("bucket"),
        )
    )


def near_histogram(pairs: DataFrame, bins: int = 16) -> DataFrame:
    """Pairs per distance, everything from the last bin up counted together, empty bins kept."""
    counts = pairs.groupBy(F.least(F.col("hamming"), F.lit(bins - 1)).cast("long").alias("bin")).agg(
        F.count("*").alias("n"), F.max("hamming").alias("top")
    )
    axis = pairs.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return axis.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0)).alias("max_hamming")
    )


