"""Everything around one asset, computed for a whole table of subject assets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fingerprint import phash_bits
from ..functions.names import name_tokens, pixel_size_from_path, pixel_suffix
from ..session import cut
from .match import first_per, most_taken
from .nearest import block_hash, nearest
from .simjoin import bands_or_none, block_rows, by_growing_radius, growing_radii, hamming_query_join, unsent

NEAR_SVG, NEAR_RASTER, NEAR_LIMIT = 6, 10, 20
FAMILY_SVG, FAMILY_RASTER, FAMILY_LIMIT = 16, 20, 15
SIBLING_MIN = 0.2


def near_duplicates(
    subjects: DataFrame,
    assets: DataFrame,
    svg: int = NEAR_SVG,
    raster: int = NEAR_RASTER,
    k: int = NEAR_LIMIT,
    bands: int | None = None,
    radii: list[int] | None = None,
) -> DataFrame:
    """Closest same-type assets of each subject; flat fingerprints are compared too. Subjects that a
    small radius fills are not searched further. At a radius where bands leave most pairs as candidates
    all pairs of a type are compared, and a subject keeps its best as they are met."""
    block = ["source_id", "ext"]

    def nodes(df: DataFrame) -> DataFrame:
        return df.filter(F.length("phash") == 16).select(
            "asset_id", *block, phash_bits(F.col("phash")).alias("bits")
        )

    probe, pool = cut(nodes(subjects)), cut(nodes(assets))
    copies = cut(first_per(pool, [*block, "bits"], k + 1).drop("rank"))
    most = block_rows(pool, block)[0]
    vector = F.col("ext") == "svg"
    group = block_hash(block).alias("group")

    def hits_at(asked: DataFrame, radius: int) -> DataFrame:
        if bands is None and bands_or_none(radius, most) is None:
            reach = F.when(vector, min(radius, svg)).otherwise(min(radius, raster)).alias("reach")
            subjects = asked.select(F.col("asset_id").alias("subject_id"), "bits", group, reach).filter("subject_id is not null")
            others = copies.filter("asset_id is not null").select("asset_id", "bits", group)
            return nearest(subjects, others, k, others=True).select("subject_id", "asset_id", "hamming")
        pairs = hamming_query_join(
            asked.filter(vector), pool.filter(vector), min(radius, svg), block
        ).unionByName(
            hamming_query_join(asked.filter(~vector), pool.filter(~vector), min(radius, raster), block, bands)
        )
        return (
            asked.withColumnsRenamed({"bits": "bits_a", "asset_id": "subject_id"})
            .join(unsent(pairs), [*block, "bits_a"])
            .join(unsent(copies.withColumnRenamed("bits", "bits_b")), [*block, "bits_b"])
            .filter("subject_id <> asset_id")
            .select("subject_id", "asset_id", "hamming")
        )

    def found(asked: DataFrame, radius: int) -> DataFrame:
        return hits_at(asked.withColumnRenamed("subject_id", "asset_id"), radius)

    radii = radii or growing_radii(max(svg, raster), most)
    hits = by_growing_radius(probe.withColumnRenamed("asset_id", "subject_id"), "subject_id", k, radii, found)
    return first_per(hits, ["subject_id"], k, "hamming", "asset_id")


def name_siblings(
    subjects: DataFrame,
    assets: DataFrame,
    near: DataFrame,
    svg: int = FAMILY_SVG,
    raster: int = FAMILY_RASTER,
    k: int = FAMILY_LIMIT,
    radii: list[int] | None = None,
) -> DataFrame:
    """Same name family and similar look, without near duplicates and byte-identical copies.

    Assets that agree on tokens, fingerprint and content are interchangeable here, so each such
    group offers only as many rows as could be listed. Token sets and fingerprints are compared
    together, a share of the subjects with a share of the assets at a time, and a subject keeps its
    best as they are met: a row for each of its like-named sets or assets is never made.
    """

    def rows(df: DataFrame) -> DataFrame:
        words = name_tokens(F.col("stem"))
        named = df.filter(F.length("phash") == 16).select(
            "source_id", "asset_id", "ext", "content_hash", phash_bits(F.col("phash")).alias("bits"),
            words.alias("raw"), F.sort_array(words).alias("tokens"),
        )
        # words of another source are other words
        return named.filter((F.size("tokens") > 0) & F.col("source_id").isNotNull() & F.col("asset_id").isNotNull()).withColumns({
            "content": F.xxhash64("content_hash"),
            "words": F.transform("tokens", lambda t: F.xxhash64(F.col("source_id"), t)),
        })

    near = cut(near.select("subject_id", "asset_id"))
    probe = cut(rows(subjects).withColumn("group", F.xxhash64("source_id", "raw")))
    pool = cut(rows(assets).withColumn("group", F.xxhash64("source_id", "tokens")))
    alike = ["source_id", "tokens", "bits", "content_hash"]
    # what the near list of one subject takes out of one group, and the subject itself
    most = most_taken(pool, near, alike, "subject_id").agg(F.coalesce(F.max("taken"), F.lit(0))).first()[0]
    few = cut(first_per(pool, alike, k + 1 + most).drop("rank", "raw", "ext"))
    reach = F.when(F.col("ext") == "svg", svg).otherwise(raster)
    asked = probe.select(F.col("asset_id").alias("subject_id"), "bits", "group", "content", "words", reach.alias("reach"))
    raws = probe.select(F.col("group").alias("group_a"), "raw").distinct()
    sets = few.select(F.col("group").alias("group_b"), "tokens").distinct()

    def hits_at(asked: DataFrame, radius: int) -> DataFrame:
        asked = asked.withColumn("reach", F.least("reach", F.lit(radius)))
        met = nearest(asked, few, k, near, SIBLING_MIN, others=True, own_content=True)
        return met.join(unsent(raws), "group_a").join(unsent(sets), "group_b").select(
            "subject_id", "asset_id", "score", "hamming", F.array_intersect("raw", "tokens").alias("shared_tokens")
        )

    hits = by_growing_radius(asked, "subject_id", k, radii or [max(svg, raster)], hits_at)
    return first_per(hits, ["subject_id"], k, "hamming", F.desc("score"), "asset_id")


def memberships(subjects: DataFrame, members: DataFrame, assets: DataFrame) -> DataFrame:
    """Name and hash clusters of the subjects, each listed once: a row per member, with ``subject``
    marking those that were asked for.

    The listing of a subject is all rows of its clusters, so the output grows with the members and
    not with their square.
    """
    key = ["source_id", "kind", "key"]
    asked = subjects.select("asset_id").distinct().withColumn("subject", F.lit(True))
    plain = members.filter("kind <> 'phash'").join(asked, "asset_id", "left").withColumn(
        "subject", F.coalesce("subject", F.lit(False)))
    wanted = plain.filter("subject").select(*key).distinct()
    details = assets.select("asset_id", "name", "rel_path", "ext", F.col("size").alias("bytes"))
    return plain.join(wanted, key, "left_semi").join(details, "asset_id")


def membership_listing(factored: DataFrame, subject_id: int) -> DataFrame:
    """The clusters of one subject out of ``memberships``."""
    key = ["source_id", "kind", "key"]
    own = factored.filter(F.col("subject") & (F.col("asset_id") == subject_id)).select(*key)
    return factored.join(own, key, "left_semi").drop("subject")


def size_variants(subjects: DataFrame, assets: DataFrame) -> DataFrame:
    """Other pixel sizes of the same drawing, lowest id per size.

    Sizes come from the stem suffix when the subject has one, else from a folder of its path. A
    group offers at most two assets per known size, because only the subject itself is left out.
    """

    def keyed(df: DataFrame) -> DataFrame:
        suffix = pixel_suffix(F.col("stem"))
        folder = pixel_size_from_path(F.col("dir"))
        return df.select(
            "source_id",
            "ext",
            "asset_id",
            "name",
            "stem",
            suffix.alias("suffix"),
            folder.alias("folder"),
        )

    base = ["source_id", "ext"]

    def pool(form: str, stem: str, size: str) -> DataFrame:
        rows = keyed(assets).select(
            *base, "asset_id", "name", F.lit(form).alias("form"),
            F.expr(stem).alias("drawing"), F.expr(size).alias("pixels"),
        )
        return rows.filter(F.col("pixels").isNotNull())

    offers = pool("suffix", "suffix.canonical", "suffix.size").unionByName(
        pool("folder", "stem", "folder")
    )
    group = [*base, "form", "drawing"]
    offers = first_per(offers, [*group, "pixels"], 2).drop("rank")
    wants = keyed(subjects).select(
        *base,
        F.col("asset_id").alias("subject_id"),
        F.when(F.col("suffix").isNotNull(), "suffix")
        .when(F.col("folder").isNotNull(), "folder")
        .alias("form"),
        F.coalesce("suffix.canonical", "stem").alias("drawing"),
    )
    found = wants.join(offers, group).filter("subject_id <> asset_id")
    return first_per(found, ["subject_id", "pixels"], 1).select(
        "subject_id", F.col("pixels").alias("size"), "asset_id", "name"
    )
