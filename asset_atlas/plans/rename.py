"""Bulk rename checks. Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import filename_tips, new_rel_path
from ..functions.util import trim_blanks

RESERVED = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])(?:\..*)?$"
MAX_NAME_BYTES = 255


def _resolved(path: Column) -> Column:
    """Relative path with ``.`` and ``..`` applied; null when it climbs above its root."""
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("parts"), F.lit(False).alias("escaped")
    )

    def step(state: Column, part: Column) -> Column:
        up = part == ".."
        skip = part.isin("", ".")
        parts = state["parts"]
        return F.struct(
            F.when(up, F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
            .when(skip, parts)
            .otherwise(F.concat(parts, F.array(part)))
            .alias("parts"),
            (state["escaped"] | (up & (F.size(parts) == 0))).alias("escaped"),
        )

    return F.aggregate(
        F.split(path, "/"),
        start,
        step,
        lambda s: F.when(~s["escaped"], F.array_join(s["parts"], "/")),
    )


def rename_check(
    proposals: DataFrame, assets: DataFrame, case_insensitive: bool = False
) -> DataFrame:
    """Conflicts and tips per proposal (asset_id, new_name).

    A target is taken when the catalogue holds another asset at that path in the same source.
    """
    base = assets.select("source_id", "asset_id", "dir", "name", "ext")
    rows = proposals.select("asset_id", trim_blanks(F.col("new_name")).alias("new_name")).join(
        base, "asset_id"
    )
    raw_path = new_rel_path(F.col("dir"), F.col("new_name"))
    rows = rows.withColumn("new_rel_path", _resolved(raw_path))
    new, old = F.col("new_name"), F.col("name")
    given = new != ""
    illegal = new.rlike(r'[<>:"|?*]') | new.rlike(r"[\x00-\x1f]")
    taken = assets.select(
        "source_id", F.col("rel_path").alias("new_rel_path"), F.col("asset_id").alias("holder")
    )
    blocking = ~given | illegal | new.contains("/")

    def code(cond: Column, name: str) -> Column:
        return F.when(cond, F.lit(name))

    first = F.array_compact(
        F.array(
            code(~given, "EMPTY_NAME"),
            code(given & illegal, "ILLEGAL_CHAR"),
            code(new.contains("/"), "ILLEGAL_CHAR"),
            code(given & new.rlike(RESERVED), "RESERVED_NAME"),
            code(F.octet_length(new) > MAX_NAME_BYTES, "NAME_TOO_LONG"),
            code(
                given & ~F.lower(new).endswith(F.concat(F.lit("."), F.lower("ext"))),
                "EXTENSION_CHANGED",
            ),
            code(new == old, "SAME_NAME"),
            code(
                F.lit(case_insensitive) & given & (new != old) & (F.lower(new) == F.lower(old)),
                "CASE_ONLY_APFS",
            ),
            code(F.col("new_rel_path").isNull() | (F.col("new_rel_path") == ""), "TRAVERSAL"),
        )
    )
    holders = (
        rows.select("source_id", "asset_id", "new_rel_path")
        .join(taken, ["source_id", "new_rel_path"])
        .filter("holder <> asset_id")
        .select("asset_id", "new_rel_path")
        .distinct()
        .withColumn("target_taken", F.lit(True))
    )
    checked = rows.join(holders, ["asset_id", "new_rel_path"], "left").withColumn(
        "conflicts",
        F.concat(
            first,
            F.array_compact(
                F.array(code(F.col("target_taken") & ~blocking, "TARGET_EXISTS_DB"))
            ),
        ),
    )
    new_stem = F.substring(
        new, F.lit(1), F.greatest(F.length(new) - F.length("ext") - 1, F.lit(0))
    )
    empty = F.expr("cast(array() as array<string>)")
    return checked.select(
        "asset_id",
        "source_id",
        "new_name",
        "new_rel_path",
        "conflicts",
        F.when(F.size("conflicts") == 0, filename_tips(new_stem)).otherwise(empty).alias("tips"),
        (F.size("conflicts") == 0).alias("ok"),
    )


def sources_containing(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Assets whose path lies inside the root of another source, with how many there are.

    Every ancestor folder of a path is an exact key into the roots, so this is an equi-join.
    """
    parts = F.split("abs_path", "/")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"),
    )
    roots = sources.select(
        F.regexp_replace("root", r"/+$", "").alias("folder"), F.col("id").alias("other_id")
    )
    return (
        assets.select("asset_id", "source_id", F.explode(folders).alias("folder"))
        .join(roots, "folder")
        .filter("other_id <> source_id")
        .groupBy("asset_id")
        .agg(F.count("*").alias("other_sources"))
    )


def rename_warnings(proposals: DataFrame, assets: DataFrame, sources: DataFrame) -> DataFrame:
    """(asset_id, warning): inside another source, or sharing its file name with another asset."""
    wanted = assets.join(proposals.select("asset_id"), "asset_id", "left_semi")
    shared = sources_containing(wanted, sources).select(
        "asset_id", F.lit("SHARED_ACROSS_SOURCES").alias("warning")
    )
    held = assets.groupBy("name").agg(F.count("*").alias("holders")).filter("holders > 1")
    ambiguous = wanted.join(held, "name", "left_semi").select(
        "asset_id", F.lit("AMBIGUOUS_FILENAME").alias("warning")
    )
    return shared.unionByName(ambiguous)


def affected_usages(proposals: DataFrame, usages: DataFrame, sources: DataFrame) -> DataFrame:
    """References of the assets to rename; those outside the source root are external."""
    roots = sources.select(
        F.col("id").alias("source_id"), F.regexp_replace("root", r"/+$", "").alias("root")
    )
    inside = F.startswith(F.col("abs_path"), F.concat("root", F.lit("/")))
    return (
        usages.join(proposals.select("asset_id"), "asset_id", "left_semi")
        .join(roots, "source_id")
        .withColumn("external", (F.col("abs_path") != "") & ~inside)
        .drop("root")
    )


def rewrite_lines(renames: DataFrame, usages: DataFrame, lines: DataFrame) -> DataFrame:
    """Each reference with its line before and after; a line without the old name is stale.

    ``renames``: asset_id, name, new_name. ``lines``: rel_path, line_no, line. References to one
    line are applied in order of their id, each to the result of the one before.
    """
    wanted = usages.join(renames, "asset_id").select(
        F.col("id").alias("usage_id"), "rel_path", F.col("line").alias("line_no"), "name", "new_name"
    )
    per_line = (
        wanted.groupBy("rel_path", "line_no")
        .agg(F.sort_array(F.collect_list(F.struct("usage_id", "name", "new_name"))).alias("edits"))
        .join(lines.select("rel_path", "line_no", "line"), ["rel_path", "line_no"], "left")
    )
    start = F.struct(
        F.col("line").alias("text"),
        F.expr("cast(array() as array<struct<usage_id:bigint,before:string,after:string,stale:boolean>>)")
        .alias("done"),
    )

    def step(state: Column, e: Column) -> Column:
        at = F.position(F.lower(e["name"]), F.lower(state["text"]))
        miss = at.isNull() | (at == 0)
        text = F.when(miss, state["text"]).otherwise(
            F.overlay(state["text"], e["new_name"], at, F.length(e["name"]))
        )
        return F.struct(
            text.alias("text"),
            F.concat(
                state["done"],
                F.array(
                    F.struct(
                        e["usage_id"].alias("usage_id"),
                        state["text"].alias("before"),
                        F.when(~miss, text).alias("after"),
                        miss.alias("stale"),
                    )
                ),
            ).alias("done"),
        )

    return per_line.select(
        "rel_path", "line_no", F.inline(F.aggregate("edits", start, step, lambda s: s["done"]))
    )


