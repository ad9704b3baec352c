"""What design system does the code really use? Aggregates over style occurrences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.color import NEAR_MISS, lab65
from ..functions.names import percent_text
from ..session import cut
from .catalog import global_positions, top_asset_dirs
from .simjoin import MAX_LIGHTNESS_WEIGHT, with_delta_e

# How strongly a context speaks for a brand colour.
STRONG_PROPS = ["color", "background", "background-color", "fill", "accent-color"]
STRONG_PREFIXES = ["bg", "text", "fill"]
CHROME_PROPS = ["outline", "box-shadow", "text-shadow", "column-rule"]
TRANSLUCENT_WEIGHT = 0.4
NEUTRAL_WEIGHT = 0.1

LITERAL_COLOR = ["css-decl", "js-literal", "svg-attr", "tailwind-arbitrary"]
LITERAL_TYPE = ["css-decl", "js-literal"]
CONTEXTS = [
    "css-decl", "css-var-def", "css-var-ref", "tailwind-arbitrary", "js-literal", "svg-attr",
]


def coverage_pct(tokenized: Column, literal: Column) -> Column:
    """Share of values that go through a token; null when there is nothing to score."""
    return F.try_divide(tokenized, tokenized + literal)


def suspicion(canonical: Column, variants: Column, variant_count: Column, distance: Column) -> Column:
    """High for a popular canonical, rare variants and a small distance."""
    near = F.coalesce(distance, F.lit(0.0))
    return F.log1p(canonical) * F.log1p(variants + variant_count) / (near + 0.5)


def context_weight(kind: Column, detail: Column) -> Column:
    return (
        F.when(kind == "css-var-def", F.lit(1.0))
        .when(kind == "css-var-ref", F.lit(0.8))
        .when((kind == "css-decl") & detail.isin(STRONG_PROPS), F.lit(1.0))
        .when((kind == "css-decl") & (detail == "stroke"), F.lit(0.6))
        .when(
            (kind == "css-decl") & (detail.startswith("border") | detail.isin(CHROME_PROPS)),
            F.lit(0.3),
        )
        .when((kind == "tailwind-arbitrary") & detail.isin(STRONG_PREFIXES), F.lit(1.0))
        .when(kind.isin("tailwind-arbitrary", "js-literal"), F.lit(0.6))
        .otherwise(F.lit(0.5))
    )


def brand_score(weighted: Column, files: Column) -> Column:
    return F.log1p(weighted) * files


# --- typography ------------------------------------------------------------------------------


def type_stats(styles: DataFrame) -> DataFrame:
    """Usage, files and spellings per (axis, value); spellings are counted before they are listed."""
    literal = styles.filter(
        (F.col("kind") == "type")
        & F.col("context_kind").isin(LITERAL_TYPE)
        & F.col("normalized_value").isNotNull()
        & F.col("axis").isNotNull()
    ).select("source_id", "axis", F.col("normalized_value").alias("value"), "raw_token", "rel_path")
    key = ["source_id", "axis", "value"]
    files = literal.groupBy(*key).agg(
        F.count("*").alias("usage_count"), F.count_distinct("rel_path").alias("file_count")
    )
    raws = (
        literal.groupBy(*key, "raw_token")
        .agg(F.count("*").alias("n"))
        .groupBy(*key)
        .agg(
            F.count("*").alias("spelling_count"),
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "raw_token", "n"))),
                lambda s: F.struct(s["raw_token"].alias("raw"), s["n"].alias("n")),
            ).alias("spellings"),
        )
    )
    return files.join(raws, key)


def type_coverage(styles: DataFrame) -> DataFrame:
    kind = F.col("context_kind")
    counts = (
        styles.filter(F.col("kind") == "type")
        .groupBy("source_id")
        .agg(
            F.count_if(kind == "css-var-ref").alias("tokenized"),
            F.count_if(kind.isin(LITERAL_TYPE)).alias("literal"),
            F.count_if(kind == "tailwind-named").alias("not_scored"),
        )
    )
    return counts.withColumn("pct", coverage_pct(F.col("tokenized"), F.col("literal")))


def type_scale(stats: DataFrame) -> DataFrame:
    """Values with their place in the scale: sizes and weights by number, the rest by use.

    Places come from one total order in range chunks, less the first place of the (source, axis); so
    an axis with very many values is not sorted by one task.
    """
    numeric = F.col("axis").isin("size", "weight")
    group = ["source_id", "axis"]
    keyed = stats.withColumns({
        "_number": F.when(numeric, F.col("value").try_cast("double")),
        "_use": F.when(~numeric, -F.col("usage_count")),
    })
    parts = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = global_positions(keyed, [*group, "_number", "_use", "value"], parts)
    first = placed.groupBy(*group).agg(F.min("pos").alias("_first"))
    return placed.join(first, group).withColumn(
        "position", (F.col("pos") - F.col("_first") + 1).cast("int")
    ).drop("pos", "_first", "_number", "_use")


def mixed_spellings(stats: DataFrame) -> DataFrame:
    return stats.filter("spelling_count > 1")


def representative_locations(styles: DataFrame, kind: str) -> DataFrame:
    """Best file and line per value: a known line first, then path, then line."""
    rows = styles.filter((F.col("kind") == kind) & F.col("normalized_value").isNotNull())
    scored = F.col("context_kind").isin(LITERAL_COLOR if kind == "color" else LITERAL_TYPE)
    first = F.lit(True) if kind == "type" else scored
    rank = F.struct(
        (~first).alias("unscored"),
        F.col("line").isNull().alias("unplaced"),
        F.col("rel_path").alias("file"),
        F.coalesce("line", F.lit(0)).alias("at"),
        F.coalesce("col", F.lit(0)).alias("col"),
        F.col("line").alias("line"),
    )
    return (
        rows.groupBy("source_id", F.coalesce("axis", F.lit("")).alias("axis"),
                     F.col("normalized_value").alias("value"))
        .agg(F.min(rank).alias("best"))
        .select("source_id", "axis", "value", F.col("best.file").alias("file"),
                F.col("best.line").alias("line"))
    )


def _findings(clusters: DataFrame) -> DataFrame:
    """One row per near-miss cluster with its suspicion."""
    canonical = F.col("role") == "canonical"
    return (
        clusters.groupBy(
            "source_id", "kind", "key", "axis", "canonical", "neutral", "max_distance"
        )
        .agg(
            F.sum(F.when(canonical, F.col("usage_count"))).alias("canonical_usage"),
            F.sum(F.when(~canonical, F.col("usage_count"))).alias("variant_usage"),
            F.count_if(~canonical).alias("variant_count"),
        )
        .filter((F.col("variant_count") > 0) & F.col("canonical_usage").isNotNull())
        .withColumn(
            "suspicion",
            suspicion(
                F.col("canonical_usage"),
                F.col("variant_usage"),
                F.col("variant_count"),
                F.col("max_distance"),
            ),
        )
    )


def _with_variants(findings: DataFrame, clusters: DataFrame, places: DataFrame) -> DataFrame:
    """One row per (finding, variant) with where the variant can be seen."""
    variants = clusters.filter("role = 'variant'").select(
        "source_id",
        "kind",
        "key",
        F.col("value").alias("variant"),
        F.col("usage_count").alias("usage"),
        "distance",
        F.coalesce("axis", F.lit("")).alias("place_axis"),
    )
    spots = places.withColumnsRenamed({"value": "variant", "axis": "place_axis"})
    return (
        findings.join(variants, ["source_id", "kind", "key"])
        .join(spots, ["source_id", "place_axis", "variant"], "left")
        .drop("place_axis")
    )


def type_drift(clusters: DataFrame, styles: DataFrame) -> DataFrame:
    """Typography near-misses, most suspicious first when ordered by ``suspicion``."""
    own = clusters.filter("kind = 'type'")
    return _with_variants(_findings(own), own, representative_locations(styles, "type"))


# --- colour ----------------------------------------------------------------------------------


def color_vars(styles: DataFrame) -> DataFrame:
    """Colour of each defined variable: its most frequent definition, then the smallest hex."""
    return (
        styles.filter(
            (F.col("kind") == "color")
            & (F.col("context_kind") == "css-var-def")
            & F.col("normalized_value").isNotNull()
        )
        .groupBy("source_id", F.col("context_detail").alias("var"), F.col("normalized_value").alias("color"))
        .agg(F.count("*").alias("defs"))
        .groupBy("source_id", "var")
        .agg(
            F.min_by("color", F.struct(-F.col("defs"), F.col("color"))).alias("color"),
            F.sum("defs").alias("def_count"),
        )
    )


def color_var_refs(styles: DataFrame) -> DataFrame:
    """References per variable and file, counted before any join sees a popular variable."""
    return (
        styles.filter((F.col("kind") == "color") & (F.col("context_kind") == "css-var-ref"))
        .groupBy("source_id", F.col("context_detail").alias("var"), "rel_path")
        .agg(F.count("*").alias("refs"))
    )


def var_table(styles: DataFrame) -> DataFrame:
    """Defined variables with colour, definitions and total references."""
    refs = color_var_refs(styles).groupBy("source_id", "var").agg(F.sum("refs").alias("ref_count"))
    return color_vars(styles).join(refs, ["source_id", "var"], "left").withColumn(
        "ref_count", F.coalesce("ref_count", F.lit(0))
    )


def color_stats(styles: DataFrame) -> DataFrame:
    """Per colour: usage, files, weighted usage, opaque uses and uses per context.

    References that resolve to a defined variable count for that variable's colour.
    """
    kind = F.col("context_kind")
    alpha = F.when(F.col("alpha") < 1, F.lit(TRANSLUCENT_WEIGHT)).otherwise(F.lit(1.0))
    direct = (
        styles.filter(
            (F.col("kind") == "color")
            & F.col("normalized_value").isNotNull()
            & (kind != "css-var-ref")
        )
        .groupBy("source_id", F.col("normalized_value").alias("color"), "rel_path", "context_kind")
        .agg(
            F.count("*").alias("n"),
            F.sum(context_weight(kind, F.col("context_detail")) * alpha).alias("weight"),
            F.count_if(F.col("alpha").isNull() | (F.col("alpha") >= 1)).alias("opaque"),
        )
    )
    resolved = color_var_refs(styles).join(
        color_vars(styles).select("source_id", "var", "color"), ["source_id", "var"]
    )
    through = resolved.select(
        "source_id",
        "color",
        "rel_path",
        F.lit("css-var-ref").alias("context_kind"),
        F.col("refs").alias("n"),
        (F.col("refs") * 0.8).alias("weight"),
        F.col("refs").alias("opaque"),
    )
    return (
        direct.unionByName(through)
        .groupBy("source_id", "color")
        .agg(
            F.sum("n").alias("usage_count"),
            F.count_distinct("rel_path").alias("file_count"),
            F.sum("weight").alias("weighted_usage"),
            F.sum("opaque").alias("opaque_count"),
            *[
                F.coalesce(F.sum(F.when(kind == c, F.col("n"))), F.lit(0)).alias(
                    c.replace("-", "_")
                )
                for c in CONTEXTS
            ],
        )
        .withColumn("brand_score", brand_score(F.col("weighted_usage"), F.col("file_count")))
    )


def color_coverage(styles: DataFrame) -> DataFrame:
    kind = F.col("context_kind")
    rows = (
        styles.filter(F.col("kind") == "color")
        .groupBy("source_id")
        .agg(
            F.count_if(kind.isin(LITERAL_COLOR)).alias("literal"),
            F.count_if(kind == "css-var-def").alias("definitions"),
            F.count_if(kind == "tailwind-named").alias("not_scored"),
        )
    )
    known = color_vars(styles).select("source_id", "var", F.lit(True).alias("known"))
    refs = (
        color_var_refs(styles)
        .join(known, ["source_id", "var"], "left")
        .groupBy("source_id")
        .agg(
            F.coalesce(F.sum(F.when(F.col("known"), F.col("refs"))), F.lit(0)).alias("tokenized"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("refs"))), F.lit(0)).alias(
                "unresolved_vars"
            ),
        )
    )
    joined = rows.join(refs, "source_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokenized", "unresolved_vars")}
    return joined.withColumns(zero).withColumn(
        "pct", coverage_pct(F.col("tokenized"), F.col("literal"))
    )


def palette(stats: DataFrame, n: int = 12) -> DataFrame:
    """Best brand colours per source."""
    order = Window.partitionBy("source_id").orderBy(F.desc("brand_score"), "color")
    return stats.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def most_used(stats: DataFrame, n: int = 12) -> DataFrame:
    order = Window.partitionBy("source_id").orderBy(F.desc("usage_count"), "color")
    return stats.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def one_offs(stats: DataFrame) -> DataFrame:
    return stats.filter("usage_count = 1")


def suggested_tokens(styles: DataFrame) -> DataFrame:
    """Most referenced variable per colour; ties go to the first name."""
    best = F.min_by("var", F.struct((-F.col("ref_count")).alias("r"), F.col("var")))
    return var_table(styles).groupBy("source_id", "color").agg(best.alias("token"))


def color_drift(clusters: DataFrame, styles: DataFrame) -> DataFrame:
    """Colour near-misses with a token to use instead. Neutral findings rank below chromatic ones."""
    own = clusters.filter("kind = 'color'")
    damp = F.when(F.col("neutral"), F.lit(NEUTRAL_WEIGHT)).otherwise(F.lit(1.0))
    found = _findings(own).withColumn("suspicion", F.col("suspicion") * damp)
    tokens = suggested_tokens(styles).withColumnRenamed("color", "canonical")
    named = found.join(tokens, ["source_id", "canonical"], "left").withColumn(
        "suggested_token", F.coalesce("token", "canonical")
    )
    return _with_variants(
        named.drop("token"), own, representative_locations(styles, "color")
    )


def drift_order(kind: str) -> list[Column]:
    neutral = [F.asc("neutral")] if kind == "color" else []
    return [*neutral, F.desc("suspicion"), F.asc("key"), F.asc("variant")]


def drift_list(
    drift: DataFrame, kind: str, top_n: int = 10, changed: DataFrame | None = None
) -> DataFrame:
    """Variants of the top findings, optionally only findings seen in changed files."""
    key = ["source_id", "key"]
    if changed is not None:
        files = changed.select(F.col("path").alias("file"))
        touched = drift.join(files, "file", "left_semi").select(*key).distinct()
        drift = drift.join(touched, key, "left_semi")
    order = drift_order(kind)[:-1]
    heads = drift.select(*key, "neutral", "suspicion").distinct()
    window = Window.partitionBy("source_id").orderBy(*order)
    ranked = heads.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top_n)
    return drift.join(ranked.select(*key, "rank"), key)


def token_candidates(styles: DataFrame) -> DataFrame:
    """Colours in use with the variable to name them by, if any."""
    return (
        color_stats(styles)
        .select("source_id", "color")
        .join(suggested_tokens(styles), ["source_id", "color"], "left")
        .select("source_id", "color", "token")
    )


def resolve_tokens(values: DataFrame, candidates: DataFrame, limit: float = NEAR_MISS) -> DataFrame:
    """Nearest candidate of each (source_id, value); a defined token wins a tie.

    Lightness bounds the search: values without a neighbour in a narrow band are retried in wider
    ones, so most values meet few candidates and all get their true nearest.
    """
    cand = candidates.select("source_id", "color", "token").distinct()
    right = cut(cand.withColumn("lab", lab65("color")).withColumn("l", F.col("lab.l")))
    wanted = values.select("source_id", "value").distinct()
    left = cut(wanted.withColumn("lab", lab65("value")).withColumn("l", F.col("lab.l")))
    parts = []
    for reach in (limit, limit * 4, limit * 16, limit * 64):
        width = min(reach * MAX_LIGHTNESS_WEIGHT, 100.0) / 4
        cells = F.floor(F.col("l") / width).cast("long")
        wide = left.withColumn("cell", F.explode(F.sequence(cells - 4, cells + 4)))
        near = right.withColumn("cell", cells)
        pairs = (
            wide.alias("a")
            .join(
                near.alias("b"),
                (F.col("a.source_id") == F.col("b.source_id"))
                & (F.col("a.cell") == F.col("b.cell")),
            )
            .select(
                F.col("a.source_id").alias("source_id"),
                "value",
                "color",
                "token",
                F.col("a.lab").alias("p"),
                F.col("b.lab").alias("q"),
            )
        )
        best = (
            with_delta_e(pairs, reach, ["source_id", "value", "color", "token"])
            .groupBy("source_id", "value")
            .agg(
                F.min(
                    F.struct(
                        F.col("delta_e").alias("d"),
                        F.col("token").isNull().alias("bare"),
                        "color",
                        "token",
                    )
                ).alias("m")
            )
        )
        found = cut(best)
        parts.append(found)
        left = cut(left.join(found, ["source_id", "value"], "left_anti"))
        if left.isEmpty():
            break
    hit = reduce(DataFrame.unionByName, parts)
    return values.select("source_id", "value").distinct().join(hit, ["source_id", "value"], "left").select(
        "source_id",
        "value",
        F.coalesce(F.col("m.d") < limit, F.lit(False)).alias("within"),
        F.col("m.color").alias("nearest"),
        F.col("m.token").alias("token"),
        F.col("m.d").alias("delta_e"),
    )


def context_digest(assets: DataFrame, styles: DataFrame) -> DataFrame:
    """One short, deterministic text per source: palette, type scale, coverage, asset folders."""
    sep = " · "

    def listed(rows: DataFrame, text: Column, order: Column, name: str) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct(order.alias("o"), text.alias("t"))))
        return rows.groupBy("source_id").agg(
            F.array_join(F.transform(pairs, lambda p: p["t"]), sep).alias(name)
        )

    colors = palette(color_stats(styles))
    scale = type_scale(type_stats(styles))
    use = F.concat(F.col("value"), F.lit(" ×"), F.col("usage_count"))
    parts = [
        listed(
            colors, F.concat(F.col("color"), F.lit(" ×"), F.col("usage_count")), F.col("rank"), "palette"
        ),
        listed(scale.filter("axis = 'size'"), F.col("value"), F.col("position"), "sizes"),
        listed(scale.filter("axis = 'family'"), use, F.col("position"), "families"),
        listed(scale.filter("axis = 'weight'"), F.col("value"), F.col("position"), "weights"),
        color_coverage(styles).select("source_id", percent_text(F.col("pct")).alias("color_pct")),
        type_coverage(styles).select("source_id", percent_text(F.col("pct")).alias("type_pct")),
        top_asset_dirs(assets)
        .groupBy("source_id")
        .agg(
            F.array_join(
                F.transform(F.sort_array(F.collect_list(F.struct("rank", "dir"))), lambda d: d["dir"]),
                ", ",
            ).alias("dirs")
        ),
    ]
    base = assets.select("source_id").unionByName(styles.select("source_id")).distinct()
    joined = reduce(lambda a, b: a.join(b, "source_id", "left"), parts, base)
    none = F.lit("(none)")
    return joined.select(
        "source_id",
        F.concat_ws(
            "\n",
            F.lit("## Brand palette"),
            F.coalesce("palette", F.lit("(none indexed)")),
            F.lit(""),
            F.lit("## Type scale"),
            F.concat(F.lit("sizes: "), F.coalesce("sizes", none)),
            F.concat(F.lit("families: "), F.coalesce("families", none)),
            F.concat(F.lit("weights: "), F.coalesce("weights", none)),
            F.lit(""),
            F.lit("## Tokenization"),
            F.concat(
                F.lit("color coverage "),
                F.coalesce("color_pct", F.lit("n/a")),
                F.lit(" · type coverage "),
                F.coalesce("type_pct", F.lit("n/a")),
            ),
            F.concat(F.lit("canonical asset dirs: "), F.coalesce("dirs", none)),
        ).alias("digest"),
    )
