"""Clean-up plans as flat action rows.

One row per asset an action touches, so a merge of millions of copies stays a distributed table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = [
    "action_id", "kind", "role", "asset_id", "rel_path", "name", "size", "usage_count",
    "cluster_key",
]
KINDS = ["merge-exact", "merge-cluster", "delete-unused", "review-group", "rename-asset"]


def merge_actions(report: DataFrame, kind: str = "merge-exact") -> DataFrame:
    """Keep the canonical member of each group and drop the others."""
    return report.select(
        F.concat_ws(":", F.lit(kind), F.col("source_id"), F.col("key")).alias("action_id"),
        F.lit(kind).alias("kind"),
        F.when(F.col("role") == "canonical", "keep").otherwise("drop").alias("role"),
        "asset_id",
        "rel_path",
        "name",
        "size",
        "usage_count",
        F.col("key").alias("cluster_key"),
    )


def delete_unused_action(unused: DataFrame) -> DataFrame:
    """One delete action per source over its unreferenced assets."""
    return unused.select(
        F.concat(F.lit("delete-unused:"), F.col("source_id")).alias("action_id"),
        F.lit("delete-unused").alias("kind"),
        F.lit("drop").alias("role"),
        "asset_id",
        "rel_path",
        "name",
        "size",
        F.lit(0).cast("long").alias("usage_count"),
        F.lit("").alias("cluster_key"),
    )


def review_action(assets: DataFrame, action_id: Column) -> DataFrame:
    return assets.select(
        action_id.alias("action_id"),
        F.lit("review-group").alias("kind"),
        F.lit("review").alias("role"),
        "asset_id",
        "rel_path",
        "name",
        "size",
        "usage_count",
        F.lit("").alias("cluster_key"),
    )


def rename_actions(renames: DataFrame) -> DataFrame:
    """From and to rows of renames (asset fields plus new_name, new_rel_path)."""
    action = F.concat(F.lit("rename-asset:"), F.col("asset_id"))
    before = renames.select(
        action.alias("action_id"),
        F.lit("rename-asset").alias("kind"),
        F.lit("from").alias("role"),
        "asset_id", "rel_path", "name", "size", "usage_count",
        F.lit("").alias("cluster_key"),
    )
    after = renames.select(
        action.alias("action_id"),
        F.lit("rename-asset").alias("kind"),
        F.lit("to").alias("role"),
        "asset_id",
        F.col("new_rel_path").alias("rel_path"),
        F.col("new_name").alias("name"),
        "size",
        F.lit(0).cast("long").alias("usage_count"),
        F.lit("").alias("cluster_key"),
    )
    return before.unionByName(after)


def plan_stats(actions: DataFrame) -> DataFrame:
    """Actions, files, references and bytes a plan touches.

    Reviews only count as actions; renames add their references.
    """
    drop = F.col("role") == "drop"
    refs = drop | ((F.col("kind") == "rename-asset") & (F.col("role") == "from"))
    zero = F.lit(0)
    return actions.agg(
        F.count_distinct("action_id").alias("action_count"),
        F.count_if(drop).alias("file_count"),
        F.coalesce(F.sum(F.when(refs, F.col("usage_count"))), zero).alias("ref_count"),
        F.coalesce(F.sum(F.when(drop, F.col("size"))), zero).alias("reclaimable_bytes"),
    )


def action_titles(actions: DataFrame) -> DataFrame:
    """One sentence per action."""
    role = F.col("role")
    per = actions.groupBy("action_id", "kind", "cluster_key").agg(
        F.count_if(role.isin("drop", "review")).alias("n"),
        F.max(F.when(role.isin("keep", "from"), F.col("name"))).alias("first_name"),
        F.max(F.when(role == "to", F.col("name"))).alias("new_name"),
    )
    plural = F.when(F.col("n") == 1, "").otherwise("s")
    n = F.col("n").cast("string")
    title = (
        F.when(F.col("kind") == "merge-exact", F.concat(F.lit("Merge duplicates into "), "first_name"))
        .when(
            F.col("kind") == "merge-cluster",
            F.concat(F.lit("Merge cluster "), "cluster_key", F.lit(" into "), "first_name"),
        )
        .when(
            F.col("kind") == "review-group",
            F.concat(F.lit("Review "), n, F.lit(" flagged asset"), plural),
        )
        .when(
            F.col("kind") == "rename-asset",
            F.concat(F.lit("Rename "), "first_name", F.lit(" → "), "new_name"),
        )
        .otherwise(F.concat(F.lit("Delete "), n, F.lit(" unused asset"), plural))
    )
    return per.select("action_id", "kind", title.alias("title"))


def plan_violations(plan: DataFrame, actions: DataFrame, version: str) -> DataFrame:
    """(subject, rule) for every broken rule of a plan header table and its action rows."""
    checks = {
        "version": F.col("version").eqNullSafe(F.lit(version)),
        "slug": F.coalesce(F.col("id").rlike(r"^[a-zA-Z0-9_-]+$"), F.lit(False)),
        "name": F.coalesce(F.col("name") != "", F.lit(False)),
        "source": F.coalesce(F.col("source_id") > 0, F.lit(False)),
    }
    head = plan.select(
        F.col("id").alias("subject"),
        F.explode(
            F.array_compact(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in checks.items()]))
        ).alias("rule"),
    )
    row_checks = {
        "asset_id": F.coalesce(F.col("asset_id") > 0, F.lit(False)),
        "rel_path": F.coalesce(F.col("rel_path") != "", F.lit(False)),
        "name": F.coalesce(F.col("name") != "", F.lit(False)),
        "size": F.coalesce(F.col("size") >= 0, F.lit(False)),
        "usage_count": F.coalesce(F.col("usage_count") >= 0, F.lit(False)),
        "kind": F.coalesce(F.col("kind").isin(KINDS), F.lit(False)),
    }
    rows = actions.select(
        F.col("action_id").alias("subject"),
        F.explode(
            F.array_compact(F.array(*[F.when(~ok, F.lit(rule)) for rule, ok in row_checks.items()]))
        ).alias("rule"),
    )
    per = actions.groupBy("action_id", "kind").agg(
        F.count_if(F.col("role") == "drop").alias("drops"),
        F.count_if(F.col("role") == "review").alias("reviews"),
        F.max("cluster_key").alias("cluster_key"),
    )
    merges = F.col("kind").isin("merge-exact", "merge-cluster")
    needs = per.select(
        F.col("action_id").alias("subject"),
        F.explode(
            F.array_compact(
                F.array(
                    F.when(
                        (merges | (F.col("kind") == "delete-unused")) & (F.col("drops") == 0),
                        F.lit("drop"),
                    ),
                    F.when((F.col("kind") == "review-group") & (F.col("reviews") == 0), F.lit("refs")),
                    F.when(merges & (F.col("cluster_key") == ""), F.lit("cluster_key")),
                )
            )
        ).alias("rule"),
    )
    return head.unionByName(rows).unionByName(needs).distinct()
