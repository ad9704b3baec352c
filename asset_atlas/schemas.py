"""Column layouts of the catalogue tables, as Spark DDL."""

SOURCES = "id BIGINT, root STRING, label STRING, created_at TIMESTAMP, last_indexed_at TIMESTAMP"

ASSETS = (
    "asset_id BIGINT, source_id BIGINT, abs_path STRING, rel_path STRING, dir STRING, name STRING, "
    "stem STRING, ext STRING, size BIGINT, mtime BIGINT, content_hash STRING, sha1 STRING, width INT, "
    "height INT, category STRING, phash STRING, view_box STRING, paths_count INT, commands_count INT, "
    "has_fill BOOLEAN, stroke_widths ARRAY<STRING>, literal_colors ARRAY<STRING>, "
    "dominant_color STRING, author STRING, embedding ARRAY<FLOAT>, phash_popcount INT, "
    "white_fraction DOUBLE, embed_status STRING"
)

USAGES = (
    "id BIGINT, asset_id BIGINT, source_id BIGINT, rel_path STRING, abs_path STRING, line INT, "
    "snippet STRING, commented BOOLEAN"
)

CLUSTERS = "source_id BIGINT, kind STRING, key STRING, size BIGINT"
CLUSTER_MEMBERS = "source_id BIGINT, kind STRING, key STRING, asset_id BIGINT, role STRING, hamming INT"

STYLE_USAGES = (
    "source_id BIGINT, kind STRING, normalized_value STRING, axis STRING, alpha DOUBLE, "
    "raw_token STRING, rel_path STRING, abs_path STRING, line INT, col INT, start_offset INT, "
    "end_offset INT, snippet STRING, context_kind STRING, context_detail STRING"
)

STYLE_CLUSTERS = (
    "source_id BIGINT, kind STRING, key STRING, canonical STRING, size BIGINT, neutral BOOLEAN, "
    "max_distance DOUBLE, axis STRING, metric STRING"
)
STYLE_CLUSTER_MEMBERS = (
    "source_id BIGINT, kind STRING, key STRING, value STRING, role STRING, distance DOUBLE, "
    "usage_count BIGINT"
)

CODE_FILES = "source_id BIGINT, rel_path STRING, abs_path STRING, ext STRING, text STRING"

QUERY_SIGNATURES = (
    "query_id BIGINT, name STRING, stem STRING, ext STRING, size BIGINT, sha1 STRING, "
    "content_hash STRING, phash STRING, width INT, height INT, dominant_color STRING, "
    "embedding ARRAY<FLOAT>"
)

PLAN_ACTIONS = (
    "action_id STRING, kind STRING, role STRING, asset_id BIGINT, rel_path STRING, name STRING, "
    "size BIGINT, usage_count BIGINT, cluster_key STRING"
)
