"""Catalogue views over the shared test tables, spelled once for Spark and once for DuckDB.

Every view reads its whole table. Thresholds inside a CASE only decide what a row stands for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_source(key: str) -> str:
    """All rows belong to source 1, as a value of the row rather than a constant.

    A constant would turn joins on the source into joins without a key.
    """
    return f"if({key} is null, 0L, 1L) as source_id"


def by_file(lines: DataFrame, *key: str) -> DataFrame:
    """Spread lines by file over the session's shuffle partitions.

    Extraction after this costs far more per byte than the shuffle, so the partition count is
    fixed rather than left to be merged by size.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lines.repartition(parts, *key)


def _view(spark: SparkSession, sf_dir: str, name: str, *exprs: str) -> DataFrame:
    return table(spark, sf_dir, name).selectExpr(*exprs)


# --- documents as text assets, labels as their references ----------------------------------------


def assets_doc(spark: SparkSession, d: str) -> DataFrame:
    return _view(
        spark, d, "documents",
        one_source("doc_id"), "doc_id as asset_id", "concat(source, '/', lang) as dir",
        "concat('doc-', doc_id, '.', lang) as name", "concat('doc-', doc_id) as stem",
        "lang as ext", "concat(source, '/', lang, '/doc-', doc_id, '.', lang) as rel_path",
        "n_chars as size", "md5(text) as content_hash",
    )


def usages_lab(spark: SparkSession, d: str) -> DataFrame:
    return _view(
        spark, d, "labels",
        "doc_id as id", "doc_id as asset_id", one_source("doc_id"),
        "concat('review-', quality, '.md') as rel_path", "toxic + 1 as line",
        "quality = 0 as commented",
    )


ASSETS_DOC = """assets_doc AS (SELECT CAST(1 AS BIGINT) AS source_id, doc_id AS asset_id,
  source || '/' || lang AS dir, 'doc-' || doc_id || '.' || lang AS name, 'doc-' || doc_id AS stem,
  lang AS ext, source || '/' || lang || '/doc-' || doc_id || '.' || lang AS rel_path,
  n_chars AS size, md5(text) AS content_hash FROM documents)"""
USAGES_LAB = """usages_lab AS (SELECT doc_id AS id, doc_id AS asset_id,
  'review-' || quality || '.md' AS rel_path, toxic + 1 AS line, quality = 0 AS commented
  FROM labels)"""

# --- parts as images, line items as their references ---------------------------------------------

PART_EXT = (
    "case p_type when 'SMALL' then 'svg' when 'LARGE' then 'png' when 'MEDIUM' then 'jpg' "
    "when 'PROMO' then 'webp' else 'gif' end"
)


def assets_part(spark: SparkSession, d: str) -> DataFrame:
    return (
        _view(
            spark, d, "part",
            one_source("p_partkey"), "p_partkey as asset_id",
            "concat(lower(p_type), '/', replace(p_brand, '#', '-'), '/', p_size) as dir",
            "concat(replace(p_name, ' ', '-'), '-', p_size) as stem", f"{PART_EXT} as ext",
            "cast(round(p_retailprice * 100) as bigint) as size",
            "p_partkey * 1000 + p_size as mtime", "p_size * 16 as width", "p_size * 12 as height",
            "md5(concat(p_name, '|', p_brand)) as content_hash",
        )
        .selectExpr(
            "*", "concat(stem, '.', ext) as name", "concat(dir, '/', stem, '.', ext) as rel_path",
            "concat('/repo/', dir, '/', stem, '.', ext) as abs_path",
        )
    )


def usages_li(spark: SparkSession, d: str) -> DataFrame:
    return _view(
        spark, d, "lineitem",
        "l_partkey as asset_id", one_source("l_partkey"), "concat('order-', l_orderkey, '.html') as rel_path",
        "l_linenumber as line", "l_returnflag = 'R' as commented",
    )


ASSETS_PART = f"""part_base AS (SELECT CAST(1 AS BIGINT) AS source_id, p_partkey AS asset_id,
  lower(p_type) || '/' || replace(p_brand, '#', '-') || '/' || p_size AS dir,
  replace(p_name, ' ', '-') || '-' || p_size AS stem, {PART_EXT} AS ext,
  CAST(round(p_retailprice * 100) AS BIGINT) AS size, p_partkey * 1000 + p_size AS mtime,
  p_size * 16 AS width, p_size * 12 AS height, md5(p_name || '|' || p_brand) AS content_hash
  FROM part),
assets_part AS (SELECT *, stem || '.' || ext AS name, dir || '/' || stem || '.' || ext AS rel_path,
  '/repo/' || dir || '/' || stem || '.' || ext AS abs_path FROM part_base)"""
USAGES_LI = """usages_li AS (SELECT l_partkey AS asset_id, 'order-' || l_orderkey || '.html' AS rel_path,
  l_linenumber AS line, l_returnflag = 'R' AS commented FROM lineitem)"""

# --- embeddings as images with fingerprints ------------------------------------------------------


def assets_vec(spark: SparkSession, d: str) -> DataFrame:
    return (
        _view(
            spark, d, "embeddings",
            one_source("vec_id"), "vec_id as asset_id", "concat('l', label) as ext",
            "concat('kind', label, '-fam', substring(md5(cast(vec_id as string)), 1, 1), '-tint', "
            "substring(md5(cast(vec_id as string)), 2, 1)) as stem",
            "lower(lpad(hex(aggregate(embedding, 0L, (b, x) -> shiftleft(b, 1) | if(x > 0, 1L, 0L))), "
            "16, '0')) as phash",
            "embedding", "1024L as size", "cast(null as string) as embed_status",
            "cast(null as int) as width", "cast(null as int) as height",
        )
        .selectExpr(
            "*", "concat(stem, '.', ext) as name", "ext as dir",
            "concat(ext, '/', stem, '-', asset_id, '.', ext) as rel_path",
            "md5(concat(ext, stem)) as content_hash",
        )
    )


def queries_vec(spark: SparkSession, d: str) -> DataFrame:
    """Every catalogue image asked as a query against the whole catalogue."""
    return assets_vec(spark, d).withColumnRenamed("asset_id", "query_id")


ASSETS_VEC = """vec_base AS (SELECT CAST(1 AS BIGINT) AS source_id, vec_id AS asset_id,
  'l' || label AS ext, 'kind' || label || '-fam' || md5(CAST(vec_id AS VARCHAR))[1] || '-tint' ||
  md5(CAST(vec_id AS VARCHAR))[2] AS stem,
  CAST(array_to_string([CASE WHEN x > 0 THEN '1' ELSE '0' END FOR x IN embedding], '') AS BIT) AS bits,
  CAST(embedding AS DOUBLE[]) AS embedding, CAST(1024 AS BIGINT) AS size FROM embeddings),
assets_vec AS (SELECT *, stem || '.' || ext AS name, ext AS dir,
  ext || '/' || stem || '-' || asset_id || '.' || ext AS rel_path,
  md5(ext || stem) AS content_hash, ['kind' || ext[2:], split_part(stem, '-', 2),
  split_part(stem, '-', 3)] AS tokens FROM vec_base)"""

# --- events as style occurrences -----------------------------------------------------------------

EVENT_COLOR = (
    "concat('#', substring(md5(cast(user_id as varchar)), 1, 1), substring(md5(cast(user_id as varchar)), 1, 1), "
    "substring(md5(cast(user_id as varchar)), 2, 1), substring(md5(cast(user_id as varchar)), 2, 1), "
    "substring(md5(cast(user_id as varchar)), 3, 1), substring(md5(cast(user_id as varchar)), 3, 1))"
)
# the same text in the other dialect, with one md5 instead of six
EVENT_COLOR_SPARK = (
    "concat('#', regexp_replace(left(md5(cast(user_id as string)), 3), '(.)', '$1$1'))"
)
STYLE_COLOR_COLUMNS = {
    "event_id": "event_id",
    "rel_path": "concat('f', cast(floor(event_id / 50) as bigint), '.css')",
    "line": "cast(event_id % 50 + 1 as int)",
    "context_kind": (
        "case event_type when 'signup' then 'css-var-def' when 'view' then 'css-var-ref' "
        "when 'click' then 'css-decl' when 'purchase' then 'tailwind-arbitrary' "
        "else case when value > 20 then 'svg-attr' else 'tailwind-named' end end"
    ),
    "context_detail": (
        "case event_type when 'signup' then concat('--c', user_id) "
        "when 'view' then case when value < 40 then concat('--c', user_id) else '--space' end "
        "when 'click' then case when value < 10 then 'color' else 'border-color' end "
        "when 'purchase' then 'bg' end"
    ),
    "normalized_value": (
        f"case when event_type = 'view' or (event_type = 'error' and value <= 20) then null "
        f"else {EVENT_COLOR} end"
    ),
    "alpha": "case when value > 30 then 0.5 end",
}
SIZE_TEXT = (
    "case when floor(value * 2) % 2 = 0 then cast(cast(floor(value) as bigint) as varchar) "
    "else concat(cast(cast(floor(value) as bigint) as varchar), '.5') end"
)
STYLE_TYPE_COLUMNS = {
    "rel_path": "concat('f', cast(floor(event_id / 50) as bigint), '.css')",
    "line": "cast(event_id % 50 + 1 as int)",
    "context_kind": (
        "case event_type when 'view' then 'css-var-ref' when 'error' then 'tailwind-named' "
        "when 'signup' then 'js-literal' else 'css-decl' end"
    ),
    "axis": (
        "case event_type when 'purchase' then 'family' when 'signup' then 'weight' else 'size' end"
    ),
    "normalized_value": (
        "case event_type when 'purchase' then concat('font', user_id % 9, ', tail', user_id % 4) "
        "when 'signup' then cast(100 * (user_id % 9 + 1) as varchar) "
        f"when 'click' then {SIZE_TEXT} end"
    ),
    "raw_token": (
        "case event_type when 'purchase' then concat('Font', user_id % 9, ', tail', user_id % 4) "
        "when 'signup' then case when user_id % 9 = 3 and value > 10 then 'normal' else "
        "cast(100 * (user_id % 9 + 1) as varchar) end "
        f"when 'click' then concat({SIZE_TEXT}, case when user_id % 3 = 0 then 'px' else '' end) "
        "else 'x' end"
    ),
}


def _spark_sql(text: str) -> str:
    return text.replace(EVENT_COLOR, EVENT_COLOR_SPARK).replace("as varchar)", "as string)")


def style_color(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"{_spark_sql(e)} as {c}" for c, e in STYLE_COLOR_COLUMNS.items()]
    return _view(
        spark, d, "events", one_source("event_id"), "'color' as kind", "cast(null as string) as axis",
        "cast(null as int) as col", "'x' as raw_token", *cols,
    ).withColumn("alpha", F.col("alpha").cast("double"))


def style_type(spark: SparkSession, d: str) -> DataFrame:
    cols = [f"{_spark_sql(e)} as {c}" for c, e in STYLE_TYPE_COLUMNS.items()]
    return _view(
        spark, d, "events", one_source("event_id"), "'type' as kind", "cast(null as double) as alpha",
        "cast(null as int) as col", "cast(null as string) as context_detail", *cols,
    )


def _duck(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {c}" for c, e in columns.items())


STYLE_COLOR = f"style_color AS (SELECT {_duck(STYLE_COLOR_COLUMNS)} FROM events)"
STYLE_TYPE = f"style_type AS (SELECT {_duck(STYLE_TYPE_COLUMNS)} FROM events)"

# --- source text put together from column values -------------------------------------------------

CSS_LINE = f"""case event_type
  when 'click' then concat('.u', user_id, ' {{ color: ', upper({EVENT_COLOR}), '; }}')
  when 'signup' then concat(':root {{ --c', user_id, ': ', {EVENT_COLOR}, '; }}')
  when 'view' then concat('.v {{ background: var(--c', user_id, '); font-size: ', user_id, 'px }}')
  when 'purchase' then concat('.p {{ border: 1px solid Red; font-family: Fam', user_id, ', "Tail"; }}')
  else concat('/* color: ', {EVENT_COLOR}, '; */ .e {{ fill: rgb(1, 2, ', user_id % 256, ') }}') end"""


def code_css(spark: SparkSession, d: str) -> DataFrame:
    """Fifty events make one stylesheet, in event order."""
    lines = _view(
        spark, d, "events", "cast(floor(event_id / 50) as bigint) as file", "event_id",
        f"{_spark_sql(CSS_LINE)} as line",
    )
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]),
        "\n",
    )
    return (
        by_file(lines, "file")
        .groupBy("file")
        .agg(text.alias("text"))
        .selectExpr(
            "1L as source_id", "concat('f', file, '.css') as rel_path",
            "concat('/repo/f', file, '.css') as abs_path", "'css' as ext", "text",
        )
    )


CODE_CSS = f"""css_lines AS (SELECT CAST(floor(event_id / 50) AS BIGINT) AS file, event_id, user_id,
  event_type, {CSS_LINE} AS line, {EVENT_COLOR} AS color FROM events),
css_numbered AS (SELECT *, 'f' || file || '.css' AS rel_path,
  row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY file ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_offset FROM css_lines)"""

HTML_LINE = (
    "case when l_returnflag = 'R' then concat('<!-- <img src=\"/img/', name, '\"> -->') "
    "when l_returnflag = 'N' then concat('<!-- old --> <img src=\"', name, '\">') "
    "else concat('<img src=\"/img/', name, '\">') end"
)


def code_html(spark: SparkSession, d: str) -> DataFrame:
    """One page per order with an image tag per line item."""
    names = assets_part(spark, d).select("asset_id", "name")
    lines = (
        table(spark, d, "lineitem")
        .selectExpr("l_orderkey", "l_linenumber", "l_partkey as asset_id", "l_returnflag",
                    "l_suppkey", "l_extendedprice")
        # parts grow with the lines, so they are not broadcast
        .join(names.hint("merge"), "asset_id")
        .selectExpr("l_orderkey", "l_linenumber", "asset_id", "l_suppkey", "l_extendedprice",
                    f"{HTML_LINE} as line")
    )
    order = F.struct("l_linenumber", "asset_id", "l_suppkey", "l_extendedprice", "line")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["line"]), "\n")
    return (
        by_file(lines, "l_orderkey")
        .groupBy("l_orderkey")
        .agg(text.alias("text"))
        .selectExpr(
            "1L as source_id", "concat('order-', l_orderkey, '.html') as rel_path",
            "concat('/repo/order-', l_orderkey, '.html') as abs_path", "'html' as ext", "text",
        )
    )


CODE_HTML = f"""html_lines AS (SELECT l.l_orderkey, a.name, l.l_returnflag, {HTML_LINE} AS line,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, a.asset_id, l_suppkey,
    l_extendedprice, {HTML_LINE}) AS line_no
  FROM lineitem l JOIN assets_part a ON a.asset_id = l.l_partkey)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
