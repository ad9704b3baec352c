"""Colour, typography, extraction and insight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color as P
from ..functions import typography as T
from ..functions.comments import commented_at, syntax
from ..functions.fingerprint import svg_stats
from ..operators import clusters as K
from ..operators import insights as I
from ..operators.catalog import kind_counts
from ..operators.simjoin import delta_e_pairs, range_pairs
from ..operators.styles import extract_styles, style_files, svg_color_usages
from ..operators.text import code_lines, with_block_state
from ..operators.usages import reference_hits, scan_usages
from .views import (
    ASSETS_PART,
    CODE_CSS,
    CODE_HTML,
    EVENT_COLOR,
    EVENT_COLOR_SPARK,
    STYLE_COLOR,
    STYLE_TYPE,
    assets_doc,
    assets_part,
    by_file,
    code_css,
    code_html,
    style_color,
    style_type,
    table,
    with_views,
)

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


# --- text ----------------------------------------------------------------------------------------


@query(
    "code_lines",
    with_views(
        CODE_CSS,
        body="""SELECT rel_path, CAST(line_no AS INT) AS line_no, line, CAST(line_offset AS BIGINT) AS line_offset
        FROM css_numbered""",
    ),
)
def lines_with_offsets(spark, d):
    return code_lines(code_css(spark, d)).select(
        "rel_path", "line_no", "line", F.col("line_offset").cast("long").alias("line_offset")
    )


BLOCK_LINE = (
    "case role when 'system' then '/* open' when 'assistant' then concat('x ', turn, ' */ tail') "
    "else concat('y ', turn) end"
)


@query(
    "block_comment_state",
    f"""SELECT conv_id, turn, line, coalesce(last_value(CASE WHEN line LIKE '/*%' THEN true
    WHEN line LIKE '%*/%' THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS in_js
    FROM (SELECT conv_id, turn, {BLOCK_LINE} AS line FROM conversations)""",
)
def block_comment_state(spark, d):
    lines = table(spark, d, "conversations").selectExpr(
        "conv_id", "turn", "turn as line_no", f"{BLOCK_LINE} as line"
    )
    return with_block_state(lines, ["conv_id"]).select("conv_id", "turn", "line", "in_js")


COMMENT_LINE = (
    "case event_type when 'click' then concat('a: 1; // ', user_id, ' hit') "
    "when 'view' then concat('\"http://', user_id, '\" hit') "
    "when 'signup' then concat(' * ', user_id, ' hit') "
    "when 'purchase' then concat('/* ', user_id, ' */ hit') "
    "else concat('x /* ', user_id, ' hit') end"
)


@query(
    "commented_positions",
    f"""SELECT event_id, line, event_type NOT IN ('view', 'purchase') AS commented
    FROM (SELECT event_id, event_type, {COMMENT_LINE} AS line FROM events)""",
)
def commented_positions(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", f"{COMMENT_LINE} as line")
    no = F.lit(False)
    at = commented_at(
        F.col("line"), F.instr("line", "hit") - 1, syntax(F.lit("css")), no, no
    )
    return rows.select("event_id", "line", at.alias("commented"))


@query(
    "reference_hits",
    with_views(
        ASSETS_PART, CODE_HTML,
        body="""SELECT 'order-' || l_orderkey || '.html' AS rel_path, CAST(line_no AS INT) AS line,
        CAST(strpos(line, name) - 1 AS INT) AS col, name, l_returnflag = 'R' AS commented, line AS snippet
        FROM html_lines""",
    ),
)
def references(spark, d):
    return reference_hits(code_html(spark, d)).select(
        "rel_path", "line", "col", "name", "commented", "snippet"
    )


@query(
    "asset_usages",
    with_views(
        ASSETS_PART, CODE_HTML,
        """hits AS (SELECT name, 'order-' || l_orderkey || '.html' AS rel_path, line_no,
        l_returnflag = 'R' AS commented FROM html_lines)""",
        body="""SELECT a.asset_id, h.rel_path, CAST(h.line_no AS INT) AS line, h.commented
        FROM assets_part a JOIN hits h USING (name)""",
    ),
)
def asset_usages(spark, d):
    found = scan_usages(code_html(spark, d), assets_part(spark, d))
    return found.select("asset_id", "rel_path", "line", "commented")


@query(
    "style_file_filter",
    r"""SELECT rel_path FROM (SELECT page_id, html, CASE page_id % 5 WHEN 0 THEN 'src/p' || page_id || '.html'
    WHEN 1 THEN 'tests/p' || page_id || '.html' WHEN 2 THEN 'p' || page_id || '.spec.html'
    WHEN 3 THEN 'p' || page_id || '.min.js' ELSE 'p' || page_id || '.md' END AS rel_path FROM pages)
    WHERE page_id % 5 = 0 AND length(html) <= 2000000
    AND NOT list_contains(list_transform(string_split(html, chr(10)), lambda x: length(x) > 50000), true)""",
)
def style_file_filter(spark, d):
    files = table(spark, d, "pages").selectExpr(
        "1L as source_id",
        "case page_id % 5 when 0 then concat('src/p', page_id, '.html') when 1 then "
        "concat('tests/p', page_id, '.html') when 2 then concat('p', page_id, '.spec.html') "
        "when 3 then concat('p', page_id, '.min.js') else concat('p', page_id, '.md') end as rel_path",
        "case page_id % 5 when 3 then 'js' when 4 then 'md' else 'html' end as ext",
        "html as text",
    )
    return style_files(files, max_chars=2_000_000, max_line=50_000).select("rel_path")


HITS = """SELECT rel_path, CAST(line_no AS INT) AS line, CAST(col AS INT) AS col,
  CAST(line_offset + col AS BIGINT) AS start_offset, raw_token, normalized_value, context_kind,
  context_detail{axis} FROM ({parts})"""


def _hit_part(where: str, token: str, value: str, kind: str, detail: str, axis: str = "") -> str:
    return (
        f"SELECT rel_path, line_no, line_offset, strpos(line, {token}) - 1 AS col, {token} AS raw_token, "
        f"{value} AS normalized_value, '{kind}' AS context_kind, {detail} AS context_detail{axis} "
        f"FROM css_numbered WHERE event_type = '{where}'"
    )


RGB = "'rgb(1, 2, ' || user_id % 256 || ')'"
COLOR_PARTS = " UNION ALL ".join(
    [
        _hit_part("click", "upper(color)", "color", "css-decl", "'color'"),
        _hit_part("signup", "color", "color", "css-var-def", "'--c' || user_id"),
        _hit_part("view", "'var(--c' || user_id || ')'", "NULL", "css-var-ref", "'--c' || user_id"),
        _hit_part("purchase", "'Red'", "'#ff0000'", "css-decl", "'border'"),
        _hit_part(
            "error", RGB, "'#0102' || lpad(lower(to_hex(user_id % 256)), 2, '0')", "css-decl", "'fill'"
        ),
    ]
)
TYPE_PARTS = " UNION ALL ".join(
    [
        _hit_part(
            "view", "user_id || 'px'", "CAST(user_id AS VARCHAR)", "css-decl", "'font-size'",
            ", 'size' AS axis",
        ).replace("strpos(line, user_id || 'px') - 1", "strpos(line, 'font-size: ') + 10"),
        _hit_part(
            "purchase", "'Fam' || user_id || ', \"Tail\"'", "'fam' || user_id || ', tail'", "css-decl",
            "'font-family'", ", 'family' AS axis",
        ),
    ]
)
HIT_COLUMNS = [
    "rel_path", "line", "col", "cast(start_offset as bigint) as start_offset", "raw_token",
    "normalized_value", "context_kind", "context_detail",
]


@query("color_extraction", with_views(CODE_CSS, body=HITS.format(axis="", parts=COLOR_PARTS)))
def color_extraction(spark, d):
    return extract_styles(code_css(spark, d), "color").selectExpr(*HIT_COLUMNS)


@query("type_extraction", with_views(CODE_CSS, body=HITS.format(axis=", axis", parts=TYPE_PARTS)))
def type_extraction(spark, d):
    return extract_styles(code_css(spark, d), "type").selectExpr(*HIT_COLUMNS, "axis")


# lines of components: utilities in brackets and by name, literals of scripts and markup, families that
# the guard lets pass or not
PART_LINE = f"""case event_type
  when 'click' then concat('<a className="text-[', upper({EVENT_COLOR}), '] p-4" />')
  when 'purchase' then '<b className="bg-red-500 font-bold text-lg" />'
  when 'signup' then concat('const s = {{ color: ', chr(39), {EVENT_COLOR}, chr(39), ', fontSize: ', user_id % 90, ' }};')
  when 'view' then concat('const f = {{ fontFamily: ', case when user_id % 2 = 0 then concat(chr(39), 'Fam', user_id, chr(39))
    else concat('base', user_id) end, ' }};')
  else concat('<path fill="', {EVENT_COLOR}, '" />') end"""
PART_CODE = f"""part_lines AS (SELECT CAST(floor(event_id / 50) AS BIGINT) AS file, event_id, user_id, event_type,
  {PART_LINE} AS line, {EVENT_COLOR} AS color FROM events),
part_numbered AS (SELECT *, 'f' || file || '.tsx' AS rel_path,
  row_number() OVER (PARTITION BY file ORDER BY event_id) AS line_no,
  coalesce(sum(length(line) + 1) OVER (PARTITION BY file ORDER BY event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_offset FROM part_lines)"""
PART_COLORS = """SELECT *, 14 AS col, 'text-[' || upper(color) || ']' AS raw_token, color AS normalized_value,
  'tailwind-arbitrary' AS context_kind, 'text' AS context_detail FROM part_numbered WHERE event_type = 'click'
  UNION ALL SELECT *, 14, 'bg-red-500', NULL, 'tailwind-named', 'bg' FROM part_numbered WHERE event_type = 'purchase'
  UNION ALL SELECT *, 20, color, color, 'js-literal', NULL FROM part_numbered WHERE event_type = 'signup'
  UNION ALL SELECT *, 12, color, color, 'js-literal', NULL FROM part_numbered
  WHERE event_type NOT IN ('click', 'purchase', 'signup', 'view')"""
PART_TYPES = """SELECT *, 25 AS col, 'font-bold' AS raw_token, NULL AS normalized_value, 'tailwind-named' AS context_kind,
  'font' AS context_detail, 'weight' AS axis FROM part_numbered WHERE event_type = 'purchase'
  UNION ALL SELECT *, 35, 'text-lg', NULL, 'tailwind-named', 'text', 'size' FROM part_numbered WHERE event_type = 'purchase'
  UNION ALL SELECT *, 40, CAST(user_id % 90 AS VARCHAR), CAST(user_id % 90 AS VARCHAR), 'js-literal', 'fontSize', 'size'
  FROM part_numbered WHERE event_type = 'signup'
  UNION ALL SELECT *, 24, chr(39) || 'Fam' || user_id || chr(39), 'fam' || user_id, 'js-literal', 'fontFamily', 'family'
  FROM part_numbered WHERE event_type = 'view' AND user_id % 2 = 0"""


def _components(spark, d):
    """Fifty events make one component file, in event order."""
    line = PART_LINE.replace(EVENT_COLOR, EVENT_COLOR_SPARK)
    lines = table(spark, d, "events").selectExpr(
        "cast(floor(event_id / 50) as bigint) as file", "event_id", f"{line} as line")
    text = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n")
    return by_file(lines, "file").groupBy("file").agg(text.alias("text")).selectExpr(
        "1L as source_id", "concat('f', file, '.tsx') as rel_path", "concat('/repo/f', file, '.tsx') as abs_path",
        "'tsx' as ext", "text")


@query("component_colors", with_views(PART_CODE, body=HITS.format(axis="", parts=PART_COLORS)))
def component_colors(spark, d):
    return extract_styles(_components(spark, d), "color").selectExpr(*HIT_COLUMNS)


@query("component_types", with_views(PART_CODE, body=HITS.format(axis=", axis", parts=PART_TYPES)))
def component_types(spark, d):
    return extract_styles(_components(spark, d), "type").selectExpr(*HIT_COLUMNS, "axis")


SVG_TEXT = (
    "concat('<svg viewBox=\"0 0 ', p_size, ' ', p_size, '\"><path fill=\"', "
    "case when p_size > 25 then 'none' else '#ABC' end, '\" d=\"M0 0L', p_size, ' 1Z\" stroke-width=\"', "
    "p_size % 4, '\"/><path d=\"m1 1h', p_size, '\" style=\"color:rgb(1,', p_size, ', 3)\"/></svg>')"
)


@query(
    "svg_statistics",
    """SELECT p_partkey AS asset_id, '0 0 ' || p_size || ' ' || p_size AS view_box,
    CAST(2 AS INT) AS paths_count, CAST(5 AS INT) AS commands_count, p_size <= 25 AS has_fill,
    CAST(p_size % 4 AS VARCHAR) AS strokes, CASE WHEN p_size > 25 THEN '' ELSE '#abc ' END ||
    'rgb(1,' || p_size || ', 3)' AS colors FROM part""",
)
def svg_statistics(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey as asset_id", f"{SVG_TEXT} as text")
    stats = rows.select("asset_id", svg_stats(F.col("text")).alias("s"))
    return stats.select(
        "asset_id", "s.view_box", "s.paths_count", "s.commands_count", "s.has_fill",
        F.array_join("s.stroke_widths", " ").alias("strokes"),
        F.array_join("s.literal_colors", " ").alias("colors"),
    )


@query(
    "svg_color_occurrences",
    """SELECT color AS normalized_value, count(*) AS n FROM (SELECT '#aabbcc' AS color FROM part
    WHERE p_size <= 25 UNION ALL SELECT '#01' || lpad(lower(to_hex(p_size)), 2, '0') || '03' FROM part)
    GROUP BY color""",
)
def svg_color_occurrences(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "1L as source_id", "p_name as rel_path", "p_name as abs_path", f"{SVG_TEXT} as text"
    )
    assets = rows.withColumn("literal_colors", svg_stats(F.col("text"))["literal_colors"])
    return (
        svg_color_usages(assets).groupBy("normalized_value").agg(F.count("*").alias("n"))
    )


# --- colour and type values ----------------------------------------------------------------------

COLOR_TEXT = (
    "case p_partkey % 6 when 0 then concat('#', lower(right(concat('0', hex(p_size)), 2)), 'FF00') "
    "when 1 then concat('rgb(', p_size, ', 20 ,255)') when 2 then concat('rgba(', p_size, ',0,0,.5)') "
    "when 3 then concat('hsl(', p_size * 7, ', 100%, 50%)') when 4 then 'RebeccaPurple' "
    "else concat('var(--x', p_size, ')') end"
)


@query(
    "normalized_colors",
    """SELECT asset_id, CASE k WHEN 0 THEN '#' || h || 'ff00' WHEN 1 THEN '#' || h || '14ff'
    WHEN 2 THEN '#' || h || '0000' WHEN 3 THEN '#' || lpad(lower(to_hex(r)), 2, '0') ||
    lpad(lower(to_hex(g)), 2, '0') || lpad(lower(to_hex(b)), 2, '0') WHEN 4 THEN '#663399' END AS color,
    CASE k WHEN 2 THEN 0.5::DOUBLE END AS alpha FROM (SELECT p_partkey AS asset_id, p_partkey % 6 AS k,
    lpad(lower(to_hex(p_size)), 2, '0') AS h,
    CAST(floor(255 * CASE WHEN k6 IN (0, 5) THEN 1 WHEN k6 IN (1, 4) THEN mid ELSE 0 END + 0.5) AS BIGINT) AS r,
    CAST(floor(255 * CASE WHEN k6 IN (1, 2) THEN 1 WHEN k6 IN (0, 3) THEN mid ELSE 0 END + 0.5) AS BIGINT) AS g,
    CAST(floor(255 * CASE WHEN k6 IN (3, 4) THEN 1 WHEN k6 IN (2, 5) THEN mid ELSE 0 END + 0.5) AS BIGINT) AS b
    FROM (SELECT *, CAST(floor(p_size * 7 / 60.0) AS INT) AS k6,
    1 - abs(fmod(p_size * 7 / 60.0::DOUBLE, 2) - 1) AS mid FROM part))""",
)
def normalized_colors(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey as asset_id", f"{COLOR_TEXT} as raw")
    return rows.select("asset_id", P.normalize_color("raw").alias("n")).select(
        "asset_id", "n.color", "n.alpha"
    )


LINEAR = (
    "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
)


def _channel(i: int) -> str:
    return LINEAR.format(f"(CAST('0x' || color[{i}:{i + 1}] AS INT) / 255.0)")


def _dot(row) -> str:
    return "(" + " + ".join(f"{k}::DOUBLE * {c}" for k, c in zip(row, "rgb", strict=True)) + ")"


COLORS = f"""used AS (SELECT normalized_value AS color, count(*) AS n FROM style_color
  WHERE normalized_value IS NOT NULL GROUP BY 1),
lin AS (SELECT color, n, {_channel(2)} AS r, {_channel(4)} AS g, {_channel(6)} AS b FROM used),
lms AS (SELECT color, n, {', '.join(f'cbrt({_dot(row)}) AS {c}' for row, c in zip(P.RGB_TO_LMS, ('lo', 'me', 'sh'), strict=True))},
  {', '.join(f'{_dot(row)} / {w}::DOUBLE AS {c}' for row, w, c in zip(P.RGB_TO_XYZ65, P.D65, 'xyz', strict=True))} FROM lin),
bent AS (SELECT color, n, lo, me, sh, {', '.join(f'CASE WHEN {c} > {P.LAB_E} THEN cbrt({c}) ELSE ({P.LAB_K}::DOUBLE * {c} + 16) / 116 END AS f{c}' for c in 'xyz')} FROM lms),
lab AS (SELECT color, n, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS b,
  sqrt(pow({P.LMS_TO_OKLAB[1][0]}::DOUBLE * lo + {P.LMS_TO_OKLAB[1][1]}::DOUBLE * me + {P.LMS_TO_OKLAB[1][2]}::DOUBLE * sh, 2) +
  pow({P.LMS_TO_OKLAB[2][0]}::DOUBLE * lo + {P.LMS_TO_OKLAB[2][1]}::DOUBLE * me + {P.LMS_TO_OKLAB[2][2]}::DOUBLE * sh, 2)) AS chroma FROM bent)"""

_TAIL = "sqrt(pow({0}, 7) / (pow({0}, 7) + 6103515625.0::DOUBLE))"
_HUE = "CASE WHEN {0} = 0 AND {1} = 0 THEN 0 WHEN degrees(atan2({1}, {0})) < 0 THEN degrees(atan2({1}, {0})) + 360 ELSE degrees(atan2({1}, {0})) END"


def delta_steps(left: str, right: str, on: str) -> str:
    """CIEDE2000 between two Lab relations as a chain of relations ending in ``de``."""
    return f"""d1 AS (SELECT p.color AS ca, q.color AS cb, p.n AS na, q.n AS nb, p.l AS l1, q.l AS l2,
  p.b AS b1, q.b AS b2, p.a AS a1, q.a AS a2, (sqrt(p.a * p.a + p.b * p.b) + sqrt(q.a * q.a + q.b * q.b)) / 2 AS cm
  FROM {left} p JOIN {right} q ON {on}),
d2 AS (SELECT *, a1 * (1.5 - 0.5 * {_TAIL.format('cm')}) AS p1, a2 * (1.5 - 0.5 * {_TAIL.format('cm')}) AS p2 FROM d1),
d3 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, {_HUE.format('p1', 'b1')} AS h1,
  {_HUE.format('p2', 'b2')} AS h2 FROM d2),
d4 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180
  THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180
  THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh,
  (c1 + c2) / 2 AS mc, pow((l1 + l2) / 2 - 50, 2) AS ml FROM d3),
d5 AS (SELECT *, 1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6))
  - 0.20 * cos(radians(4 * mh - 63)) AS t FROM d4),
d6 AS (SELECT *, (l2 - l1) / (1 + 0.015 * ml / sqrt(20 + ml)) AS x, (c2 - c1) / (1 + 0.045 * mc) AS y,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * mc * t) AS z,
  -2 * {_TAIL.format('mc')} * sin(radians(60 * exp(-pow((mh - 275) / 25, 2)))) AS r FROM d5),
de AS (SELECT ca, cb, na, nb, sqrt(greatest(x * x + y * y + z * z + r * y * z, 0)) AS d FROM d6)"""


DELTA = delta_steps("lab", "lab", "p.color < q.color")


@query(
    "neutral_colors",
    with_views(
        STYLE_COLOR, COLORS,
        body="SELECT color, round(chroma, 6) AS chroma, chroma < 0.025 AS neutral FROM lab",
    ),
)
def neutral_colors(spark, d):
    colors = K.color_counts(style_color(spark, d)).withColumnRenamed("value", "color")
    return colors.select(
        "color", F.round(P.oklch_chroma("color"), 6).alias("chroma"), P.is_neutral("color").alias("neutral")
    )


@query(
    "near_color_pairs",
    with_views(
        STYLE_COLOR, COLORS, DELTA,
        body="SELECT ca AS color_a, cb AS color_b, round(d, 6) AS delta_e FROM de WHERE d < 9",
    ),
)
def near_color_pairs(spark, d):
    colors = K.color_counts(style_color(spark, d)).withColumnRenamed("value", "color")
    return delta_e_pairs(colors, limit=9.0).withColumn("delta_e", F.round("delta_e", 6))


STAR = """ranked AS (SELECT color, n, row_number() OVER (ORDER BY n DESC, color) AS rk FROM used),
adj AS (SELECT hi.rk AS hi, lo.rk AS lo, d FROM de JOIN ranked x ON x.color = ca JOIN ranked y ON y.color = cb
  JOIN ranked hi ON hi.rk = least(x.rk, y.rk) JOIN ranked lo ON lo.rk = greatest(x.rk, y.rk) WHERE d < 9),
better AS (SELECT rk, coalesce((SELECT list(hi) FROM adj WHERE lo = rk), []) AS above FROM ranked),
picks AS (SELECT 0::BIGINT AS rk, []::BIGINT[] AS anchors UNION ALL SELECT b.rk,
  CASE WHEN list_has_any(b.above, p.anchors) THEN p.anchors ELSE list_append(p.anchors, b.rk) END
  FROM picks p JOIN better b ON b.rk = p.rk + 1),
anchors AS (SELECT unnest(anchors) AS rk FROM (SELECT anchors FROM picks ORDER BY rk DESC LIMIT 1)),
stars AS (SELECT min(hi) AS anchor, lo FROM adj JOIN anchors ON hi = anchors.rk
  WHERE lo NOT IN (SELECT rk FROM anchors) GROUP BY lo),
claims AS (SELECT s.anchor, s.lo, a.d FROM stars s JOIN adj a ON a.hi = s.anchor AND a.lo = s.lo),
heads AS (SELECT anchor, count(*) + 1 AS size, max(d) AS max_distance FROM claims GROUP BY anchor),
members AS (SELECT anchor, lo AS rk, 'variant' AS role, d AS distance FROM claims UNION ALL
  SELECT anchor, anchor, 'canonical', NULL FROM heads),
color_clusters AS (SELECT c.color AS canonical, h.size, round(h.max_distance, 6) AS max_distance,
  l.chroma < 0.025 AS neutral, m.role, v.color AS value, v.n AS usage_count, round(m.distance, 6) AS distance
  FROM members m JOIN heads h USING (anchor) JOIN ranked c ON c.rk = m.anchor JOIN ranked v ON v.rk = m.rk
  JOIN lab l ON l.color = c.color)"""
COLOR_CLUSTERS = [STYLE_COLOR, COLORS, DELTA, STAR]


def _recursive(*views: str, body: str) -> str:
    return with_views(*views, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _color_clusters(spark, d):
    return K.color_clusters(K.color_counts(style_color(spark, d)), limit=9.0)


@query(
    "color_clusters",
    _recursive(*COLOR_CLUSTERS, body="SELECT * FROM color_clusters"),
)
def color_clusters(spark, d):
    return _color_clusters(spark, d).select(
        "canonical", "size", F.round("max_distance", 6).alias("max_distance"), "neutral", "role",
        "value", "usage_count", F.round("distance", 6).alias("distance"),
    )


TYPE_COUNTS = """tc AS (SELECT axis, normalized_value AS value, count(*) AS n FROM style_type
  WHERE normalized_value IS NOT NULL GROUP BY 1, 2)"""
SIZE_STAR = """px AS (SELECT value, n, CAST(value AS DOUBLE) AS px, row_number() OVER (ORDER BY n DESC,
  CAST(value AS DOUBLE)) AS rk FROM tc WHERE axis = 'size'),
sadj AS (SELECT a.rk AS hi, b.rk AS lo, round(abs(a.px - b.px), 3) AS d FROM px a JOIN px b
  ON b.n < a.n AND abs(a.px - b.px) < 1),
sbetter AS (SELECT rk, coalesce((SELECT list(hi) FROM sadj WHERE lo = rk), []) AS above FROM px),
spicks AS (SELECT 0::BIGINT AS rk, []::BIGINT[] AS anchors UNION ALL SELECT b.rk,
  CASE WHEN list_has_any(b.above, p.anchors) THEN p.anchors ELSE list_append(p.anchors, b.rk) END
  FROM spicks p JOIN sbetter b ON b.rk = p.rk + 1),
sanchors AS (SELECT unnest(anchors) AS rk FROM (SELECT anchors FROM spicks ORDER BY rk DESC LIMIT 1)),
sstars AS (SELECT min(hi) AS anchor, lo FROM sadj JOIN sanchors ON hi = sanchors.rk GROUP BY lo),
sclaims AS (SELECT s.anchor, s.lo, a.d FROM sstars s JOIN sadj a ON a.hi = s.anchor AND a.lo = s.lo),
sheads AS (SELECT anchor, count(*) + 1 AS size, max(d) AS max_distance FROM sclaims GROUP BY anchor),
smembers AS (SELECT anchor, lo AS rk, 'variant' AS role, d AS distance FROM sclaims UNION ALL
  SELECT anchor, anchor, 'canonical', NULL FROM sheads),
size_clusters AS (SELECT 'size:' || c.value AS key, c.value AS canonical, h.size, h.max_distance, m.role,
  v.value, v.n AS usage_count, m.distance FROM smembers m JOIN sheads h USING (anchor)
  JOIN px c ON c.rk = m.anchor JOIN px v ON v.rk = m.rk)"""
FAMILY = """fam AS (SELECT value, n, split_part(value, ',', 1) AS first,
  count(*) OVER (PARTITION BY split_part(value, ',', 1)) AS size,
  row_number() OVER (PARTITION BY split_part(value, ',', 1) ORDER BY n DESC, value) AS pos
  FROM tc WHERE axis = 'family'),
family_clusters AS (SELECT 'family:' || first AS key, (SELECT f.value FROM fam f WHERE f.first = fam.first
  AND f.pos = 1) AS canonical, size, CASE WHEN pos = 1 THEN 'canonical' ELSE 'variant' END AS role, value,
  n AS usage_count FROM fam WHERE size >= 2)"""


@query(
    "near_size_pairs",
    with_views(
        STYLE_TYPE, TYPE_COUNTS,
        body="""SELECT a.value AS hi, b.value AS lo FROM tc a JOIN tc b ON a.axis = 'size' AND b.axis = 'size'
        AND b.n < a.n AND abs(CAST(a.value AS DOUBLE) - CAST(b.value AS DOUBLE)) < 1""",
    ),
)
def near_size_pairs(spark, d):
    sizes = K.type_counts(style_type(spark, d)).filter("axis = 'size'")
    return range_pairs(sizes.withColumn("px", F.col("value").cast("double"))).select("hi", "lo")


CLUSTER_COLUMNS = ["key", "canonical", "size", "role", "value", "usage_count"]


@query(
    "size_clusters",
    _recursive(STYLE_TYPE, TYPE_COUNTS, SIZE_STAR, body="SELECT * FROM size_clusters"),
)
def size_clusters(spark, d):
    found = K.size_clusters(K.type_counts(style_type(spark, d)))
    return found.select(*CLUSTER_COLUMNS, "max_distance", "distance")


@query(
    "family_clusters",
    with_views(STYLE_TYPE, TYPE_COUNTS, FAMILY, body="SELECT * FROM family_clusters"),
)
def family_clusters(spark, d):
    return K.family_clusters(K.type_counts(style_type(spark, d))).select(*CLUSTER_COLUMNS)


@query(
    "typography_clusters",
    _recursive(
        STYLE_TYPE, TYPE_COUNTS, SIZE_STAR, FAMILY,
        body="""SELECT key, role, value, usage_count FROM size_clusters UNION ALL
        SELECT key, role, value, usage_count FROM family_clusters""",
    ),
)
def typography_clusters(spark, d):
    found = K.typography_clusters(K.type_counts(style_type(spark, d)))
    return found.select("key", "role", "value", "usage_count")


TYPE_RAW = (
    "case p_partkey % 7 when 0 then concat(p_size, 'px') when 1 then concat(p_size / 2.0, 'rem') "
    "when 2 then concat(p_size, '%') when 3 then 'Bold' when 4 then concat(p_size * 100, '') "
    "when 5 then concat(p_size, 'px') else concat('\"Fam ', p_size, '\" , SERIF,') end"
)
TYPE_AXIS = (
    "case p_partkey % 7 when 0 then 'size' when 1 then 'size' when 2 then 'size' when 3 then 'weight' "
    "when 4 then 'weight' when 5 then 'line-height' else 'family' end"
)


@query(
    "normalized_types",
    """SELECT p_partkey AS asset_id, CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR)
    WHEN 1 THEN CAST(p_size * 8 AS VARCHAR) WHEN 3 THEN '700' WHEN 4 THEN CASE WHEN p_size <= 10 THEN
    CAST(p_size * 100 AS VARCHAR) END WHEN 5 THEN p_size || 'px' WHEN 6 THEN 'fam ' || p_size || ', serif'
    END AS value FROM part""",
)
def normalized_types(spark, d):
    rows = table(spark, d, "part").selectExpr(
        "p_partkey as asset_id", f"{TYPE_RAW} as raw", f"{TYPE_AXIS} as axis"
    )
    return rows.select("asset_id", T.normalize_type(F.col("axis"), F.col("raw")).alias("value"))


# --- typography insights -------------------------------------------------------------------------

TYPE_STATS = """lit AS (SELECT * FROM style_type WHERE context_kind IN ('css-decl', 'js-literal')
  AND normalized_value IS NOT NULL),
raws AS (SELECT axis, normalized_value AS value, raw_token, count(*) AS n FROM lit GROUP BY 1, 2, 3),
type_stats AS (SELECT axis, value, usage_count, file_count, spelling_count, spellings FROM
  (SELECT axis, normalized_value AS value, count(*) AS usage_count, count(DISTINCT rel_path) AS file_count
  FROM lit GROUP BY 1, 2) JOIN (SELECT axis, value, count(*) AS spelling_count,
  string_agg(raw_token || '=' || n, ';' ORDER BY n DESC, raw_token) AS spellings FROM raws GROUP BY 1, 2)
  USING (axis, value))"""
SPELLINGS = "array_join(transform(spellings, s -> concat(s.raw, '=', s.n)), ';') as spellings"


@query("type_stats", with_views(STYLE_TYPE, TYPE_STATS, body="SELECT * FROM type_stats"))
def type_stats(spark, d):
    return I.type_stats(style_type(spark, d)).selectExpr(
        "axis", "value", "usage_count", "file_count", "spelling_count", SPELLINGS
    )


@query(
    "type_coverage",
    with_views(
        STYLE_TYPE,
        body="""SELECT tokenized, literal, not_scored, round(tokenized / (tokenized + literal), 6) AS pct FROM
        (SELECT count(*) FILTER (context_kind = 'css-var-ref') AS tokenized,
        count(*) FILTER (context_kind IN ('css-decl', 'js-literal')) AS literal,
        count(*) FILTER (context_kind = 'tailwind-named') AS not_scored FROM style_type)""",
    ),
)
def type_coverage(spark, d):
    found = I.type_coverage(style_type(spark, d)).drop("source_id")
    return found.withColumn("pct", F.round("pct", 6))


@query(
    "type_scale",
    with_views(
        STYLE_TYPE, TYPE_STATS,
        body="""SELECT axis, value, usage_count, CAST(row_number() OVER (PARTITION BY axis ORDER BY
        CASE WHEN axis IN ('size', 'weight') THEN CAST(value AS DOUBLE) END,
        CASE WHEN axis NOT IN ('size', 'weight') THEN -usage_count END, value) AS INT) AS position
        FROM type_stats""".replace("CAST(value AS DOUBLE)", "try_cast(value AS DOUBLE)"),
    ),
)
def type_scale(spark, d):
    return I.type_scale(I.type_stats(style_type(spark, d))).select(
        "axis", "value", "usage_count", "position"
    )


@query(
    "mixed_spellings",
    with_views(
        STYLE_TYPE, TYPE_STATS,
        body="SELECT axis, value, usage_count, spellings FROM type_stats WHERE spelling_count > 1",
    ),
)
def mixed_spellings(spark, d):
    found = I.mixed_spellings(I.type_stats(style_type(spark, d)))
    return found.selectExpr("axis", "value", "usage_count", SPELLINGS)


@query(
    "type_drift",
    _recursive(
        STYLE_TYPE, TYPE_COUNTS, SIZE_STAR, FAMILY,
        """drift AS (SELECT key, canonical, max_distance, role, value, usage_count, distance, 'size' AS axis
        FROM size_clusters UNION ALL SELECT key, canonical, NULL, role, value, usage_count, NULL, 'family'
        FROM family_clusters),
        found AS (SELECT key, ln(1 + sum(usage_count) FILTER (role = 'canonical')) *
        ln(1 + sum(usage_count) FILTER (role = 'variant') + count(*) FILTER (role = 'variant')) /
        (0.5 + coalesce(max(max_distance), 0)) AS suspicion FROM drift GROUP BY key),
        spots AS (SELECT axis, normalized_value AS value, rel_path AS file, line FROM style_type WHERE
        normalized_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY axis, normalized_value
        ORDER BY rel_path, line) = 1)""",
        body="""SELECT axis, key, canonical, round(suspicion, 6) AS suspicion, value AS variant,
        usage_count AS usage, distance, file, line FROM drift JOIN found USING (key)
        LEFT JOIN spots USING (axis, value) WHERE role = 'variant'""",
    ),
)
def type_drift(spark, d):
    styles = style_type(spark, d)
    found = I.type_drift(K.typography_clusters(K.type_counts(styles)), styles)
    return found.select(
        "axis", "key", "canonical", F.round("suspicion", 6).alias("suspicion"), "variant", "usage",
        "distance", "file", "line",
    )


# --- colour insights -----------------------------------------------------------------------------

VARS = """vars AS (SELECT context_detail AS var, arg_min(normalized_value, normalized_value) AS color,
  count(*) AS def_count FROM style_color WHERE context_kind = 'css-var-def' GROUP BY 1),
refs AS (SELECT context_detail AS var, rel_path FROM style_color WHERE context_kind = 'css-var-ref'),
var_table AS (SELECT v.var, v.color, v.def_count, (SELECT count(*) FROM refs r WHERE r.var = v.var)
  AS ref_count FROM vars v)"""
COLOR_STATS = """uses AS (SELECT normalized_value AS color, rel_path, context_kind,
  (CASE context_kind WHEN 'css-var-def' THEN 1.0 WHEN 'css-decl' THEN CASE WHEN context_detail = 'color'
  THEN 1.0 ELSE 0.3 END WHEN 'tailwind-arbitrary' THEN 1.0 ELSE 0.5 END) *
  (CASE WHEN alpha < 1 THEN 0.4 ELSE 1.0 END) AS w, alpha IS NULL OR alpha >= 1 AS opaque
  FROM style_color WHERE normalized_value IS NOT NULL UNION ALL
  SELECT v.color, r.rel_path, 'css-var-ref', 0.8, true FROM refs r JOIN vars v USING (var)),
color_stats AS (SELECT color, count(*) AS usage_count, count(DISTINCT rel_path) AS file_count,
  sum(w::DOUBLE) AS weighted_usage, count(*) FILTER (opaque) AS opaque_count,
  count(*) FILTER (context_kind = 'css-decl') AS css_decl,
  count(*) FILTER (context_kind = 'css-var-ref') AS css_var_ref,
  ln(1 + sum(w::DOUBLE)) * count(DISTINCT rel_path) AS brand_score FROM uses GROUP BY color)"""


@query("color_variables", with_views(STYLE_COLOR, VARS, body="SELECT * FROM var_table"))
def color_variables(spark, d):
    return I.var_table(style_color(spark, d)).select("var", "color", "def_count", "ref_count")


@query(
    "color_stats",
    with_views(
        STYLE_COLOR, VARS, COLOR_STATS,
        body="""SELECT color, usage_count, file_count, round(weighted_usage, 6) AS weighted_usage,
        opaque_count, css_decl, css_var_ref, round(brand_score, 5) AS brand_score FROM color_stats""",
    ),
)
def color_stats(spark, d):
    return I.color_stats(style_color(spark, d)).select(
        "color", "usage_count", "file_count", F.round("weighted_usage", 6).alias("weighted_usage"),
        "opaque_count", "css_decl", "css_var_ref", F.round("brand_score", 5).alias("brand_score"),
    )


@query(
    "color_coverage",
    with_views(
        STYLE_COLOR, VARS,
        body="""SELECT *, round(tokenized / (tokenized + literal), 6) AS pct FROM (SELECT
        count(*) FILTER (context_kind IN ('css-decl', 'js-literal', 'svg-attr', 'tailwind-arbitrary'))
        AS literal, count(*) FILTER (context_kind = 'css-var-def') AS definitions,
        count(*) FILTER (context_kind = 'tailwind-named') AS not_scored,
        count(*) FILTER (context_kind = 'css-var-ref' AND context_detail IN (SELECT var FROM vars)) AS tokenized,
        count(*) FILTER (context_kind = 'css-var-ref' AND context_detail NOT IN (SELECT var FROM vars))
        AS unresolved_vars FROM style_color)""",
    ),
)
def color_coverage(spark, d):
    found = I.color_coverage(style_color(spark, d)).drop("source_id")
    return found.withColumn("pct", F.round("pct", 6))


@query(
    "palette",
    with_views(
        STYLE_COLOR, VARS, COLOR_STATS,
        body="""SELECT color, usage_count, CAST(row_number() OVER (ORDER BY brand_score DESC, color) AS INT)
        AS rank FROM color_stats QUALIFY rank <= 12""",
    ),
)
def palette(spark, d):
    return I.palette(I.color_stats(style_color(spark, d))).select("color", "usage_count", "rank")


@query(
    "most_used_colors",
    with_views(
        STYLE_COLOR, VARS, COLOR_STATS,
        body="SELECT color, usage_count FROM color_stats ORDER BY usage_count DESC, color LIMIT 12",
    ),
)
def most_used_colors(spark, d):
    return I.most_used(I.color_stats(style_color(spark, d))).select("color", "usage_count")


ONE_OFF = STYLE_COLOR.replace(
    "FROM events", "FROM (SELECT event_id, event_id AS user_id, event_type, value FROM events)"
)


def _spread_colors(spark, d):
    """Style occurrences with a colour per event, so that rare colours exist."""
    from .views import STYLE_COLOR_COLUMNS, _spark_sql

    events = table(spark, d, "events").selectExpr(
        "event_id", "event_id as user_id", "event_type", "value"
    )
    cols = [f"{_spark_sql(e)} as {c}" for c, e in STYLE_COLOR_COLUMNS.items()]
    return events.selectExpr("1L as source_id", "'color' as kind", *cols)


@query(
    "one_off_colors",
    with_views(
        ONE_OFF, VARS, COLOR_STATS, body="SELECT color FROM color_stats WHERE usage_count = 1"
    ),
)
def one_off_colors(spark, d):
    return I.one_offs(I.color_stats(_spread_colors(spark, d))).select("color")


DRIFT = """found AS (SELECT canonical, bool_or(neutral) AS neutral, ln(1 + sum(usage_count)
  FILTER (role = 'canonical')) * ln(1 + sum(usage_count) FILTER (role = 'variant') + count(*)
  FILTER (role = 'variant')) / (0.5 + max(max_distance)) * CASE WHEN bool_or(neutral) THEN 0.1 ELSE 1 END
  AS suspicion FROM color_clusters GROUP BY canonical),
tokens AS (SELECT color, arg_min(var, (-ref_count, var)) AS token FROM var_table GROUP BY color),
spots AS (SELECT normalized_value AS value, rel_path AS file, line FROM style_color
  WHERE normalized_value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY normalized_value ORDER BY
  context_kind = 'css-var-def', rel_path, line) = 1),
drift AS (SELECT c.canonical, f.neutral, f.suspicion, coalesce(t.token, c.canonical) AS suggested_token,
  c.value AS variant, c.usage_count AS usage, s.file, s.line FROM color_clusters c JOIN found f USING (canonical)
  LEFT JOIN tokens t ON t.color = c.canonical LEFT JOIN spots s ON s.value = c.value WHERE role = 'variant')"""
DRIFT_VIEWS = [*COLOR_CLUSTERS, VARS, DRIFT]
DRIFT_SELECT = """SELECT canonical, neutral, round(suspicion, 5) AS suspicion, suggested_token, variant, usage,
  file, line FROM drift"""


def _color_drift(spark, d):
    styles = style_color(spark, d)
    return I.color_drift(K.color_clusters(K.color_counts(styles), limit=9.0), styles)


def _drift_columns(found):
    return found.select(
        "canonical", "neutral", F.round("suspicion", 5).alias("suspicion"), "suggested_token", "variant",
        "usage", "file", "line",
    )


@query("color_drift", _recursive(*DRIFT_VIEWS, body=DRIFT_SELECT))
def color_drift(spark, d):
    return _drift_columns(_color_drift(spark, d))


@query(
    "drift_list",
    _recursive(
        *DRIFT_VIEWS,
        body=DRIFT_SELECT + """ WHERE canonical IN (SELECT canonical FROM found
        ORDER BY neutral, suspicion DESC, canonical LIMIT 5)""",
    ),
)
def drift_list(spark, d):
    return _drift_columns(I.drift_list(_color_drift(spark, d), "color", 5))


@query(
    "drift_in_changed_files",
    _recursive(
        *DRIFT_VIEWS,
        body=DRIFT_SELECT + """ WHERE canonical IN (SELECT canonical FROM drift WHERE file IN
        (SELECT 'f' || doc_id || '.css' FROM labels))""",
    ),
)
def drift_in_changed_files(spark, d):
    changed = table(spark, d, "labels").selectExpr("concat('f', doc_id, '.css') as path")
    return _drift_columns(I.drift_list(_color_drift(spark, d), "color", 100, changed))


@query(
    "style_kind_counts",
    with_views(
        STYLE_COLOR, STYLE_TYPE,
        body="""SELECT 'color' AS kind, count(*) AS n FROM style_color UNION ALL
        SELECT 'type', count(*) FROM style_type""",
    ),
)
def style_kind_counts(spark, d):
    cols = ["source_id", "kind"]
    rows = style_color(spark, d).select(*cols).unionByName(style_type(spark, d).select(*cols))
    return kind_counts(rows).drop("source_id")


WANTED = """wanted AS (SELECT DISTINCT '#' || upper(substr(md5(p_name), 1, 6)) AS raw,
  '#' || substr(md5(p_name), 1, 6) AS color FROM part)"""
WANT_LAB = COLORS.replace("used AS", "used2 AS").replace("lin AS", "lin2 AS").replace(
    "lms AS", "lms2 AS").replace("bent AS", "bent2 AS").replace("lab AS", "lab2 AS")
WANT_LAB = (
    WANT_LAB.replace("FROM used)", "FROM used2)").replace("FROM lin)", "FROM lin2)")
    .replace("FROM lms)", "FROM lms2)").replace("FROM bent)", "FROM bent2)")
)
WANT_LAB = "used2 AS (SELECT color, 1 AS n FROM wanted)," + WANT_LAB[WANT_LAB.index("\nlin2 AS"):]


@query(
    "nearest_tokens",
    with_views(
        STYLE_COLOR, COLORS, VARS, WANTED, WANT_LAB, delta_steps("lab2", "lab", "true"),
        """tokens AS (SELECT color, arg_min(var, (-ref_count, var)) AS token FROM var_table GROUP BY color)""",
        body="""SELECT ca AS value, cb AS nearest, token, round(d, 6) AS delta_e, d < 6 AS within FROM de
        LEFT JOIN tokens t ON t.color = cb
        QUALIFY row_number() OVER (PARTITION BY ca ORDER BY d, token IS NULL, cb) = 1""",
    ),
)
def nearest_tokens(spark, d):
    values = table(spark, d, "part").selectExpr(
        "1L as source_id", "concat('#', substring(md5(p_name), 1, 6)) as value"
    )
    found = I.resolve_tokens(values, I.token_candidates(style_color(spark, d)))
    return found.select(
        "value", "nearest", "token", F.round("delta_e", 6).alias("delta_e"), "within"
    )


@query(
    "context_digest",
    with_views(
        STYLE_COLOR, VARS, COLOR_STATS, STYLE_TYPE, TYPE_STATS,
        body="""SELECT concat_ws(chr(10), '## Brand palette', (SELECT string_agg(color || ' ×' || usage_count, ' · '
        ORDER BY brand_score DESC, color) FROM (SELECT * FROM color_stats ORDER BY brand_score DESC, color LIMIT 12)),
        '', '## Type scale', 'sizes: ' || (SELECT string_agg(value, ' · ' ORDER BY try_cast(value AS DOUBLE))
        FROM type_stats WHERE axis = 'size'), 'families: ' || (SELECT string_agg(value || ' ×' || usage_count, ' · '
        ORDER BY usage_count DESC, value) FROM type_stats WHERE axis = 'family'), 'weights: ' ||
        (SELECT string_agg(value, ' · ' ORDER BY try_cast(value AS DOUBLE)) FROM type_stats WHERE axis = 'weight'),
        '', '## Tokenization', 'color coverage ' || (SELECT CAST(round(100 * count(*) FILTER (context_kind =
        'css-var-ref' AND context_detail IN (SELECT var FROM vars)) / (count(*) FILTER (context_kind = 'css-var-ref'
        AND context_detail IN (SELECT var FROM vars)) + count(*) FILTER (context_kind IN ('css-decl', 'js-literal',
        'svg-attr', 'tailwind-arbitrary')))) AS BIGINT) FROM style_color) || '% · type coverage ' ||
        (SELECT CAST(round(100 * count(*) FILTER (context_kind = 'css-var-ref') / count(*) FILTER (context_kind
        IN ('css-var-ref', 'css-decl', 'js-literal'))) AS BIGINT) FROM style_type) || '%',
        'canonical asset dirs: ' || (SELECT string_agg(dir, ', ' ORDER BY n DESC, dir) FROM (SELECT
        source || '/' || lang AS dir, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, dir LIMIT 3))) AS digest""",
    ),
)
def context_digest(spark, d):
    styles = style_color(spark, d).unionByName(style_type(spark, d), allowMissingColumns=True)
    return I.context_digest(assets_doc(spark, d), styles).select("digest")
