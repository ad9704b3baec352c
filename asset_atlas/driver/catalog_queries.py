"""Catalogue, duplicate, folder, name and search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.fingerprint import popcount
from ..operators import catalog as C
from ..operators import clusters as K
from ..operators import search as S
from ..operators.match import first_per
from ..operators.simjoin import jaccard_join
from ..operators.usages import unused_assets, with_usage_count
from ..session import new_folder
from .views import (
    ASSETS_DOC,
    ASSETS_PART,
    ASSETS_VEC,
    USAGES_LAB,
    USAGES_LI,
    assets_doc,
    assets_part,
    assets_vec,
    table,
    usages_lab,
    usages_li,
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


HASH = """hash_members AS (SELECT source_id, asset_id, content_hash AS key, name, rel_path, ext, size,
  count(*) OVER (PARTITION BY content_hash) AS group_size,
  row_number() OVER (PARTITION BY content_hash ORDER BY rel_path, asset_id) AS pos FROM {assets}),
hash_dups AS (SELECT *, CASE WHEN pos = 1 THEN 'canonical' ELSE 'member' END AS role,
  first_value(size) OVER (PARTITION BY key ORDER BY pos) AS per_file_size,
  first_value(asset_id) OVER (PARTITION BY key ORDER BY pos) AS canonical_id
  FROM hash_members WHERE group_size >= 2)"""
HASH_DOC = HASH.format(assets="assets_doc")
HASH_PART = HASH.format(assets="assets_part")
STRIP = "|".join(N.STYLE_SUFFIXES)
# without a lookahead a pass skips every second suffix, so the twin repeats the pass
CANON_SQL = "regexp_replace(lower({0}), '^(ic|icon)-', '')"
for _ in range(6):
    CANON_SQL = f"regexp_replace({CANON_SQL}, '-(?:{STRIP})(-|$)', '\\1', 'g')"
CANON_SQL = f"coalesce(nullif({CANON_SQL}, ''), lower({{0}}))"
NAME_PART = f"""named AS (SELECT *, {CANON_SQL.format('stem')} AS key FROM assets_part),
name_members AS (SELECT *, count(*) OVER (PARTITION BY key) AS group_size,
  row_number() OVER (PARTITION BY key ORDER BY length(stem), stem, asset_id) AS pos FROM named),
name_groups AS (SELECT *, CASE WHEN pos = 1 THEN 'canonical' ELSE 'member' END AS role
  FROM name_members WHERE group_size >= 2)"""


def _part_usage(spark, d):
    return with_usage_count(assets_part(spark, d), usages_li(spark, d))


@query(
    "exact_duplicate_report",
    with_views(
        ASSETS_DOC, USAGES_LAB, HASH_DOC,
        body="""SELECT key, asset_id, role, name, rel_path, size, canonical_id, group_size, per_file_size,
        per_file_size * (group_size - 1) AS reclaimable_bytes, coalesce(n, 0) AS usage_count
        FROM hash_dups LEFT JOIN (SELECT asset_id, count(*) AS n FROM usages_lab GROUP BY 1) u
        USING (asset_id)""",
    ),
)
def exact_duplicate_report(spark, d):
    a = assets_doc(spark, d)
    report = C.exact_duplicates(K.hash_clusters(a), a, usages_lab(spark, d))
    return report.select(
        "key", "asset_id", "role", "name", "rel_path", "size", "canonical_id", "group_size",
        "per_file_size", "reclaimable_bytes", "usage_count",
    )


@query(
    "exact_duplicate_totals",
    with_views(
        ASSETS_PART, HASH_PART,
        body="""SELECT count(*) AS total_groups, CAST(sum(group_size) AS BIGINT) AS total_files,
        CAST(sum(per_file_size * (group_size - 1)) AS BIGINT) AS reclaimable_bytes
        FROM hash_dups WHERE pos = 1""",
    ),
)
def exact_duplicate_totals(spark, d):
    a = assets_part(spark, d)
    report = C.exact_duplicates(K.hash_clusters(a), a, usages_li(spark, d))
    return C.exact_duplicate_totals(report).drop("source_id")


@query(
    "hash_cluster_members",
    with_views(ASSETS_PART, HASH_PART, body="SELECT key, asset_id, role, group_size AS size FROM hash_dups"),
)
def hash_cluster_members(spark, d):
    return K.hash_clusters(assets_part(spark, d)).select("key", "asset_id", "role", "size")


@query(
    "name_cluster_members",
    with_views(
        ASSETS_PART, NAME_PART, body="SELECT key, asset_id, role, group_size AS size FROM name_groups"
    ),
)
def name_cluster_members(spark, d):
    return K.name_clusters(assets_part(spark, d)).select("key", "asset_id", "role", "size")


@query(
    "canonical_stems",
    with_views(
        ASSETS_PART,
        body=f"""SELECT stem, {CANON_SQL.format('stem')} AS canonical, count(*) AS n FROM (
        SELECT 'ic-' || stem || '-filled' AS stem FROM assets_part UNION ALL
        SELECT stem || '-outline-sm' FROM assets_part UNION ALL SELECT stem FROM assets_part)
        GROUP BY 1, 2""",
    ),
)
def canonical_stems(spark, d):
    stems = assets_part(spark, d).select(
        F.explode(
            F.array(
                F.concat(F.lit("ic-"), "stem", F.lit("-filled")),
                F.concat("stem", F.lit("-outline-sm")),
                F.col("stem"),
            )
        ).alias("stem")
    )
    return stems.groupBy("stem", N.canonical_stem(F.col("stem")).alias("canonical")).agg(
        F.count("*").alias("n")
    )


@query(
    "name_groups_page_by_size",
    with_views(
        ASSETS_PART, USAGES_LI, NAME_PART,
        body="""SELECT key, group_size, asset_id, role, stem, width, mtime, coalesce(n, 0) AS usage_count
        FROM name_groups LEFT JOIN (SELECT asset_id, count(*) AS n FROM usages_li GROUP BY 1) u
        USING (asset_id) WHERE key IN (SELECT key FROM name_groups WHERE pos = 1
        ORDER BY group_size DESC, key LIMIT 20 OFFSET 5)""",
    ),
)
def name_groups_page_by_size(spark, d):
    a = assets_part(spark, d)
    page = C.name_groups_page(K.name_clusters(a), a, usages_li(spark, d), "size", 20, 5)
    return page.select("key", "group_size", "asset_id", "role", "stem", "width", "mtime", "usage_count")


@query(
    "name_groups_page_in_folder",
    with_views(
        ASSETS_PART, USAGES_LI, NAME_PART,
        body="""SELECT key, group_size, asset_id, role, coalesce(n, 0) AS usage_count
        FROM name_groups LEFT JOIN (SELECT asset_id, count(*) AS n FROM usages_li GROUP BY 1) u
        USING (asset_id) WHERE key IN (SELECT DISTINCT key FROM name_groups
        WHERE dir = 'promo' OR dir LIKE 'promo/%' ORDER BY key LIMIT 25)""",
    ),
)
def name_groups_page_in_folder(spark, d):
    a = assets_part(spark, d)
    page = C.name_groups_page(
        K.name_clusters(a), a, usages_li(spark, d), "alpha", 25, folder="promo"
    )
    return page.select("key", "group_size", "asset_id", "role", "usage_count")


@query(
    "name_group_totals",
    with_views(
        ASSETS_PART, NAME_PART,
        body="""SELECT count(DISTINCT key) AS total, count(*) AS total_variants FROM name_groups
        WHERE key IN (SELECT key FROM name_groups WHERE dir LIKE 'small/%')""",
    ),
)
def name_group_totals(spark, d):
    a = assets_part(spark, d)
    return C.name_group_totals(K.name_clusters(a), a, "small").drop("source_id")


@query(
    "hash_clusters_in_folder",
    with_views(
        ASSETS_DOC, HASH_DOC,
        body="""SELECT key, asset_id, role FROM hash_dups WHERE key IN
        (SELECT key FROM hash_dups WHERE rel_path LIKE 'src1/%')""",
    ),
)
def hash_clusters_in_folder(spark, d):
    a = assets_doc(spark, d)
    return C.clusters_touching(K.hash_clusters(a), a, "src1").select("key", "asset_id", "role")


@query(
    "overview_counts",
    with_views(
        ASSETS_PART, USAGES_LI, HASH_PART, NAME_PART,
        body="""SELECT (SELECT count(*) FROM assets_part) AS total_assets,
        (SELECT CAST(sum(size) AS BIGINT) FROM assets_part) AS total_bytes,
        (SELECT count(DISTINCT ext) FROM assets_part) AS extensions,
        (SELECT count(*) FROM hash_dups WHERE pos = 1) AS duplicate_groups,
        (SELECT count(*) FROM name_groups WHERE pos = 1) AS name_clusters,
        CAST(0 AS BIGINT) AS near_clusters,
        (SELECT CAST(sum(per_file_size * (group_size - 1)) AS BIGINT) FROM hash_dups WHERE pos = 1)
          AS reclaimable_bytes,
        (SELECT count(*) FROM assets_part WHERE asset_id NOT IN (SELECT asset_id FROM usages_li))
          AS unused_assets,
        (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM assets_part WHERE asset_id NOT IN
          (SELECT asset_id FROM usages_li)) AS unused_bytes""",
    ),
)
def overview_counts(spark, d):
    a = assets_part(spark, d)
    clusters = K.hash_clusters(a).unionByName(K.name_clusters(a))
    return C.overview(a, usages_li(spark, d), clusters).drop("source_id")


@query(
    "unused_assets",
    with_views(
        ASSETS_DOC, USAGES_LAB,
        body="""SELECT asset_id, rel_path, size FROM assets_doc
        WHERE asset_id NOT IN (SELECT asset_id FROM usages_lab)""",
    ),
)
def unused(spark, d):
    return unused_assets(assets_doc(spark, d), usages_lab(spark, d)).select(
        "asset_id", "rel_path", "size"
    )


@query(
    "usage_counts",
    with_views(
        ASSETS_PART, USAGES_LI,
        body="""SELECT asset_id, name, coalesce(n, 0) AS usage_count FROM assets_part LEFT JOIN
        (SELECT asset_id, count(*) AS n FROM usages_li GROUP BY 1) u USING (asset_id)""",
    ),
)
def usage_count_per_asset(spark, d):
    return _part_usage(spark, d).select("asset_id", "name", "usage_count")


@query(
    "folder_distribution",
    with_views(ASSETS_PART, body="SELECT dir, count(*) AS n FROM assets_part GROUP BY dir"),
)
def folder_distribution(spark, d):
    return C.folder_distribution(assets_part(spark, d)).drop("source_id")


@query(
    "folder_tree",
    with_views(
        ASSETS_PART,
        body="""SELECT path, count(*) AS n, CAST(CASE WHEN path = '' THEN 0 ELSE
        length(path) - length(replace(path, '/', '')) + 1 END AS INT) AS depth FROM (
        SELECT '' AS path FROM assets_part UNION ALL SELECT split_part(dir, '/', 1) FROM assets_part
        UNION ALL SELECT split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) FROM assets_part
        UNION ALL SELECT dir FROM assets_part) GROUP BY path""",
    ),
)
def folder_tree(spark, d):
    return C.folder_tree(assets_part(spark, d)).drop("source_id")


@query(
    "leaf_suggestions",
    with_views(
        ASSETS_PART,
        body="""SELECT dir, count(*) AS n FROM assets_part WHERE dir LIKE 'large/%' GROUP BY dir
        ORDER BY n DESC, dir LIMIT 12""",
    ),
)
def leaf_suggestions(spark, d):
    return C.leaf_suggestions(assets_part(spark, d), "large").drop("source_id")


@query(
    "top_asset_dirs",
    with_views(
        ASSETS_DOC,
        body="SELECT dir, count(*) AS n FROM assets_doc GROUP BY dir ORDER BY n DESC, dir LIMIT 3",
    ),
)
def top_asset_dirs(spark, d):
    return C.top_asset_dirs(assets_doc(spark, d)).select("dir", "n")


@query(
    "asset_totals",
    "SELECT count(*) AS assets, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents",
)
def asset_totals(spark, d):
    return C.asset_totals(assets_doc(spark, d)).drop("source_id")


@query("extension_list", with_views(ASSETS_PART, body="SELECT DISTINCT ext FROM assets_part"))
def extension_list(spark, d):
    return C.extensions(assets_part(spark, d)).drop("source_id")


@query(
    "variant_flags",
    with_views(
        ASSETS_PART,
        body=r"""SELECT bool_or(regexp_matches(stem, '-(sm|md|lg|xl|xxl|small|medium|large)$') OR
        regexp_matches(dir, 'small|medium|large')) AS has_tshirt_variants,
        bool_or(regexp_matches(stem, '-(16|20|24|32|48|64)$') OR
        regexp_matches(dir, '/(16|24|32|48|64)')) AS has_pixel_variants FROM assets_part""",
    ),
)
def variant_flags(spark, d):
    return C.variant_flags(assets_part(spark, d)).drop("source_id")


@query(
    "category_counts",
    with_views(
        ASSETS_PART,
        body="""SELECT category, count(*) AS n FROM (SELECT CASE
        WHEN ext = 'svg' AND greatest(width, height) <= 64 THEN 'icon'
        WHEN ext = 'svg' THEN 'illustration' WHEN greatest(width, height) <= 64 THEN 'icon'
        WHEN greatest(width, height) <= 512 THEN 'illustration' ELSE 'photo' END AS category
        FROM assets_part) GROUP BY category""",
    ),
)
def category_counts(spark, d):
    a = assets_part(spark, d)
    return a.groupBy(
        N.category(F.col("ext"), F.col("width"), F.col("height")).alias("category")
    ).agg(F.count("*").alias("n"))


@query(
    "folder_subtree",
    with_views(
        ASSETS_PART,
        body="SELECT asset_id, dir FROM assets_part WHERE dir = 'economy/Brand-2' OR dir LIKE 'economy/Brand-2/%'",
    ),
)
def folder_subtree(spark, d):
    a = assets_part(spark, d)
    return a.filter(C.in_folder("economy/Brand-2")).select("asset_id", "dir")


@query(
    "folder_listing",
    with_views(
        ASSETS_DOC,
        body="""SELECT asset_id, name, size FROM assets_doc WHERE dir = 'src1/en'
        ORDER BY size DESC, name""",
    ),
)
def folder_listing(spark, d):
    return C.list_by_folder(assets_doc(spark, d), "src1/en", "size-desc").select(
        "asset_id", "name", "size"
    )


@query(
    "source_listing",
    with_views(
        ASSETS_PART,
        body="SELECT asset_id, dir, name FROM assets_part ORDER BY dir, name, asset_id",
    ),
)
def source_listing(spark, d):
    return C.list_by_source(assets_part(spark, d)).select("asset_id", "dir", "name")


def _sorted_page(sort):
    def run(spark, d):
        rows = assets_part(spark, d).orderBy(*C.sort_keys(sort)).limit(40)
        page = rows.select("asset_id", "name", "size", "mtime")
        # a limited sort comes in one part, so the running id is the place in the order
        return page.withColumn("position", F.monotonically_increasing_id() + 1)

    return run


for _sort in C.SORTS:
    _column, _direction = _sort.split("-")
    _order = f"{_column} {_direction}" + ("" if _column == "name" else ", name") + ", asset_id"
    query(
        f"grid_sort_{_column}_{_direction}",
        with_views(
            ASSETS_PART,
            body=f"""SELECT asset_id, name, size, mtime, row_number() OVER (ORDER BY {_order}) AS position
            FROM assets_part ORDER BY {_order} LIMIT 40""",
        ),
    )(_sorted_page(_sort))


@query(
    "asset_refs",
    with_views(
        ASSETS_DOC, USAGES_LAB,
        body="""SELECT pos, asset_id, name, size, coalesce(n, 0) AS usage_count FROM
        (SELECT item_id AS asset_id, row_number() OVER (ORDER BY md5(text), item_id) AS pos
        FROM benchmark) w JOIN assets_doc USING (asset_id) LEFT JOIN
        (SELECT asset_id, count(*) AS n FROM usages_lab GROUP BY 1) u USING (asset_id)""",
    ),
)
def asset_refs(spark, d):
    ids = table(spark, d, "benchmark").selectExpr("item_id as asset_id", "md5(text) as h")
    wanted = C.global_positions(ids, ["h", "asset_id"], 8).selectExpr("asset_id", "pos + 1 as pos")
    return C.asset_refs(assets_doc(spark, d), usages_lab(spark, d), wanted).select(
        "pos", "asset_id", "name", "size", "usage_count"
    )


@query(
    "usage_page",
    "SELECT o_orderkey AS id, o_orderpriority AS rel_path FROM orders WHERE o_custkey = 11 "
    "AND o_orderkey > 100 ORDER BY id LIMIT 25",
)
def usage_page(spark, d):
    usages = table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as asset_id", "o_orderpriority as rel_path"
    )
    return C.usage_page(usages, 11, 100, 25).select("id", "rel_path")


@query(
    "ambiguous_names",
    with_views(
        ASSETS_PART,
        body="""SELECT asset_id, name, count(*) OVER (PARTITION BY name) AS holders FROM assets_part
        QUALIFY holders > 1""",
    ),
)
def ambiguous_names(spark, d):
    return C.ambiguous_names(assets_part(spark, d)).select("asset_id", "name", "holders")


@query(
    "even_sample",
    "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, "
    "count(*) OVER () AS n FROM documents) WHERE n <= 30 OR pos IN "
    "(SELECT CAST(floor(i * (SELECT count(*) FROM documents) / 30.0) AS BIGINT) FROM range(30) t(i))",
)
def even_sample(spark, d):
    rows = table(spark, d, "documents").select("doc_id")
    return C.sample_evenly(rows, ["doc_id"], 30, 8).select("doc_id")


@query(
    "embed_health",
    """SELECT *, failed > (ok + failed + degenerate) * 0.2 AS degraded FROM (SELECT
    count(*) FILTER (quality = 1) AS ok, count(*) FILTER (quality = 0 AND toxic = 0) AS failed,
    count(*) FILTER (quality = 0 AND toxic = 1) AS degenerate FROM labels)""",
)
def embed_health(spark, d):
    status = table(spark, d, "labels").selectExpr(
        "1L as source_id",
        "case when quality = 1 then 'ok' when toxic = 1 then 'degenerate' else 'failed' end "
        "as embed_status",
    )
    return C.embed_health(status).drop("source_id")


# --- names ---------------------------------------------------------------------------------------

STOP_SQL = ", ".join(f"'{w}'" for w in N.STOPWORDS + [str(n) for n in N.PIXEL_SIZES])
SIZES_SQL = ", ".join(str(n) for n in N.PIXEL_SIZES)
TOKENS = f"""token_rows AS (SELECT stem, CAST(unnest(list_distinct(list_filter(
  regexp_split_to_array(lower(stem), '[-_\\s.]+'), lambda w: length(w) >= 3 AND NOT
  regexp_matches(w, '^[0-9]+$') AND w NOT IN ({STOP_SQL})))) AS VARCHAR) AS token
  FROM (SELECT DISTINCT stem FROM assets_part))"""


@query(
    "name_tokens",
    with_views(
        ASSETS_PART, TOKENS,
        body="SELECT stem, string_agg(token, ' ' ORDER BY token) AS tokens FROM token_rows GROUP BY stem",
    ),
)
def name_tokens(spark, d):
    stems = assets_part(spark, d).select("stem").distinct()
    tokens = F.array_join(F.sort_array(N.name_tokens(F.col("stem"))), " ")
    return stems.select("stem", tokens.alias("tokens")).filter("tokens <> ''")


@query(
    "jaccard_pairs",
    with_views(
        """words AS (SELECT DISTINCT list_sort([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
        lower(p_type) || 'x', 'b' || replace(p_brand, 'Brand#', '') || 'y']) AS w FROM part)""",
        body="""SELECT array_to_string(a.w, ' ') AS a, array_to_string(b.w, ' ') AS b, round(s / (8 - s), 6) AS score
        FROM (SELECT a.w AS aw, b.w AS bw, len(list_intersect(a.w, b.w)) AS s FROM words a JOIN words b ON a.w < b.w) p,
        LATERAL (SELECT p.aw AS w) a, LATERAL (SELECT p.bw AS w) b WHERE s / (8 - s) >= 0.6""",
    ),
)
def jaccard_pairs(spark, d):
    words = table(spark, d, "part").selectExpr(
        "sort_array(array(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), "
        "concat(lower(p_type), 'x'), concat('b', replace(p_brand, 'Brand#', ''), 'y'))) as tokens"
    )
    pairs = jaccard_join(words, words, 0.6, self_join=True).filter("tokens_a <> tokens_b")
    return pairs.select(
        F.array_join("tokens_a", " ").alias("a"),
        F.array_join("tokens_b", " ").alias("b"),
        F.round("score", 6).alias("score"),
    )


@query(
    "pixel_variants",
    with_views(
        ASSETS_PART,
        body=f"""SELECT asset_id, regexp_replace(stem, '[-_][0-9]{{2,3}}$', '') AS canonical,
        CAST(regexp_extract(stem, '[-_]([0-9]{{2,3}})$', 1) AS INT) AS size,
        CAST(regexp_extract(dir, '(?:^|/)([0-9]{{2,3}})(?:/|$)', 1) AS INT) AS folder_size
        FROM assets_part WHERE try_cast(regexp_extract(stem, '[-_]([0-9]{{2,3}})$', 1) AS INT)
        IN ({SIZES_SQL})""",
    ),
)
def pixel_variants(spark, d):
    a = assets_part(spark, d).withColumn("p", N.pixel_suffix(F.col("stem"))).filter("p is not null")
    return a.select(
        "asset_id",
        "p.canonical",
        "p.size",
        N.pixel_size_from_path(F.col("dir")).alias("folder_size"),
    )


@query(
    "variant_signals",
    with_views(
        ASSETS_PART,
        body=r"""SELECT regexp_matches(dir, '(?i)(^|/)(xs|sm|md|lg|xl|xxl|small|medium|large)(/|$)') AS tshirt,
        regexp_matches(dir, '(^|/)[0-9]{2,3}(/|$)') AS pixel, count(*) AS n FROM assets_part
        GROUP BY 1, 2""",
    ),
)
def variant_signals(spark, d):
    return assets_part(spark, d).groupBy(
        N.has_tshirt_signal(F.col("stem"), F.col("dir")).alias("tshirt"),
        N.has_pixel_path_signal(F.col("dir")).alias("pixel"),
    ).agg(F.count("*").alias("n"))


LINT_STEM = "case p_type when 'PROMO' then p_name when 'LARGE' then concat('_', replace(p_name, ' ', '--')) when 'SMALL' then concat(p_brand, '_a-b') when 'MEDIUM' then concat('é', p_size, '.') else p_type end"


@query(
    "filename_tips",
    f"""SELECT p_partkey AS asset_id, concat_ws(',', CASE WHEN regexp_matches(s, '\\s') THEN 'CONTAINS_SPACE' END,
    CASE WHEN regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') THEN 'UPPERCASE' END,
    CASE WHEN contains(s, '-') AND contains(s, '_') THEN 'MIXED_SEPARATORS' END,
    CASE WHEN contains(s, '--') OR contains(s, '__') THEN 'DOUBLE_SEPARATOR' END,
    CASE WHEN regexp_matches(s, '[^ -~]') THEN 'NON_ASCII' END,
    CASE WHEN regexp_matches(s, '^[._-]') THEN 'LEADING_PUNCT' END,
    CASE WHEN regexp_matches(s, '[._-]$') THEN 'TRAILING_PUNCT' END) AS tips
    FROM (SELECT p_partkey, {LINT_STEM} AS s FROM part)""",
)
def filename_tips(spark, d):
    stems = table(spark, d, "part").selectExpr("p_partkey as asset_id", f"{LINT_STEM} as s")
    return stems.select("asset_id", F.array_join(N.filename_tips(F.col("s")), ",").alias("tips"))


@query(
    "path_parts",
    r"""SELECT url, CASE WHEN ext = 'jpeg' THEN 'jpg' ELSE ext END AS ext, name,
    ext IN ('svg', 'png', 'jpg', 'jpeg', 'webp', 'gif') AS is_image FROM (SELECT url,
    regexp_extract(url, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'),
    '\.([^.]*)$', 1)) AS ext FROM (SELECT url || CASE WHEN page_id % 2 = 0 THEN '.JPEG' ELSE '.svg' END
    AS url FROM pages))""",
)
def path_parts(spark, d):
    from ..functions.util import basename

    urls = table(spark, d, "pages").selectExpr(
        "concat(url, case when page_id % 2 = 0 then '.JPEG' else '.svg' end) as url"
    )
    name = basename(F.col("url"))
    return urls.select(
        "url", N.extension(name).alias("ext"), name.alias("name"), N.is_image_name(name).alias("is_image")
    )


# --- search --------------------------------------------------------------------------------------

WORDS = """words AS (SELECT asset_id, unnest(regexp_extract_all(lower(name || ' ' || stem || ' ' ||
  rel_path), '[a-z0-9]+')) AS term FROM assets_part)"""


@query(
    "inverted_index",
    with_views(
        ASSETS_PART, WORDS,
        body="SELECT term, count(DISTINCT asset_id) AS df, count(*) AS tf FROM words GROUP BY term",
    ),
)
def inverted_index(spark, d):
    index = S.inverted_index(assets_part(spark, d))
    return index.groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("tf")
    )


@query(
    "text_search",
    with_views(
        ASSETS_PART, WORDS,
        """per AS (SELECT asset_id, count(*) AS len, count(*) FILTER (starts_with(term, 'wid')) AS tf0,
        count(*) FILTER (starts_with(term, 'brand')) AS tf1, count(*) FILTER (starts_with(term, 'la'))
        AS tf2 FROM words GROUP BY asset_id),
        st AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (tf0 > 0) AS df0,
        count(*) FILTER (tf1 > 0) AS df1, count(*) FILTER (tf2 > 0) AS df2 FROM per)""",
        body="""SELECT asset_id, round(
        greatest(ln((n - df0 + 0.5) / (df0 + 0.5)), 1e-6) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / mean)) +
        greatest(ln((n - df1 + 0.5) / (df1 + 0.5)), 1e-6) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / mean)) +
        greatest(ln((n - df2 + 0.5) / (df2 + 0.5)), 1e-6) * tf2 * 2.2 / (tf2 + 1.2 * (0.25 + 0.75 * len / mean)),
        6) AS score FROM per, st WHERE tf0 > 0 AND tf1 > 0 AND tf2 > 0""",
    ),
)
def text_search(spark, d):
    found = S.text_matches(assets_part(spark, d), N.query_terms("Wid brand.la"))
    return found.select("asset_id", F.round("score", 6).alias("score"))


@query("indexed_search", ORACLES["text_search"])
def indexed_search(spark, d):
    """The same search out of a stored term table."""
    index = S.store_term_index(assets_part(spark, d), new_folder(spark, "terms"))
    found = S.indexed_matches(index, N.query_terms("Wid brand.la"))
    return found.select("asset_id", F.round("score", 6).alias("score"))


@query(
    "substring_search",
    with_views(
        ASSETS_DOC, USAGES_LAB,
        body="""SELECT asset_id, name FROM assets_doc WHERE (stem ILIKE '%7%' OR rel_path ILIKE '%7%')
        AND ext IN ('fr', 'en') AND asset_id NOT IN (SELECT asset_id FROM usages_lab)
        ORDER BY dir, name, asset_id""",
    ),
)
def substring_search(spark, d):
    found = S.search(
        assets_doc(spark, d), "7", exts=["fr", "en"], usages=usages_lab(spark, d), unused_only=True
    )
    return found.select("asset_id", "name")


@query(
    "full_search",
    with_views(
        ASSETS_PART, USAGES_LI,
        body="""SELECT asset_id, name FROM assets_part WHERE
        len(list_filter(regexp_extract_all(lower(name || ' ' || stem || ' ' || rel_path), '[a-z0-9]+'),
        lambda w: starts_with(w, 'brand'))) > 0 AND ext = (SELECT min(ext) FROM assets_part)
        AND asset_id NOT IN (SELECT asset_id FROM usages_li)""",
    ),
)
def full_search(spark, d):
    """Terms, extension and use at once, over the whole catalogue."""
    assets = assets_part(spark, d)
    first = assets.agg(F.min("ext")).first()[0]
    index = S.store_term_index(assets, new_folder(spark, "terms"))
    found = S.search(assets, "brand", exts=[first], usages=usages_li(spark, d), unused_only=True, index=index)
    return found.select("asset_id", "name")


@query(
    "fingerprint_entropy",
    with_views(
        ASSETS_VEC,
        body="""SELECT asset_id, CAST(bit_count(bits) AS INT) AS popcount,
        bit_count(bits) < 26 OR bit_count(bits) > 38 AS degenerate FROM assets_vec""",
    ),
)
def fingerprint_entropy(spark, d):
    from ..functions.fingerprint import is_degenerate

    return assets_vec(spark, d).select(
        "asset_id",
        popcount(F.col("phash")).alias("popcount"),
        is_degenerate(F.col("phash"), 26, 38).alias("degenerate"),
    )


@query(
    "first_per_folder",
    with_views(
        ASSETS_PART,
        body="""SELECT dir, asset_id, size FROM assets_part QUALIFY row_number() OVER (PARTITION BY dir
        ORDER BY size DESC, asset_id) <= 3""",
    ),
)
def first_per_folder(spark, d):
    rows = assets_part(spark, d).select("dir", "asset_id", "size")
    return first_per(rows, ["dir"], 3, F.desc("size"), "asset_id").drop("rank")
