"""Fingerprint, graph, matching and asset-detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..operators import catalog as C
from ..operators import clusters as K
from ..operators import detail as D
from ..operators import match as M
from ..operators.semantic import semantic_bucket
from ..operators.simjoin import hamming_self_join
from .catalog_queries import HASH, NAME_PART
from .views import (
    ASSETS_PART,
    ASSETS_VEC,
    assets_part,
    assets_vec,
    queries_vec,
    table,
    usages_lab,
    with_views,
)

QUERIES: dict = {}
ORACLES: dict = {}
NEAR = 22
FLOOR = 0.3


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "content_fingerprints",
    """SELECT page_id, sha1(html) AS sha1, count(*) OVER (PARTITION BY html) AS copies FROM pages""",
)
def content_fingerprints(spark, d):
    pages = table(spark, d, "pages").withColumn("hash", FP.content_hash(F.encode("html", "UTF-8")))
    copies = pages.groupBy("hash").agg(F.count("*").alias("copies"))
    return pages.join(copies, "hash").select("page_id", F.sha1("html").alias("sha1"), "copies")


@query(
    "difference_hash",
    """SELECT vec_id, lower(lpad(to_hex(CAST(CAST(array_to_string(list_transform(range(64),
    lambda i: CASE WHEN g[i + i // 8 + 1] > g[i + i // 8 + 2] THEN '1' ELSE '0' END), '') AS BIT) AS UBIGINT)),
    16, '0')) AS dhash FROM (SELECT vec_id, list_transform(list_concat(embedding, embedding[1:8]),
    lambda x: CAST(floor(CAST(x AS DOUBLE) * 1000) AS INT)) AS g FROM embeddings)""",
)
def difference_hash(spark, d):
    rows = table(spark, d, "embeddings").selectExpr(
        "vec_id",
        "transform(concat(embedding, slice(embedding, 1, 8)), "
        "x -> cast(floor(cast(x as double) * 1000) as int)) as grid",
    )
    return rows.select("vec_id", FP.dhash(F.col("grid")).alias("dhash"))


@query(
    "white_share",
    """SELECT vec_id, round(whites / 64.0::DOUBLE, 6) AS white, CASE WHEN vec_id % 10 = 0 THEN 'failed'
    WHEN whites / 64.0 >= 0.98 THEN 'degenerate' ELSE 'ok' END AS status FROM (SELECT vec_id,
    len(list_filter(embedding, lambda x: x >= -0.25)) AS whites FROM embeddings)""",
)
def white_share(spark, d):
    grey = "transform(embedding, x -> if(x >= -0.25, 255, 10))"
    rows = table(spark, d, "embeddings").selectExpr("vec_id", f"{grey} as g")
    white = FP.white_fraction(F.col("g"), F.col("g"), F.col("g"))
    return rows.withColumn("white", white).select(
        "vec_id",
        F.round("white", 6).alias("white"),
        FP.embed_status(F.col("white"), F.col("vec_id") % 10 == 0).alias("status"),
    )


@query(
    "unit_vectors",
    """SELECT vec_id, round(e[1] / n, 6) AS first_value, round(e[64] / n, 6) AS last_value FROM (SELECT vec_id,
    e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM (SELECT vec_id,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (label + 1)) AS e FROM embeddings))""",
)
def unit_vectors(spark, d):
    rows = table(spark, d, "embeddings").selectExpr(
        "vec_id", "transform(embedding, x -> cast(x as double) * (label + 1)) as e"
    )
    unit = rows.select("vec_id", FP.l2_normalize(F.col("e")).alias("u"))
    return unit.select(
        "vec_id",
        F.round(F.get("u", F.lit(0)), 6).alias("first_value"),
        F.round(F.get("u", F.lit(63)), 6).alias("last_value"),
    )


@query(
    "label_centre_cosine",
    """WITH c AS (SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(x) AS m FROM (SELECT label,
    generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
    GROUP BY 1, 2) GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre), 6)
    AS cosine FROM embeddings JOIN c USING (label)""",
)
def label_centre_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    means = (
        rows.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i")
        .agg(F.avg(F.col("x").cast("double")).alias("m"))
        .groupBy("label")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    )
    return rows.join(means, "label").select(
        "vec_id", F.round(FP.cosine(F.col("embedding"), F.col("centre")), 6).alias("cosine")
    )


VEC_PAIRS = f"""pairs AS (SELECT a.asset_id AS a, b.asset_id AS b, bit_count(xor(a.bits, b.bits)) AS h
  FROM assets_vec a JOIN assets_vec b ON a.ext = b.ext AND a.asset_id < b.asset_id
  WHERE bit_count(xor(a.bits, b.bits)) <= {NEAR})"""


@query(
    "hamming_pairs",
    with_views(ASSETS_VEC, VEC_PAIRS, body="SELECT a, b, CAST(h AS INT) AS hamming FROM pairs"),
)
def hamming_pairs(spark, d):
    nodes = K.phash_nodes(assets_vec(spark, d))
    pairs = hamming_self_join(nodes, NEAR, ["source_id", "ext"])
    ids = nodes.select("ext", "bits", "node")
    both = pairs.join(ids.withColumnsRenamed({"bits": "bits_a", "node": "x"}), ["ext", "bits_a"]).join(
        ids.withColumnsRenamed({"bits": "bits_b", "node": "y"}), ["ext", "bits_b"]
    )
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "hamming")


GRAPH = """sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT DISTINCT a AS node, a AS root FROM sym UNION SELECT s.b, r.root FROM reach r JOIN sym s ON s.a = r.node),
comp AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
score AS (SELECT c.component, c.node, sum(bit_count(xor(x.bits, y.bits))) AS total FROM comp c
  JOIN comp o ON o.component = c.component JOIN assets_vec x ON x.asset_id = c.node
  JOIN assets_vec y ON y.asset_id = o.node GROUP BY 1, 2),
medoids AS (SELECT component, arg_min(node, (total, node)) AS medoid, count(*) AS size FROM score GROUP BY 1),
phash_members AS (SELECT 'phash-' || c.component AS key, m.size, c.node AS asset_id,
  CASE WHEN c.node = m.medoid THEN 'canonical' ELSE 'member' END AS role,
  CAST(bit_count(xor(x.bits, y.bits)) AS INT) AS hamming, m.medoid FROM comp c JOIN medoids m USING (component)
  JOIN assets_vec x ON x.asset_id = c.node JOIN assets_vec y ON y.asset_id = m.medoid)"""


def _recursive(*views: str, body: str) -> str:
    return with_views(*views, body=body).replace("WITH ", "WITH RECURSIVE ", 1)


def _phash(spark, d):
    return K.phash_clusters(assets_vec(spark, d), NEAR)


@query(
    "phash_clusters",
    _recursive(
        ASSETS_VEC, VEC_PAIRS, GRAPH,
        body="SELECT key, size, asset_id, role, hamming FROM phash_members",
    ),
)
def phash_clusters(spark, d):
    return _phash(spark, d).select("key", "size", "asset_id", "role", "hamming")


@query(
    "near_pairs",
    _recursive(
        ASSETS_VEC, VEC_PAIRS, GRAPH,
        body="""SELECT key, medoid AS a_id, asset_id AS b_id, hamming, CASE WHEN hamming <= 4 THEN 'high'
        WHEN hamming <= 8 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN hamming <= 4 THEN 'very'
        WHEN hamming <= 8 THEN 'similar' ELSE 'loose' END AS bucket FROM phash_members WHERE role = 'member'""",
    ),
)
def near_pairs(spark, d):
    return K.near_pairs(_phash(spark, d)).drop("source_id")


@query(
    "near_histogram",
    _recursive(
        ASSETS_VEC, VEC_PAIRS, GRAPH,
        body="""SELECT CAST(i AS BIGINT) AS bin, (SELECT count(*) FROM phash_members WHERE role = 'member' AND
        least(hamming, 29) = i) AS n, CAST(coalesce((SELECT max(hamming) FROM phash_members WHERE role = 'member'
        AND least(hamming, 29) = i), 0) AS INT) AS max_hamming FROM range(30) t(i)""",
    ),
)
def near_histogram(spark, d):
    return K.near_histogram(K.near_pairs(_phash(spark, d)), bins=30)


@query(
    "overview_near",
    _recursive(
        ASSETS_VEC, VEC_PAIRS, GRAPH,
        """same AS (SELECT content_hash AS key, count(*) AS k FROM assets_vec GROUP BY 1 HAVING count(*) > 1),
        alike AS (SELECT stem AS key, count(*) AS k FROM assets_vec GROUP BY 1 HAVING count(*) > 1)""",
        body="""SELECT (SELECT count(*) FROM assets_vec) AS total_assets, (SELECT count(*) FROM same) AS duplicate_groups,
        (SELECT count(*) FROM alike) AS name_clusters, (SELECT count(*) FROM medoids WHERE size > 1) AS near_clusters,
        (SELECT CAST(coalesce(sum((k - 1) * 1024), 0) AS BIGINT) FROM same) AS reclaimable_bytes""",
    ),
)
def overview_near(spark, d):
    """The overview with all three kinds of clusters, fingerprints included."""
    a = assets_vec(spark, d)
    clusters = K.hash_clusters(a).unionByName(K.name_clusters(a)).unionByName(_phash(spark, d))
    return C.overview(a, usages_lab(spark, d), clusters).select(
        "total_assets", "duplicate_groups", "name_clusters", "near_clusters", "reclaimable_bytes")


# --- matching ------------------------------------------------------------------------------------

EXACT = """exact AS (SELECT q.asset_id AS query_id, a.asset_id, CAST(row_number() OVER (PARTITION BY q.asset_id
  ORDER BY a.asset_id) AS INT) AS rank FROM assets_vec q JOIN assets_vec a USING (content_hash) QUALIFY rank <= 10)"""
NEAR_B = f"""near AS (SELECT q.asset_id AS query_id, a.asset_id, CAST(bit_count(xor(q.bits, a.bits)) AS INT) AS hamming,
  CAST(row_number() OVER (PARTITION BY q.asset_id ORDER BY bit_count(xor(q.bits, a.bits)), a.asset_id) AS INT) AS rank
  FROM assets_vec q JOIN assets_vec a USING (ext) WHERE bit_count(xor(q.bits, a.bits)) <= {NEAR}
  AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.query_id = q.asset_id AND e.asset_id = a.asset_id) QUALIFY rank <= 30)"""
NAME_B = """common AS (SELECT q.asset_id AS query_id, a.asset_id, len(list_intersect(q.tokens, a.tokens)) /
  len(list_distinct(list_concat(q.tokens, a.tokens))) AS score FROM assets_vec q, assets_vec a),
name AS (SELECT query_id, asset_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
  asset_id) AS INT) AS rank FROM common c WHERE score >= 0.33 AND NOT EXISTS (SELECT 1 FROM exact e WHERE
  e.query_id = c.query_id AND e.asset_id = c.asset_id) AND NOT EXISTS (SELECT 1 FROM near e WHERE
  e.query_id = c.query_id AND e.asset_id = c.asset_id) QUALIFY rank <= 10)"""
SEM_B = f"""taken AS (SELECT query_id, asset_id FROM exact UNION ALL SELECT query_id, asset_id FROM near UNION ALL
  SELECT query_id, asset_id FROM name),
cosines AS (SELECT q.asset_id AS query_id, a.asset_id, list_cosine_similarity(q.embedding, a.embedding) AS score
  FROM assets_vec q, assets_vec a WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.query_id = q.asset_id
  AND t.asset_id = a.asset_id)),
med AS (SELECT query_id, median(score) AS m, count(*) AS n FROM cosines GROUP BY 1),
gates AS (SELECT query_id, n, greatest(m + 3 * (SELECT median(abs(score - m)) FROM cosines c
  WHERE c.query_id = med.query_id), {FLOOR}) AS gate FROM med),
semantic AS (SELECT c.query_id, c.asset_id, c.score, g.gate, CAST(floor((SELECT count(*) FROM cosines o WHERE
  o.query_id = c.query_id AND o.score < c.score) / g.n * 100 + 0.5) AS INT) AS percentile,
  CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY c.score DESC, c.asset_id) AS INT) AS rank
  FROM cosines c JOIN gates g USING (query_id) WHERE c.score >= g.gate QUALIFY rank <= 10)"""


@query(
    "exact_bucket",
    with_views(ASSETS_VEC, EXACT, body="SELECT query_id, asset_id, rank FROM exact"),
)
def exact_bucket(spark, d):
    return M.exact_bucket(queries_vec(spark, d), assets_vec(spark, d))


@query(
    "near_bucket",
    with_views(
        ASSETS_VEC, EXACT, NEAR_B,
        body="""SELECT query_id, asset_id, hamming, rank, CAST(least(99, floor((64 - hamming) / 64 * 100 + 0.5))
        AS INT) AS pct FROM near""",
    ),
)
def near_bucket(spark, d):
    q, a = queries_vec(spark, d), assets_vec(spark, d)
    return M.near_bucket(q, a, M.exact_bucket(q, a), NEAR)


@query(
    "name_bucket",
    with_views(
        ASSETS_VEC, EXACT, "near AS (SELECT query_id, asset_id FROM exact)", NAME_B,
        body="SELECT query_id, asset_id, round(score, 6) AS score, rank FROM name",
    ),
)
def name_bucket(spark, d):
    q, a = queries_vec(spark, d), assets_vec(spark, d)
    return M.name_bucket(q, a, M.exact_bucket(q, a)).select(
        "query_id", "asset_id", F.round("score", 6).alias("score"), "rank"
    )


@query(
    "semantic_bucket",
    with_views(
        ASSETS_VEC,
        "exact AS (SELECT asset_id AS query_id, asset_id FROM assets_vec)",
        "near AS (SELECT query_id, asset_id FROM exact)",
        "name AS (SELECT query_id, asset_id FROM exact)",
        SEM_B,
        body="""SELECT query_id, asset_id, round(score, 6) AS score, percentile, round(gate, 6) AS gate, rank
        FROM semantic""",
    ),
)
def semantic(spark, d):
    q, a = queries_vec(spark, d), assets_vec(spark, d)
    own = q.select("query_id", F.col("query_id").alias("asset_id"))
    found = semantic_bucket(q, a, own, FLOOR)
    return found.withColumns({"score": F.round("score", 6), "gate": F.round("gate", 6)})


BUCKETS = """buckets AS (SELECT query_id, 'exact' AS bucket, rank, asset_id, 1.0::DOUBLE AS score FROM exact
  UNION ALL SELECT query_id, 'near', rank, asset_id, least(99, floor((64 - hamming) / 64 * 100 + 0.5)) / 100 FROM near
  UNION ALL SELECT query_id, 'name', rank, asset_id, score FROM name
  UNION ALL SELECT query_id, 'semantic', rank, asset_id, score FROM semantic)"""
ALL_BUCKETS = [ASSETS_VEC, EXACT, NEAR_B, NAME_B, SEM_B, BUCKETS]


def _match(spark, d):
    return M.match(
        queries_vec(spark, d), assets_vec(spark, d), usages_lab(spark, d), ceiling=NEAR, floor=FLOOR
    )


@query(
    "match_buckets",
    with_views(
        *ALL_BUCKETS,
        body="""SELECT query_id, bucket, rank, asset_id, round(score, 6) AS score, coalesce(n, 0) AS usage_count,
        CASE WHEN bucket = 'name' THEN array_to_string(list_sort(list_intersect(
        (SELECT tokens FROM assets_vec v WHERE v.asset_id = query_id), w.tokens)), ' ') END AS shared,
        w.rel_path AS rel_path, false AS near_degenerate
        FROM buckets JOIN assets_vec w USING (asset_id) LEFT JOIN (SELECT doc_id AS asset_id, count(*) AS n FROM labels GROUP BY 1) u USING (asset_id)""",
    ),
)
def match_buckets(spark, d):
    found = M.described(_match(spark, d), queries_vec(spark, d), assets_vec(spark, d))
    return found.select(
        "query_id", "bucket", "rank", "asset_id", F.round("score", 6).alias("score"), "usage_count",
        F.array_join(F.sort_array("shared_tokens"), " ").alias("shared"), "rel_path", "near_degenerate",
    )


@query(
    "reader_threshold",
    with_views(
        *ALL_BUCKETS,
        body="""SELECT b.query_id, b.bucket, b.asset_id, b.rank FROM buckets b LEFT JOIN near n
        ON n.query_id = b.query_id AND n.asset_id = b.asset_id WHERE b.bucket <> 'near' OR n.hamming <= 18""",
    ),
)
def reader_threshold(spark, d):
    """A reader's own, tighter limit on the near bucket."""
    return M.within(_match(spark, d), 18).select("query_id", "bucket", "asset_id", "rank")


@query(
    "hamming_missing",
    with_views(
        ASSETS_VEC,
        body="""SELECT a.asset_id, CAST(CASE WHEN quality IS NULL OR quality = 0 THEN 64
        ELSE bit_count(xor(a.bits, b.bits)) END AS INT) AS hamming FROM assets_vec a
        JOIN (SELECT ext, min(asset_id) AS first FROM assets_vec GROUP BY 1) f USING (ext)
        JOIN assets_vec b ON b.asset_id = f.first LEFT JOIN labels ON doc_id = a.asset_id""",
    ),
)
def hamming_missing(spark, d):
    """Distance to the first asset of a type; 64 where a fingerprint is missing or damaged."""
    label = table(spark, d, "labels").selectExpr("doc_id as asset_id", "quality")
    known = assets_vec(spark, d).select("asset_id", "ext", "phash").join(label, "asset_id", "left")
    first = known.groupBy("ext").agg(F.min_by("phash", "asset_id").alias("first"))
    held = F.when(F.col("quality") == 1, F.col("phash")).when(F.col("quality") == 0, F.substring("phash", 1, 9))
    return known.join(first, "ext").select("asset_id", FP.hamming(held, F.col("first")).cast("int").alias("hamming"))


@query(
    "merged_matches",
    with_views(
        *ALL_BUCKETS,
        body="""SELECT query_id, asset_id, round(score, 6) AS score, via, CAST(row_number() OVER (PARTITION BY query_id
        ORDER BY score DESC, rel_path) AS INT) AS rank FROM (SELECT query_id, asset_id, max(score) AS score,
        arg_max(bucket, score) AS via FROM buckets GROUP BY 1, 2) JOIN assets_vec USING (asset_id)
        QUALIFY rank <= 10""",
    ),
)
def merged_matches(spark, d):
    found = M.merge_top_n(_match(spark, d), assets_vec(spark, d), 10)
    return found.select("query_id", "asset_id", F.round("score", 6).alias("score"), "via", "rank")


# --- asset detail --------------------------------------------------------------------------------

DETAIL_NEAR = f"""dnear AS (SELECT q.asset_id AS subject_id, a.asset_id, CAST(bit_count(xor(q.bits, a.bits)) AS INT)
  AS hamming, CAST(row_number() OVER (PARTITION BY q.asset_id ORDER BY bit_count(xor(q.bits, a.bits)), a.asset_id)
  AS INT) AS rank FROM assets_vec q JOIN assets_vec a ON q.ext = a.ext AND q.asset_id <> a.asset_id
  WHERE bit_count(xor(q.bits, a.bits)) <= {NEAR} QUALIFY rank <= 20)"""


@query("detail_near", with_views(ASSETS_VEC, DETAIL_NEAR, body="SELECT * FROM dnear"))
def detail_near(spark, d):
    a = assets_vec(spark, d)
    return D.near_duplicates(a, a, raster=NEAR)


@query(
    "detail_siblings",
    with_views(
        ASSETS_VEC, DETAIL_NEAR,
        """sib AS (SELECT q.asset_id AS subject_id, a.asset_id, len(list_intersect(q.tokens, a.tokens)) /
        len(list_distinct(list_concat(q.tokens, a.tokens))) AS score, CAST(bit_count(xor(q.bits, a.bits)) AS INT)
        AS hamming FROM assets_vec q JOIN assets_vec a ON q.asset_id <> a.asset_id
        WHERE q.content_hash <> a.content_hash AND bit_count(xor(q.bits, a.bits)) <= 26)""",
        body="""SELECT subject_id, asset_id, round(score, 6) AS score, hamming, CAST(row_number() OVER (PARTITION BY
        subject_id ORDER BY hamming, score DESC, asset_id) AS INT) AS rank FROM sib s WHERE score >= 0.2
        AND NOT EXISTS (SELECT 1 FROM dnear n WHERE n.subject_id = s.subject_id AND n.asset_id = s.asset_id)
        QUALIFY rank <= 15""",
    ),
)
def detail_siblings(spark, d):
    a = assets_vec(spark, d)
    near = D.near_duplicates(a, a, raster=NEAR)
    return D.name_siblings(a, a, near, raster=26).select(
        "subject_id", "asset_id", F.round("score", 6).alias("score"), "hamming", "rank"
    )


@query(
    "detail_memberships",
    with_views(
        ASSETS_PART, HASH.format(assets="assets_part"), NAME_PART,
        """members AS (SELECT 'hash' AS kind, key, asset_id, role FROM hash_dups UNION ALL
        SELECT 'name', key, asset_id, role FROM name_groups)""",
        body="""SELECT m.kind, m.key, count(*) OVER (PARTITION BY m.kind, m.key) AS size, m.asset_id, m.role,
        true AS subject, a.rel_path FROM members m JOIN assets_part a ON a.asset_id = m.asset_id""",
    ),
)
def detail_memberships(spark, d):
    """Every asset is a subject: the listing of one is all rows of its clusters, ``size`` each."""
    a = assets_part(spark, d)
    members = K.hash_clusters(a).unionByName(K.name_clusters(a))
    found = D.memberships(a, members, a)
    return found.select("kind", "key", "size", "asset_id", "role", "subject", "rel_path")


@query(
    "detail_size_variants",
    with_views(
        """drawings AS (SELECT p_partkey AS asset_id, p_name || '.svg' AS name,
        CASE WHEN p_partkey % 2 = 0 THEN p_size END AS suffix,
        CASE WHEN p_partkey % 2 = 1 THEN p_size END AS folder, p_name AS drawing FROM part
        WHERE p_size IN (8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 48) AND (p_size >= 10))""",
        body="""SELECT subject_id, size, asset_id FROM (SELECT s.asset_id AS subject_id, coalesce(a.suffix, a.folder)
        AS size, a.asset_id, row_number() OVER (PARTITION BY s.asset_id, coalesce(a.suffix, a.folder)
        ORDER BY a.asset_id) AS pos FROM drawings s JOIN drawings a ON s.drawing = a.drawing AND
        (s.suffix IS NULL) = (a.suffix IS NULL) AND s.asset_id <> a.asset_id) WHERE pos = 1""",
    ),
)
def detail_size_variants(spark, d):
    a = table(spark, d, "part").selectExpr(
        "1L as source_id", "p_partkey as asset_id", "'svg' as ext", "concat(p_name, '.svg') as name",
        "if(p_partkey % 2 = 0, concat(p_name, '-', p_size), p_name) as stem",
        "if(p_partkey % 2 = 0, 'flat', concat('set/', p_size)) as dir",
    )
    return D.size_variants(a, a).select("subject_id", "size", "asset_id")
