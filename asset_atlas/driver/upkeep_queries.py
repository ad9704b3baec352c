"""Incremental maintenance, streaming, clean-up plans and rename checks."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import fingerprint as FP
from ..functions.fingerprint import popcount_backfill
from ..operators import catalog as C
from ..operators import clusters as K
from ..operators import incremental as N
from ..operators.usages import backfill_abs_path, unused_assets
from ..plans import actions as A
from ..plans import rename as R
from ..schemas import ASSETS
from ..session import new_folder
from ..sources.sinks import run_stage
from ..streaming.ingest import compact, duplicate_alerts, latest_alerts, read_assets, start_arrival_alerts, write_batch
from .catalog_queries import HASH_DOC, HASH_PART, NAME_PART
from .views import (
    ASSETS_DOC,
    ASSETS_PART,
    ASSETS_VEC,
    USAGES_LAB,
    USAGES_LI,
    assets_doc,
    assets_part,
    assets_vec,
    one_source,
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


# stored and scanned hold every document; unlabelled ones are stored under an old path, German ones
# are found under a new one, and the label serves as file time
STORED = """stored AS (SELECT CAST(1 AS BIGINT) AS source_id, d.doc_id AS asset_id,
  CASE WHEN l.quality IS NULL THEN 'old' ELSE 'd' END || d.doc_id AS abs_path,
  d.n_chars AS size, CAST(coalesce(l.quality, 1) AS BIGINT) AS mtime,
  md5(d.text || coalesce(l.toxic, 0)) AS content_hash,
  CASE l.quality WHEN 1 THEN 'ok' ELSE 'failed' END AS embed_status, 'ann' AS author
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
SCANNED = """scanned AS (SELECT CAST(1 AS BIGINT) AS source_id,
  CASE lang WHEN 'de' THEN 'moved' ELSE 'd' END || doc_id AS abs_path, n_chars AS size,
  CAST(CASE lang WHEN 'fr' THEN 0 ELSE 1 END AS BIGINT) AS mtime, md5(text || 0) AS content_hash
  FROM documents)"""


def _stored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").selectExpr(
        "1L as source_id", "doc_id as asset_id",
        "concat(if(quality is null, 'old', 'd'), doc_id) as abs_path", "n_chars as size",
        "cast(coalesce(quality, 1) as bigint) as mtime", "md5(concat(text, coalesce(toxic, 0))) as content_hash",
        "if(quality = 1, 'ok', 'failed') as embed_status", "'ann' as author",
    )


def _scanned(spark, d):
    return table(spark, d, "documents").selectExpr(
        "1L as source_id", "concat(if(lang = 'de', 'moved', 'd'), doc_id) as abs_path", "n_chars as size",
        "cast(if(lang = 'fr', 0, 1) as bigint) as mtime", "md5(concat(text, 0)) as content_hash",
    )


@query(
    "scan_diff",
    with_views(
        STORED, SCANNED,
        body="""SELECT coalesce(n.abs_path, o.abs_path) AS abs_path, CASE WHEN o.abs_path IS NULL THEN 'new'
        WHEN n.abs_path IS NULL THEN 'gone' WHEN n.size = o.size AND n.mtime = o.mtime THEN 'same'
        ELSE 'changed' END AS state FROM scanned n FULL JOIN stored o ON n.abs_path = o.abs_path""",
    ),
)
def scan_diff(spark, d):
    return N.diff(_scanned(spark, d), _stored(spark, d))


@query(
    "catalogue_upsert",
    with_views(
        STORED, SCANNED,
        body="""SELECT abs_path, o.asset_id AS kept_id, n.size AS size, coalesce(n.mtime, o.mtime) AS mtime,
        coalesce(n.content_hash, o.content_hash) AS content_hash, CASE WHEN n.content_hash IS NULL OR
        n.content_hash = o.content_hash THEN o.embed_status END AS embed_status, o.author
        FROM (SELECT abs_path FROM stored UNION SELECT abs_path FROM scanned) k LEFT JOIN stored o USING (abs_path)
        LEFT JOIN scanned n USING (abs_path)""".replace("n.size AS size", "coalesce(n.size, o.size) AS size"),
    ),
)
def catalogue_upsert(spark, d):
    """Ids of new rows depend on the hash order, so the check looks at kept ids only."""
    stored = _stored(spark, d)
    top = stored.agg(F.max("asset_id").alias("m")).scalar()
    merged = N.upsert(stored, _scanned(spark, d))
    return merged.select(
        "abs_path",
        F.when(F.col("asset_id") <= top, F.col("asset_id")).alias("kept_id"),
        "size", "mtime", "content_hash", "embed_status", "author",
    )


@query(
    "new_asset_ids",
    with_views(
        STORED, SCANNED,
        body="""SELECT (SELECT max(asset_id) FROM stored) + row_number() OVER () AS asset_id FROM scanned
        WHERE abs_path NOT IN (SELECT abs_path FROM stored)""",
    ),
)
def new_asset_ids(spark, d):
    stored = _stored(spark, d)
    top = stored.agg(F.max("asset_id").alias("m")).scalar()
    merged = N.upsert(stored, _scanned(spark, d))
    return merged.select("asset_id").filter(F.col("asset_id") > top)


@query(
    "delete_missing",
    with_views(
        STORED, SCANNED,
        body="SELECT asset_id, abs_path FROM stored WHERE abs_path IN (SELECT abs_path FROM scanned)",
    ),
)
def delete_missing(spark, d):
    return N.delete_missing(_stored(spark, d), _scanned(spark, d), 1).select("asset_id", "abs_path")


@query(
    "index_run",
    with_views(
        STORED, SCANNED,
        """states AS (SELECT n.abs_path, o.asset_id AS kept_id, o.abs_path IS NOT NULL AND n.size = o.size AND
        n.mtime = o.mtime AS same, n.size, n.mtime, n.content_hash AS found, o.content_hash AS held,
        o.embed_status, o.author FROM scanned n LEFT JOIN stored o USING (abs_path))""",
        body="""SELECT abs_path, kept_id, size, mtime, CASE WHEN same THEN held ELSE found END AS content_hash,
        CASE WHEN same OR held = found THEN embed_status END AS embed_status, author FROM states""",
    ),
)
def index_run(spark, d):
    """A run over documents as files: only new and changed ones are read, the others keep what is stored."""
    stored, found = _stored(spark, d), _scanned(spark, d)
    listing = found.select("source_id", "abs_path", "size", "mtime")
    merged, _ = N.index_run(
        listing, stored, lambda paths: found.join(paths.select("abs_path"), "abs_path", "left_semi"), 1)
    top = stored.agg(F.max("asset_id").alias("m")).scalar()
    return merged.select(
        "abs_path", F.when(F.col("asset_id") <= top, F.col("asset_id")).alias("kept_id"),
        "size", "mtime", "content_hash", "embed_status", "author",
    )


@query(
    "index_run_report",
    with_views(
        STORED, SCANNED,
        body="""SELECT CASE WHEN o.abs_path IS NULL THEN 'new' WHEN n.abs_path IS NULL THEN 'gone'
        WHEN n.size = o.size AND n.mtime = o.mtime THEN 'same' ELSE 'changed' END AS state, count(*) AS n
        FROM scanned n FULL JOIN stored o ON n.abs_path = o.abs_path GROUP BY 1""",
    ),
)
def index_run_report(spark, d):
    found = _scanned(spark, d)
    _, report = N.index_run(
        found.select("source_id", "abs_path", "size", "mtime"), _stored(spark, d),
        lambda paths: found.join(paths.select("abs_path"), "abs_path", "left_semi"), 1)
    return report


HEADERS = {
    "png": "concat('89504E470D0A1A0A0000000D49484452', lpad(hex(w), 8, '0'), lpad(hex(h), 8, '0'), '0806000000')",
    "gif": "concat('474946383961', little(w, 2), little(h, 2), 'F70000')",
    "jpg": "concat('FFD8FFE000104A46494600010100000100010000FFDB0006', '00010203', 'FFC4000401FF', 'FFC2001108', "
    "lpad(hex(h), 4, '0'), lpad(hex(w), 4, '0'), '03012200021101')",
    "webp_lossy": "concat('52494646000000005745425056503820', '00000000', '0000009D012A', little(w, 2), little(h, 2))",
    "webp_lossless": "concat('5249464600000000574542505650384C', '00000000', '2F', "
    "little((w - 1) | shiftleft(cast(h - 1 as bigint), 14), 4), '00')",
    "webp_extended": "concat('52494646000000005745425056503858', '0A000000', '10000000', little(w - 1, 3), little(h - 1, 3))",
}


def _little(sql: str) -> str:
    """``little(x, n)`` written out: n bytes of x as hex, the lowest first."""
    part = "lpad(hex(cast(shiftright(cast({x} as bigint), {s}) & 255 as bigint)), 2, '0')"

    def expand(m: re.Match) -> str:
        return "concat(" + ", ".join(part.format(x=m[1], s=8 * i) for i in range(int(m[2]))) + ")"

    return re.sub(r"little\(((?:[^()]|\((?:[^()]|\([^()]*\))*\))*), (\d)\)", expand, sql)


@query(
    "header_sizes",
    """SELECT p_partkey AS asset_id, format, CAST(p_size * 37 AS INT) AS width, CAST(p_size * 29 + 1 AS INT) AS height
    FROM part, (SELECT unnest(['png', 'gif', 'jpg', 'webp_lossy', 'webp_lossless', 'webp_extended']) AS format)
    UNION ALL SELECT p_partkey, 'text', NULL, NULL FROM part""",
)
def header_sizes(spark, d):
    """Width and height out of header bytes that hold the part's size, one file of each format."""
    parts = table(spark, d, "part").selectExpr("p_partkey as asset_id", "p_size * 37 as w", "p_size * 29 + 1 as h")
    pairs = ", ".join(f"struct('{name}' as format, {_little(sql)} as bytes)" for name, sql in HEADERS.items())
    files = parts.selectExpr("asset_id", f"inline(array({pairs}, struct('text' as format, hex('plain text') as bytes)))")
    size = FP.header_size(F.unhex("bytes"))
    return files.select("asset_id", "format", size["width"].alias("width"), size["height"].alias("height"))


@query(
    "embedding_targets",
    """SELECT vec_id AS asset_id FROM embeddings LEFT JOIN labels ON doc_id = vec_id
    WHERE quality IS NULL OR quality = 0""",
)
def embedding_targets(spark, d):
    status = table(spark, d, "labels").selectExpr(
        "doc_id as asset_id", "if(quality = 1, 'ok', 'failed') as embed_status"
    )
    a = assets_vec(spark, d).drop("embed_status").join(status, "asset_id", "left")
    return N.embedding_targets(a).select("asset_id")


@query(
    "popcount_backfill",
    with_views(
        ASSETS_VEC,
        body="""SELECT asset_id, CAST(CASE WHEN asset_id % 2 = 0 THEN 7 ELSE bit_count(bits) END AS INT)
        AS popcount FROM assets_vec""",
    ),
)
def popcounts(spark, d):
    known = F.when(F.col("asset_id") % 2 == 0, F.lit(7))
    return assets_vec(spark, d).select(
        "asset_id", popcount_backfill(known, F.col("phash")).alias("popcount")
    )


@query(
    "rename_propagation",
    with_views(
        ASSETS_PART,
        body="""SELECT asset_id, CASE WHEN r THEN 'new-' || name ELSE name END AS name,
        CASE WHEN r THEN 'new-' || stem ELSE stem END AS stem, CASE WHEN r THEN dir || '/new-' || name ELSE
        rel_path END AS rel_path, CASE WHEN r THEN '/repo/' || dir || '/new-' || name ELSE abs_path END AS abs_path
        FROM (SELECT *, ext = 'svg' AS r FROM assets_part)""",
    ),
)
def rename_propagation(spark, d):
    a = assets_part(spark, d)
    renames = a.filter("ext = 'svg'").select(
        "asset_id", F.concat(F.lit("new-"), "name").alias("new_name")
    )
    return N.apply_renames(a, renames).select("asset_id", "name", "stem", "rel_path", "abs_path")


@query(
    "failure_summary",
    "SELECT o_orderpriority || ' ' || o_orderstatus AS reason, count(*) AS n FROM orders "
    "GROUP BY 1 ORDER BY n DESC, reason LIMIT 3",
)
def failure_summary(spark, d):
    failures = table(spark, d, "orders").selectExpr(
        "'embed' as label", "cast(o_orderkey as string) as file",
        "concat(o_orderpriority, ' ', o_orderstatus) as reason",
    )
    return N.failure_summary(failures)


@query(
    "stage_metrics",
    """SELECT event_type AS stage, count(*) AS runs, count(*) FILTER (value > 50) AS failed_runs,
    round(max(value), 6) AS slowest FROM events GROUP BY 1""",
)
def stage_metrics(spark, d):
    stages = table(spark, d, "events").selectExpr(
        "event_id as run_id", "event_type as stage", "value as ms",
        "if(value > 50, 'FAILED: slow', 'done') as detail",
    )
    return N.stage_metrics(stages).groupBy("stage").agg(
        F.count("*").alias("runs"),
        F.count_if("failed").alias("failed_runs"),
        F.round(F.max("ms"), 6).alias("slowest"),
    )


@query(
    "stage_rebuild",
    """SELECT event_type AS kind, user_id % 3 AS source_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events
    WHERE event_type NOT IN ('click', 'view') OR user_id % 3 <> 1 GROUP BY ALL
    UNION ALL SELECT 'click', 1, count(*), CAST(sum(event_id + 1) AS BIGINT) FROM events
    WHERE event_type = 'click' AND user_id % 3 = 1""",
)
def stage_rebuild(spark, d):
    """A stage replaces the partitions named out of the table it reads, empties one, and leaves the others."""
    path = f"{new_folder(spark, 'stages')}"
    rows = table(spark, d, "events").selectExpr("event_id", "event_type as kind", "user_id % 3 as source_id")
    kinds = ["click", "view", "purchase", "signup", "error"]
    run_stage(spark, "all", lambda: rows, path, [0, 1, 2], kinds)
    again = spark.read.parquet(path).filter("kind = 'click' and source_id = 1").withColumn("event_id", F.expr("event_id + 1"))
    run_stage(spark, "one", lambda: again, path, [1], ["click", "view"])
    stored = spark.read.parquet(path)
    return stored.groupBy("kind", F.col("source_id").cast("long").alias("source_id")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(
    "usage_path_backfill",
    """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN '/kept/' || o_orderkey WHEN o_orderstatus = 'F'
    THEN '/abs/' || o_orderkey ELSE '/root/n' || c_nationkey || '/' || o_orderkey END AS abs_path
    FROM orders JOIN customer ON c_custkey = o_custkey""",
)
def usage_path_backfill(spark, d):
    homes = table(spark, d, "customer").selectExpr(
        "c_custkey as o_custkey", "cast(c_nationkey as bigint) as source_id"
    )
    usages = table(spark, d, "orders").join(homes, "o_custkey").selectExpr(
        "o_orderkey as id", "source_id",
        "if(o_orderstatus = 'F', concat('/abs/', o_orderkey), cast(o_orderkey as string)) as rel_path",
        "if(o_orderstatus = 'O', concat('/kept/', o_orderkey), '') as abs_path",
    )
    sources = table(spark, d, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id", "concat('/root/n', n_nationkey) as root"
    )
    return backfill_abs_path(usages, sources).select("id", "abs_path")


def _document_stream(spark, d):
    docs = table(spark, d, "documents")
    return spark.readStream.schema(docs.schema).parquet(f"{d}/documents*.parquet")


@query(
    "stream_upsert",
    with_views(
        STORED, SCANNED,
        body="""SELECT abs_path, o.asset_id AS kept_id, coalesce(n.size, o.size) AS size,
        coalesce(n.mtime, o.mtime) AS mtime, coalesce(n.content_hash, o.content_hash) AS content_hash
        FROM (SELECT abs_path FROM stored UNION SELECT abs_path FROM scanned) k LEFT JOIN stored o USING (abs_path)
        LEFT JOIN scanned n USING (abs_path)""",
    ),
)
def stream_upsert(spark, d):
    """A stored catalogue takes a stream of documents: logged batch by batch, then folded in."""
    folder = new_folder(spark, "stream-upsert")
    stored = _stored(spark, d)
    empty = spark.createDataFrame([], ASSETS)
    (
        empty.select(*[c for c in empty.columns if c not in stored.columns])
        .limit(0)
        .join(stored, F.lit(True), "right")
        .select(*[F.col(c).cast(empty.schema[c].dataType) for c in empty.columns])
        .write.partitionBy("source_id")
        .parquet(f"{folder}/rows")
    )
    arriving = _document_stream(spark, d).selectExpr(
        "1L as source_id", "concat(if(lang = 'de', 'moved', 'd'), doc_id) as abs_path", "n_chars as size",
        "cast(if(lang = 'fr', 0, 1) as bigint) as mtime", "md5(concat(text, 0)) as content_hash",
    )
    run = (
        arriving.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, folder))
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    compact(spark, folder)
    top = stored.agg(F.max("asset_id").alias("m")).scalar()
    return read_assets(spark, folder).select(
        "abs_path", F.when(F.col("asset_id") <= top, F.col("asset_id")).alias("kept_id"), "size", "mtime", "content_hash")


@query(
    "stream_arrival_alerts",
    """SELECT md5(text) AS content_hash, arg_min('d' || doc_id, 'd' || doc_id) AS first_path, count(*) AS files,
    any_value(first_known) AS known_path, coalesce(any_value(k.copies), 0) AS copies
    FROM documents LEFT JOIN (SELECT md5(text) AS h, min('l' || doc_id) AS first_known, count(*) AS copies
    FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1) k ON md5(text) = k.h GROUP BY 1 HAVING count(*) > 1 OR any_value(k.copies) > 0"""
)
def stream_arrival_alerts(spark, d):
    """Copies among the arriving documents themselves, whichever batch they come in, and of toxic known ones."""
    arriving = _document_stream(spark, d).selectExpr(
        "concat('d', doc_id) as abs_path", "md5(text) as content_hash", "timestamp_seconds(0) as arrived")
    reviewed = table(spark, d, "documents").join(table(spark, d, "labels").filter("toxic = 1"), "doc_id")
    known = reviewed.selectExpr("md5(text) as content_hash", "concat('l', doc_id) as rel_path", "doc_id as asset_id")
    folder = new_folder(spark, "arrivals")
    start_arrival_alerts(arriving, known, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return latest_alerts(spark, f"{folder}/rows")


@query(
    "stream_duplicate_alerts",
    """SELECT 'd' || d.doc_id AS abs_path, k.first_path, k.copies FROM documents d JOIN (SELECT md5(text) AS h,
    min(source || '/' || lang || '/doc-' || doc_id || '.' || lang) AS first_path, count(*) AS copies FROM documents
    GROUP BY 1) k ON md5(d.text) = k.h""",
)
def stream_duplicate_alerts(spark, d):
    """Documents arrive as a stream and meet the whole catalogue."""
    docs = table(spark, d, "documents")
    arriving = (
        spark.readStream.schema(docs.schema)
        .parquet(f"{d}/documents*.parquet")
        .selectExpr("concat('d', doc_id) as abs_path", "md5(text) as content_hash")
    )
    known = assets_doc(spark, d)
    folder = new_folder(spark, "alerts")
    run = (
        duplicate_alerts(arriving, known)
        .select("abs_path", "first_path", "copies")
        .writeStream.format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema("abs_path string, first_path string, copies bigint").parquet(
        f"{folder}/rows"
    )


# --- plans ---------------------------------------------------------------------------------------


def _exact_actions(spark, d):
    a = assets_doc(spark, d)
    return A.merge_actions(C.exact_duplicates(K.hash_clusters(a), a, usages_lab(spark, d)))


def _cluster_actions(spark, d):
    a = assets_part(spark, d)
    groups = K.name_clusters(a).withColumnRenamed("size", "group_size")
    details = a.select("asset_id", "name", "rel_path", "size")
    counted = C.with_usage_count(groups.join(details, "asset_id"), usages_li(spark, d))
    return A.merge_actions(counted, "merge-cluster")


EXACT_ACTIONS = """exact_actions AS (SELECT 'merge-exact:1:' || key AS action_id, 'merge-exact' AS kind,
  CASE WHEN pos = 1 THEN 'keep' ELSE 'drop' END AS role, asset_id, name, size, coalesce(n, 0) AS usage_count,
  key AS cluster_key FROM hash_dups LEFT JOIN (SELECT asset_id, count(*) AS n FROM usages_lab GROUP BY 1) u
  USING (asset_id))"""
CLUSTER_ACTIONS = """cluster_actions AS (SELECT 'merge-cluster:1:' || key AS action_id, 'merge-cluster' AS kind,
  CASE WHEN pos = 1 THEN 'keep' ELSE 'drop' END AS role, asset_id, name, size, coalesce(n, 0) AS usage_count,
  key AS cluster_key FROM name_groups LEFT JOIN (SELECT asset_id, count(*) AS n FROM usages_li GROUP BY 1) u
  USING (asset_id))"""
UNUSED_ACTIONS = """unused_actions AS (SELECT 'delete-unused:1' AS action_id, 'delete-unused' AS kind,
  'drop' AS role, asset_id, name, size, CAST(0 AS BIGINT) AS usage_count, '' AS cluster_key FROM assets_doc
  WHERE asset_id NOT IN (SELECT asset_id FROM usages_lab))"""
ACTION_COLUMNS = ["action_id", "kind", "role", "asset_id", "name", "size", "usage_count", "cluster_key"]


@query(
    "merge_exact_actions",
    with_views(
        ASSETS_DOC, USAGES_LAB, HASH_DOC, EXACT_ACTIONS, body="SELECT * FROM exact_actions"
    ),
)
def merge_exact_actions(spark, d):
    return _exact_actions(spark, d).select(*ACTION_COLUMNS)


@query(
    "merge_cluster_actions",
    with_views(
        ASSETS_PART, USAGES_LI, NAME_PART, CLUSTER_ACTIONS, body="SELECT * FROM cluster_actions"
    ),
)
def merge_cluster_actions(spark, d):
    return _cluster_actions(spark, d).select(*ACTION_COLUMNS)


@query(
    "delete_unused_action",
    with_views(ASSETS_DOC, USAGES_LAB, UNUSED_ACTIONS, body="SELECT * FROM unused_actions"),
)
def delete_unused_action(spark, d):
    rows = unused_assets(assets_doc(spark, d), usages_lab(spark, d))
    return A.delete_unused_action(rows).select(*ACTION_COLUMNS)


def _plan(spark, d):
    a = C.with_usage_count(assets_part(spark, d), usages_li(spark, d))
    promo = a.filter("ext = 'webp'")
    renames = a.filter("ext = 'svg'").withColumns(
        {
            "new_name": F.concat(F.lit("n-"), "name"),
            "new_rel_path": F.concat("dir", F.lit("/n-"), "name"),
        }
    )
    return (
        _cluster_actions(spark, d)
        .unionByName(A.review_action(promo, F.lit("review:1")))
        .unionByName(A.rename_actions(renames))
        .unionByName(_exact_actions(spark, d))
        .unionByName(
            A.delete_unused_action(unused_assets(assets_doc(spark, d), usages_lab(spark, d)))
        )
    )


PLAN = """used AS (SELECT a.*, (SELECT count(*) FROM usages_li u WHERE u.asset_id = a.asset_id) AS usage_count
  FROM assets_part a),
plan AS (SELECT * FROM cluster_actions UNION ALL SELECT * FROM exact_actions UNION ALL SELECT * FROM unused_actions
  UNION ALL SELECT 'review:1', 'review-group', 'review', asset_id, name, size, usage_count, '' FROM used
  WHERE ext = 'webp' UNION ALL SELECT 'rename-asset:' || asset_id, 'rename-asset', 'from', asset_id, name, size,
  usage_count, '' FROM used WHERE ext = 'svg' UNION ALL SELECT 'rename-asset:' || asset_id, 'rename-asset', 'to',
  asset_id, 'n-' || name, size, CAST(0 AS BIGINT), '' FROM used WHERE ext = 'svg')"""
PLAN_VIEWS = [
    ASSETS_DOC, USAGES_LAB, HASH_DOC, EXACT_ACTIONS, UNUSED_ACTIONS, ASSETS_PART, USAGES_LI, NAME_PART,
    CLUSTER_ACTIONS, PLAN,
]


@query(
    "plan_stats",
    with_views(
        *PLAN_VIEWS,
        body="""SELECT count(DISTINCT action_id) AS action_count, count(*) FILTER (role = 'drop') AS file_count,
        CAST(sum(usage_count) FILTER (role = 'drop' OR role = 'from') AS BIGINT) AS ref_count,
        CAST(sum(size) FILTER (role = 'drop') AS BIGINT) AS reclaimable_bytes FROM plan""",
    ),
)
def plan_stats(spark, d):
    return A.plan_stats(_plan(spark, d))


@query(
    "action_titles",
    with_views(
        *PLAN_VIEWS,
        body="""SELECT action_id, CASE kind WHEN 'merge-exact' THEN 'Merge duplicates into ' || first_name
        WHEN 'merge-cluster' THEN 'Merge cluster ' || cluster_key || ' into ' || first_name
        WHEN 'review-group' THEN 'Review ' || n || ' flagged asset' || s
        WHEN 'rename-asset' THEN 'Rename ' || first_name || ' → n-' || first_name
        ELSE 'Delete ' || n || ' unused asset' || s END AS title FROM (SELECT action_id, kind, max(cluster_key)
        AS cluster_key, count(*) FILTER (role IN ('drop', 'review')) AS n, max(name) FILTER (role IN ('keep', 'from'))
        AS first_name, CASE WHEN count(*) FILTER (role IN ('drop', 'review')) = 1 THEN '' ELSE 's' END AS s
        FROM plan GROUP BY 1, 2)""",
    ),
)
def action_titles(spark, d):
    return A.action_titles(_plan(spark, d)).select("action_id", "title")


@query(
    "plan_violations",
    with_views(
        ASSETS_DOC, USAGES_LAB, HASH_DOC, EXACT_ACTIONS,
        body="""SELECT subject, rule FROM (SELECT action_id AS subject, 'drop' AS rule FROM exact_actions
        GROUP BY 1 HAVING max(size) FILTER (role = 'drop') IS NULL OR count(*) FILTER (role = 'drop'
        AND size >= 1000) = 0 UNION ALL SELECT 'Nation ' || n_nationkey, 'slug' FROM nation
        UNION ALL SELECT 'Nation ' || n_nationkey, 'source' FROM nation WHERE n_nationkey = 0 UNION ALL
        SELECT DISTINCT action_id, 'asset_id' FROM exact_actions WHERE asset_id = 0)""",
    ),
)
def plan_violations(spark, d):
    plan = table(spark, d, "nation").selectExpr(
        "'v1' as version", "concat('Nation ', n_nationkey) as id", "n_name as name",
        "cast(n_nationkey as bigint) as source_id",
    )
    # a plan whose small drops were turned into keeps
    role = F.when(F.col("size") < 1000, "keep").otherwise(F.col("role"))
    return A.plan_violations(plan, _exact_actions(spark, d).withColumn("role", role), "v1")


# --- renames -------------------------------------------------------------------------------------

PROPOSAL = (
    "case asset_id % 8 when 0 then name when 1 then upper(name) when 2 then concat(' Mixed Case_', stem, '.', ext, ' ') "
    "when 3 then concat('sub/', name) when 4 then concat(stem, '.bmp') when 5 then 'con.svg' "
    "when 6 then '' else concat('../../../../', name) end"
)


def _proposals(spark, d):
    return assets_part(spark, d).selectExpr("asset_id", f"{PROPOSAL} as new_name")


@query(
    "rename_check",
    with_views(
        ASSETS_PART,
        body="""SELECT asset_id, CASE asset_id % 8 WHEN 0 THEN 'SAME_NAME' || CASE WHEN twins > 1 THEN ',TARGET_EXISTS_DB' ELSE '' END WHEN 1 THEN concat_ws(',',
        CASE WHEN upper(name) = name THEN 'SAME_NAME' END, CASE WHEN upper(name) <> name THEN 'CASE_ONLY_APFS' END)
        WHEN 2 THEN '' WHEN 3 THEN 'ILLEGAL_CHAR' WHEN 4 THEN 'EXTENSION_CHANGED' WHEN 5 THEN concat_ws(',',
        'RESERVED_NAME', CASE WHEN ext <> 'svg' THEN 'EXTENSION_CHANGED' END)
        WHEN 6 THEN 'EMPTY_NAME' ELSE 'ILLEGAL_CHAR,TRAVERSAL' END AS conflicts,
        CASE asset_id % 8 WHEN 2 THEN 'CONTAINS_SPACE,UPPERCASE,MIXED_SEPARATORS' ELSE '' END AS tips
        FROM (SELECT *, count(*) OVER (PARTITION BY rel_path) AS twins FROM assets_part)""",
    ),
)
def rename_check(spark, d):
    found = R.rename_check(_proposals(spark, d), assets_part(spark, d), case_insensitive=True)
    return found.select(
        "asset_id",
        F.array_join("conflicts", ",").alias("conflicts"),
        F.array_join("tips", ",").alias("tips"),
    )


@query(
    "rename_target_taken",
    with_views(
        ASSETS_DOC,
        body="""SELECT a.asset_id FROM assets_doc a JOIN assets_doc b ON b.dir = a.dir
        AND b.asset_id = a.asset_id + 20""",
    ),
)
def rename_target_taken(spark, d):
    a = assets_doc(spark, d)
    proposals = a.selectExpr("asset_id", "concat('doc-', asset_id + 20, '.', ext) as new_name")
    found = R.rename_check(proposals, a)
    return found.filter("array_contains(conflicts, 'TARGET_EXISTS_DB')").select("asset_id")


ROOTS = "case when n_nationkey < 6 then element_at(array('economy', 'small', 'promo', 'large', 'medium', 'standard'), n_nationkey + 1) else concat('x', n_nationkey) end"


@query(
    "rename_warnings",
    with_views(
        ASSETS_PART,
        body="""SELECT asset_id, 'AMBIGUOUS_FILENAME' AS warning FROM assets_part QUALIFY count(*) OVER (PARTITION BY name) > 1
        UNION ALL SELECT asset_id, 'SHARED_ACROSS_SOURCES' FROM assets_part WHERE split_part(dir, '/', 1) IN
        ('economy', 'promo', 'large', 'medium', 'standard')""",
    ),
)
def rename_warnings(spark, d):
    sources = table(spark, d, "nation").selectExpr(
        "cast(n_nationkey as bigint) as id", f"concat('/repo/', {ROOTS}, '/') as root"
    )
    return R.rename_warnings(_proposals(spark, d), assets_part(spark, d), sources)


@query(
    "affected_usages",
    with_views(
        ASSETS_PART,
        body="""SELECT l_partkey AS asset_id, l_shipmode = 'ext' AS external, count(*) AS n FROM (SELECT l_partkey,
        CASE WHEN l_returnflag = 'A' THEN 'ext' ELSE 'own' END AS l_shipmode FROM lineitem) GROUP BY 1, 2""",
    ),
)
def affected_usages(spark, d):
    usages = table(spark, d, "lineitem").selectExpr(
        one_source("l_partkey"), "l_partkey as asset_id",
        "concat(if(l_returnflag = 'A', '/elsewhere/', '/repo/'), l_orderkey) as abs_path",
    )
    sources = table(spark, d, "region").selectExpr(
        "cast(r_regionkey as bigint) as id", "if(r_regionkey = 1, '/repo', '/other') as root"
    )
    found = R.affected_usages(_proposals(spark, d), usages, sources)
    return found.groupBy("asset_id", "external").agg(F.count("*").alias("n"))


@query(
    "rewritten_lines",
    with_views(
        ASSETS_PART,
        body="""SELECT o_orderkey AS usage_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE 'see ' || CASE WHEN
        o_orderstatus = 'F' THEN 'NEW.png' ELSE 'new.png' END || ' ' || upper(name) END AS after,
        o_orderstatus = 'P' AS stale FROM orders JOIN assets_part ON asset_id = o_custkey""".replace(
            "CASE WHEN\n        o_orderstatus = 'F' THEN 'NEW.png' ELSE 'new.png' END", "'new.png'"
        ),
    ),
)
def rewritten_lines(spark, d):
    names = assets_part(spark, d).select("asset_id", "name")
    refs = table(spark, d, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as asset_id", "concat('o', o_orderkey) as rel_path", "1 as line",
        "o_orderstatus as status",
    )
    lines = refs.join(names, "asset_id").selectExpr(
        "rel_path", "1 as line_no",
        "if(status = 'P', 'gone', concat('see ', if(status = 'F', upper(name), name), ' ', upper(name))) as line",
    )
    renames = names.withColumn("new_name", F.lit("new.png"))
    found = R.rewrite_lines(renames, refs.drop("status"), lines)
    return found.select("usage_id", "after", "stale")


@query(
    "reclaimable_by_folder",
    with_views(
        ASSETS_PART, HASH_PART,
        body="""SELECT split_part(rel_path, '/', 1) AS folder, count(*) AS duplicates, CAST(sum(per_file_size) AS BIGINT)
        AS bytes FROM hash_dups WHERE role = 'member' GROUP BY 1""",
    ),
)
def reclaimable_by_folder(spark, d):
    a = assets_part(spark, d)
    report = C.exact_duplicates(K.hash_clusters(a), a, usages_li(spark, d))
    return (
        report.filter("role = 'member'")
        .groupBy(F.substring_index("rel_path", "/", 1).alias("folder"))
        .agg(F.count("*").alias("duplicates"), F.sum("per_file_size").alias("bytes"))
    )
