"""Incremental merge, storage, streaming, files, plans and renames."""

from __future__ import annotations

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from asset_atlas.operators import catalog as C
from asset_atlas.operators import clusters as K
from asset_atlas.operators import incremental as N
from asset_atlas.operators import insights as I
from asset_atlas.operators.match import within
from asset_atlas.plans import actions as A
from asset_atlas.plans import rename as R
from asset_atlas.schemas import ASSETS, STYLE_USAGES
from asset_atlas.sources import files as S
from asset_atlas.sources import sinks
from asset_atlas.streaming.ingest import compact, read_assets, start_ingest, write_batch


def png(width, height, pixel):
    """Minimal RGB PNG; ``pixel(x, y)`` gives a grey level."""
    rows = b"".join(
        b"\0" + bytes(v for x in range(width) for v in [pixel(x, y)] * 3) for y in range(height)
    )

    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "icons").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "icons" / "falling.png").write_bytes(png(18, 16, lambda x, y: 255 - x * 10))
    (root / "icons" / "copy.PNG").write_bytes(png(18, 16, lambda x, y: 255 - x * 10))
    (root / "white.png").write_bytes(png(20, 20, lambda x, y: 255))
    (root / "broken.png").write_bytes(b"not an image")
    (root / "icons" / "home-24.svg").write_text(
        '<svg viewBox="0 0 24 24"><path fill="#FFF" d="M0 0L1 1Z"/></svg>'
    )
    (root / "node_modules" / "x.svg").write_text("<svg/>")
    (root / "app.tsx").write_text('import a from "./icons/home-24.svg";\nconst c = "#402678";\n')
    (root / "theme.CSS").write_text(".a { color: red }\n")
    return root


def test_scan_and_features(spark, repo):
    rows = {r["rel_path"]: r for r in S.build_assets(spark, str(repo), 1).collect()}
    assert set(rows) == {"icons/falling.png", "icons/copy.PNG", "white.png", "broken.png", "icons/home-24.svg"}
    falling = rows["icons/falling.png"]
    assert (falling["width"], falling["height"], falling["ext"], falling["dir"]) == (18, 16, "png", "icons")
    assert falling["phash"] == "ffffffffffffffff" and falling["phash_popcount"] == 64
    assert falling["content_hash"] == rows["icons/copy.PNG"]["content_hash"]
    assert rows["white.png"]["white_fraction"] == 1.0 and rows["white.png"]["dominant_color"] == "#ffffff"
    assert rows["broken.png"]["width"] is None and rows["broken.png"]["category"] == "other"
    svg = rows["icons/home-24.svg"]
    assert (svg["width"], svg["commands_count"], svg["literal_colors"], svg["stem"]) == (24, 3, ["#fff"], "home-24")
    assert [r["file"] for r in S.failures(S.build_assets(spark, str(repo), 1)).collect()] == ["broken.png"]


def test_scan_code(spark, repo):
    rows = {r["rel_path"]: r["ext"] for r in S.scan_code(spark, str(repo), 1).collect()}
    assert rows == {"app.tsx": "tsx", "theme.CSS": "css"}
    assert S.scan_style_files(spark, str(repo), 1).count() == 2


def test_vanished_root_stops_the_run(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        N.require_root(spark, str(tmp_path / "gone"))


def asset(spark, **values):
    names = [f.strip().split(" ")[0] for f in ASSETS.split(", ")]
    return spark.createDataFrame([tuple(values.get(n) for n in names)], ASSETS)


def test_upsert_rules(spark):
    stored = asset(
        spark, asset_id=7, source_id=1, abs_path="/a", content_hash="h1", size=1, mtime=1, author="ann",
        embedding=[1.0], embed_status="ok", white_fraction=0.5, width=3,
    )
    cols = "source_id bigint, abs_path string, content_hash string, size bigint, mtime bigint, width int"
    same = spark.createDataFrame([(1, "/a", "h1", 2, 5, 4), (1, "/b", "x", 1, 1, 1)], cols)
    rows = {r["abs_path"]: r for r in N.upsert(stored, same).collect()}
    assert rows["/a"]["asset_id"] == 7 and rows["/a"]["size"] == 2 and rows["/a"]["author"] == "ann"
    assert rows["/a"]["embedding"] == [1.0] and rows["/a"]["embed_status"] == "ok"
    assert rows["/b"]["asset_id"] == 8 and rows["/b"]["embedding"] is None
    other = spark.createDataFrame([(1, "/a", "h2", 2, 5, 4), (1, "/a", "old", 2, 3, 4)], cols)
    (row,) = N.upsert(stored, other).collect()
    assert (row["content_hash"], row["embedding"], row["embed_status"], row["white_fraction"]) == ("h2", None, None, None)


def test_dense_ids_are_dense_and_stable(spark):
    df = spark.createDataFrame([(f"/p{i}",) for i in range(300)], "abs_path string")
    first = {r["abs_path"]: r["asset_id"] for r in N.dense_ids(df, "abs_path", F.lit(10)).collect()}
    again = {r["abs_path"]: r["asset_id"] for r in N.dense_ids(df.repartition(5), "abs_path", F.lit(10)).collect()}
    assert first == again and sorted(first.values()) == list(range(11, 311))


def test_delete_missing_keeps_other_sources(spark):
    stored = spark.createDataFrame([(1, "/a"), (1, "/b"), (2, "/b2")], "source_id bigint, abs_path string")
    scanned = spark.createDataFrame([("/a",)], "abs_path string")
    assert {r["abs_path"] for r in N.delete_missing(stored, scanned, 1).collect()} == {"/a", "/b2"}
    assert {r["abs_path"] for r in N.delete_missing(stored, scanned.limit(0), 1).collect()} == {"/b2"}


def test_rebuild_purges_kinds_that_became_empty(spark, tmp_path):
    path = str(tmp_path / "styles")
    schema = "source_id bigint, kind string, v int"
    both = spark.createDataFrame([(1, "color", 1), (1, "type", 2), (2, "color", 3)], schema)
    sinks.rebuild(both, path, [1, 2], ["color", "type"])
    sinks.rebuild(spark.createDataFrame([(1, "type", 9)], schema), path, [1], ["color", "type"])
    rows = {(r["source_id"], r["kind"], r["v"]) for r in sinks.read_table(spark, path, schema).collect()}
    assert rows == {(1, "type", 9), (2, "color", 3)}


def test_failed_stage_leaves_its_kind_empty(spark, tmp_path):
    path, schema = str(tmp_path / "styles"), "source_id bigint, kind string, v int"
    rows = spark.createDataFrame([(1, "color", 1), (1, "type", 2)], schema)
    done = sinks.run_stage(spark, "all", lambda: rows, path, [1], ["color", "type"])

    def broken():
        raise ValueError("bad file")

    failed = sinks.run_stage(spark, "color-extract", broken, path, [1], ["color"])
    metrics = N.stage_metrics(done.unionByName(failed)).collect()
    assert [(r["stage"], r["failed"]) for r in metrics] == [("all", False), ("color-extract", True)]
    left = sinks.read_table(spark, path, schema).collect()
    assert [(r["kind"], r["v"]) for r in left] == [("type", 2)]


def test_query_signatures_against_the_catalogue(spark, repo, tmp_path):
    from asset_atlas.operators.match import match

    assets = N.upsert(spark.createDataFrame([], ASSETS), S.build_assets(spark, str(repo), 1))
    asked = tmp_path / "asked"
    asked.mkdir()
    (asked / "home-48.svg").write_bytes((repo / "icons" / "home-24.svg").read_bytes())
    (asked / "huge.svg").write_text("<svg>" + " " * (2 * 1024 * 1024) + "</svg>")
    queries = S.query_signatures(spark, str(asked), 1)
    found = match(queries, assets).collect()
    assert [(r["bucket"], r["score"]) for r in found] == [("exact", 1.0)]


def test_streaming_ingest_is_incremental(spark, repo, tmp_path):
    table, state = str(tmp_path / "assets"), str(tmp_path / "state")
    assert read_assets(spark, table).count() == 0 and compact(spark, table) == 0
    start_ingest(spark, str(repo), 1, table, state).awaitTermination()
    assert compact(spark, table) == 5
    first = {r["rel_path"]: r["asset_id"] for r in read_assets(spark, table).collect()}
    assert len(first) == 5 and sorted(first.values()) == [1, 2, 3, 4, 5]
    (repo / "late.svg").write_text("<svg/>")
    start_ingest(spark, str(repo), 1, table, state).awaitTermination()
    assert read_assets(spark, table).count() == 5
    assert compact(spark, table) == 1 and compact(spark, table) == 0
    second = {r["rel_path"]: r["asset_id"] for r in read_assets(spark, table).collect()}
    assert second == {**first, "late.svg": 6}


def test_streamed_features_survive(spark, repo, tmp_path):
    table, state = str(tmp_path / "assets"), str(tmp_path / "state")
    start_ingest(spark, str(repo), 1, table, state).awaitTermination()
    compact(spark, table)
    columns = ["rel_path", "width", "height", "phash", "phash_popcount", "category", "dominant_color"]
    want = {r["rel_path"]: r for r in S.build_assets(spark, str(repo), 1).select(columns).collect()}
    got = {r["rel_path"]: r for r in read_assets(spark, table).select(columns).collect()}
    assert got == want and any(r["phash"] for r in want.values())
    # a later row without features keeps what is stored for the same content
    (kept,) = read_assets(spark, table).filter("phash is not null").limit(1).collect()
    names = ["source_id", "abs_path", "content_hash", "size", "mtime"]
    bare = spark.createDataFrame(
        [tuple(kept[c] for c in names)], "source_id bigint, abs_path string, content_hash string, size bigint, mtime bigint"
    )
    write_batch(bare, 99, table)
    compact(spark, table)
    (again,) = read_assets(spark, table).filter(F.col("abs_path") == kept["abs_path"]).collect()
    assert again == kept


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    table = str(tmp_path / "assets")
    schema = "source_id bigint, abs_path string, content_hash string, size bigint, mtime bigint"
    rows = spark.createDataFrame([(1, "/a", "h", 1, 1), (1, "/a", "newer", 1, 2)], schema)
    for _ in range(2):
        write_batch(rows, 0, table)
    compact(spark, table)
    (row,) = read_assets(spark, table).collect()
    assert (row["asset_id"], row["content_hash"]) == (1, "newer")


def duplicates(spark):
    rows = [
        (1, 1, "b/x.svg", "b", "x.svg", "x", "svg", 10, "h"),
        (1, 2, "a/x.svg", "a", "x.svg", "x", "svg", 10, "h"),
        (1, 3, "c/y,\"1\".svg", "c", "y,\"1\".svg", "y", "svg", 10, "h"),
        (1, 4, "c/z.svg", "c", "z.svg", "z", "svg", 5, "other"),
    ]
    assets = spark.createDataFrame(
        rows,
        "source_id bigint, asset_id bigint, rel_path string, dir string, name string, stem string, ext string, size bigint, content_hash string",
    )
    usages = spark.createDataFrame([(1, 1), (2, 3), (3, 3)], "id bigint, asset_id bigint")
    return assets, usages, C.exact_duplicates(K.hash_clusters(assets), assets, usages)


def test_duplicate_report_order_and_sinks(spark, tmp_path):
    assets, usages, report = duplicates(spark)
    rows = report.orderBy(*C.exact_duplicate_order()).collect()
    assert [(r["role"], r["asset_id"]) for r in rows] == [("member", 1), ("member", 3), ("canonical", 2)]
    assert rows[0]["reclaimable_bytes"] == 20 and rows[0]["canonical_id"] == 2
    plan = A.merge_actions(report)
    sinks.write_plan_csv(plan, str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "csv"))
    assert back.columns == A.COLUMNS
    assert "y,\"1\".svg" in {r["name"] for r in back.collect()}
    sinks.write_plan_json(plan, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    sinks.write_duplicate_report(report, str(tmp_path / "report"))
    line = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert line["canonical"]["asset_id"] == 2 and line["group_size"] == 3


def test_plan_stats_and_validation(spark):
    _, _, report = duplicates(spark)
    plan = A.merge_actions(report)
    stats = A.plan_stats(plan).first()
    assert tuple(stats) == (1, 2, 3, 20)
    head = spark.createDataFrame([("v1", "my-plan", "p", 1)], "version string, id string, name string, source_id bigint")
    assert A.plan_violations(head, plan, "v1").count() == 0
    bad = A.plan_violations(head, plan.filter("role = 'keep'"), "v2").collect()
    assert {r["rule"] for r in bad} == {"version", "drop"}


def test_folder_scope_is_not_a_name_prefix(spark):
    df = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a_/c",)], "dir string")
    assert {r["dir"] for r in df.filter(C.in_folder("a")).collect()} == {"a", "a/b"}


def test_rename_check_rules(spark):
    assets = spark.createDataFrame(
        [(1, 1, "icons", "a.svg", "svg", "icons/a.svg"), (1, 2, "icons", "b.svg", "svg", "icons/b.svg"), (1, 3, "", "c.svg", "svg", "c.svg")],
        "source_id bigint, asset_id bigint, dir string, name string, ext string, rel_path string",
    )

    def codes(asset_id, name, **kw):
        p = spark.createDataFrame([(asset_id, name)], "asset_id bigint, new_name string")
        r = R.rename_check(p, assets, **kw).first()
        return r["conflicts"], r["tips"], r["new_rel_path"]

    assert codes(1, " new.svg ") == ([], [], "icons/new.svg")
    assert codes(1, "b.svg")[0] == ["TARGET_EXISTS_DB"]
    assert codes(1, "")[0][0] == "EMPTY_NAME"
    assert codes(1, "a?.svg")[0] == ["ILLEGAL_CHAR"]
    assert codes(1, "x/a.svg")[0] == ["ILLEGAL_CHAR"]
    assert codes(1, "con.svg")[0] == ["RESERVED_NAME"]
    assert codes(1, "é" * 130 + ".svg")[0] == ["NAME_TOO_LONG"]
    assert codes(1, "a.png")[0] == ["EXTENSION_CHANGED"]
    assert codes(1, "a.svg")[0] == ["SAME_NAME"]
    assert codes(1, "A.svg")[0] == []
    assert codes(1, "A.svg", case_insensitive=True)[0] == ["CASE_ONLY_APFS"]
    assert "TRAVERSAL" in codes(3, "../c.svg")[0]
    assert codes(1, "My_new-Icon__é.svg")[1] == ["UPPERCASE", "MIXED_SEPARATORS", "DOUBLE_SEPARATOR", "NON_ASCII"]


def test_rewrite_lines(spark):
    usages = spark.createDataFrame(
        [(1, 1, "f.ts", 1), (2, 1, "f.ts", 1), (3, 1, "f.ts", 2), (4, 1, "f.ts", 9)],
        "id bigint, asset_id bigint, rel_path string, line int",
    )
    renames = spark.createDataFrame([(1, "a.svg", "b.svg")], "asset_id bigint, name string, new_name string")
    lines = spark.createDataFrame([("f.ts", 1, "x A.svg y a.svg"), ("f.ts", 2, "none")], "rel_path string, line_no int, line string")
    got = {r["usage_id"]: (r["after"], r["stale"]) for r in R.rewrite_lines(renames, usages, lines).collect()}
    assert got == {1: ("x b.svg y a.svg", False), 2: ("x b.svg y b.svg", False), 3: (None, True), 4: (None, True)}


def styles(spark, *rows):
    names = [f.strip().split(" ")[0] for f in STYLE_USAGES.split(", ")]
    base = {"source_id": 1, "kind": "color", "raw_token": "x", "context_kind": "css-decl"}
    data = []
    for i, r in enumerate(rows):
        full = {**base, "rel_path": f"f{i}.css", **r}
        data.append(tuple(full.get(n) for n in names))
    return spark.createDataFrame(data, STYLE_USAGES)


def test_color_coverage_and_usage(spark):
    ref = {"context_kind": "css-var-ref"}
    rows = styles(
        spark,
        {"context_kind": "css-var-def", "context_detail": "--brand", "normalized_value": "#402678"},
        *[{**ref, "context_detail": "--brand"}] * 3,
        *[{**ref, "context_detail": "--space"}] * 2,
        {"context_detail": "color", "normalized_value": "#ff0000"},
        {"context_kind": "tailwind-named"},
        {"kind": "type", "normalized_value": "#402678"},
    )
    c = I.color_coverage(rows).first()
    assert (c["tokenized"], c["literal"], c["definitions"], c["not_scored"], c["unresolved_vars"]) == (3, 1, 1, 1, 2)
    assert c["pct"] == 0.75
    stats = {r["color"]: (r["usage_count"], r["file_count"]) for r in I.color_stats(rows).collect()}
    assert stats == {"#402678": (4, 4), "#ff0000": (1, 1)}
    assert I.color_stats(styles(spark).limit(0)).count() == 0


def test_color_drift_token_place_and_order(spark):
    members = "source_id bigint, kind string, key string, canonical string, size bigint, neutral boolean, max_distance double, axis string, metric string, value string, role string, distance double, usage_count bigint"

    def cluster(canonical, variant, neutral):
        head = (1, "color", canonical, canonical, 2, neutral, 0.21, None, "deltaE")
        return [(*head, canonical, "canonical", None, 100), (*head, variant, "variant", 0.21, 3)]

    clusters = spark.createDataFrame(
        cluster("#808080", "#818181", True) + cluster("#402678", "#3f2678", False), members
    )
    rows = styles(
        spark,
        {"context_kind": "css-var-def", "context_detail": "--brand", "normalized_value": "#402678"},
        {"context_kind": "css-var-def", "context_detail": "--alias", "normalized_value": "#402678"},
        *[{"context_kind": "css-var-ref", "context_detail": "--brand"}] * 2,
        {"context_kind": "css-var-ref", "context_detail": "--alias"},
        {"context_detail": "color", "normalized_value": "#3f2678", "rel_path": "drift.css", "line": 12},
    )
    drift = I.color_drift(clusters, rows)
    got = drift.orderBy(*I.drift_order("color")).collect()
    assert [(r["canonical"], r["suggested_token"]) for r in got] == [("#402678", "--brand"), ("#808080", "#808080")]
    assert (got[0]["file"], got[0]["line"]) == ("drift.css", 12)
    top = I.drift_list(drift, "color", 1)
    assert [r["canonical"] for r in top.collect()] == ["#402678"]
    changed = spark.createDataFrame([("drift.css",)], "path string")
    assert I.drift_list(drift, "color", 10, changed).count() == 1


def test_token_resolution(spark):
    candidates = spark.createDataFrame(
        [(1, "#1c7a74", "--color-accent"), (1, "#2d8a52", None), (1, "#123456", "--color-rare"), (2, "#000000", None), (2, "#000000", "--black")],
        "source_id bigint, color string, token string",
    )
    values = spark.createDataFrame(
        [(1, "#1c7a75"), (1, "#123456"), (1, "#2e8b53"), (1, "#e11d48"), (2, "#000000"), (3, "#000000")],
        "source_id bigint, value string",
    )
    got = {(r["source_id"], r["value"]): r for r in I.resolve_tokens(values, candidates).collect()}
    assert got[1, "#1c7a75"]["token"] == "--color-accent" and got[1, "#1c7a75"]["within"]
    assert got[1, "#123456"]["token"] == "--color-rare"
    assert got[1, "#2e8b53"]["within"] and got[1, "#2e8b53"]["token"] is None
    assert not got[1, "#e11d48"]["within"] and got[1, "#e11d48"]["nearest"] is not None
    assert got[2, "#000000"]["token"] == "--black"
    assert not got[3, "#000000"]["within"] and got[3, "#000000"]["nearest"] is None


def test_type_locations_keep_axes_apart(spark):
    rows = styles(
        spark,
        {"kind": "type", "axis": "size", "normalized_value": "400", "rel_path": "size.css", "line": 5},
        {"kind": "type", "axis": "weight", "normalized_value": "400", "rel_path": "a.css", "line": 1},
        {"kind": "type", "axis": "size", "normalized_value": "400", "rel_path": "a.css"},
    )
    got = {r["axis"]: (r["file"], r["line"]) for r in I.representative_locations(rows, "type").collect()}
    assert got == {"size": ("size.css", 5), "weight": ("a.css", 1)}


def test_context_weights(spark):
    cases = [
        ("css-decl", "background", 1.0), ("css-var-def", "--brand", 1.0), ("css-decl", "border", 0.3),
        ("css-decl", "border-top-color", 0.3), ("css-var-ref", "--brand", 0.8), ("tailwind-arbitrary", "bg", 1.0),
        ("tailwind-arbitrary", "ring", 0.6), ("svg-attr", None, 0.5), ("js-literal", None, 0.6), ("css-decl", "stroke", 0.6),
    ]
    df = spark.createDataFrame(cases, "k string, d string, w double")
    assert all(r["x"] == r["w"] for r in df.select("w", I.context_weight(F.col("k"), F.col("d")).alias("x")).collect())


def test_reader_threshold(spark):
    rows = spark.createDataFrame([("near", 12), ("near", 13), ("exact", None)], "bucket string, hamming int")
    assert within(rows).count() == 2


def test_even_sample_and_positions(spark):
    df = spark.createDataFrame([(i,) for i in range(101)], "k bigint").repartition(6)
    got = sorted(r["k"] for r in C.sample_evenly(df, ["k"], 30, 7).collect())
    assert got == [int(i * (101 / 30)) for i in range(30)]
    assert C.sample_evenly(df, ["k"], 200, 3).count() == 101
