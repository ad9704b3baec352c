"""Index runs that open new and changed files only, header sizes, streamed copies."""

from __future__ import annotations

import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from asset_atlas.functions.fingerprint import header_size
from asset_atlas.operators import incremental as N
from asset_atlas.schemas import ASSETS
from asset_atlas.session import cut
from asset_atlas.sources import files as S
from asset_atlas.streaming import ingest as I


def png(width, height):
    def part(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes([40, 80, 120]) * width for _ in range(height))
    return (b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
            + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b""))


def webp(width, height):
    return b"RIFF\0\0\0\0WEBPVP8X\x0a\0\0\0\x10\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    (root / "img [x]").mkdir(parents=True)
    (root / "a.png").write_bytes(png(3, 4))
    (root / "img [x]" / "b.png").write_bytes(png(5, 6))
    (root / "c.svg").write_text('<svg viewBox="0 0 8 9"><path d="M0 0L1 1"/></svg>')
    (root / "d.webp").write_bytes(webp(70, 90))
    return root


def run(spark, root, stored, **more):
    merged, report = S.index_source(spark, str(root), 1, stored, **more)
    return cut(merged), {r["state"]: r["n"] for r in report.collect()}


def test_unchanged_files_are_not_opened(spark, repo):
    none = spark.createDataFrame([], ASSETS)
    first, report = run(spark, repo, none)
    by = {r["rel_path"]: r for r in first.collect()}
    assert report == {"new": 4}
    assert (by["a.png"]["width"], by["img [x]/b.png"]["height"], by["c.svg"]["width"]) == (3, 6, 8)
    assert (by["d.webp"]["width"], by["d.webp"]["height"], by["d.webp"]["category"]) == (70, 90, by["d.webp"]["category"])
    # same size and time, other bytes: only a reader that opens the file could tell
    path = repo / "a.png"
    old = os.stat(path)
    path.write_bytes(b"x" * old.st_size)
    os.utime(path, ns=(old.st_atime_ns, old.st_mtime_ns))
    (repo / "img [x]" / "b.png").write_bytes(png(7, 8))
    os.utime(repo / "img [x]" / "b.png", (1, 1))
    (repo / "e.png").write_bytes(png(2, 2))
    (repo / "c.svg").unlink()
    second, report = run(spark, repo, first)
    now = {r["rel_path"]: r for r in second.collect()}
    assert report == {"same": 2, "changed": 1, "new": 1, "gone": 1}
    assert now["a.png"] == by["a.png"]
    assert now["img [x]/b.png"]["width"] == 7 and now["img [x]/b.png"]["asset_id"] == by["img [x]/b.png"]["asset_id"]
    assert now["e.png"]["asset_id"] > max(r["asset_id"] for r in by.values()) and "c.svg" not in now
    # a full run opens every file and finds the broken one
    third, report = run(spark, repo, second, full=True)
    assert report == {"changed": 3, "same": 0} or report == {"changed": 4}
    broken = {r["rel_path"]: r for r in third.collect()}["a.png"]
    assert broken["content_hash"] != by["a.png"]["content_hash"] and broken["phash"] is None


def test_a_lot_at_a_time(spark, repo):
    listing = S.list_assets(spark, str(repo), 1)
    columns = ["abs_path", "content_hash", "phash", "width"]
    got = S.changed_assets(spark, str(repo), 1, listing, at_once=1).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, S.build_assets(spark, str(repo), 1).select(columns).collect()))


def test_vanished_files_stop_the_run(spark, repo):
    none = spark.createDataFrame([], ASSETS)
    stored, _ = run(spark, repo, none)
    with pytest.raises(FileNotFoundError):
        S.index_source(spark, str(repo / "nowhere"), 1, stored)
    for name in ("a.png", "c.svg"):
        (repo / name).unlink()
    with pytest.raises(N.VanishedSource):
        run(spark, repo, stored, most_gone=0.25)
    assert run(spark, repo, stored, most_gone=0.5)[1] == {"same": 2, "gone": 2}
    for name in ("d.webp", "img [x]/b.png"):
        (repo / name).unlink()
    with pytest.raises(N.VanishedSource):
        run(spark, repo, stored)


def test_other_sources_stay(spark):
    meta = "source_id bigint, abs_path string, size bigint, mtime bigint"
    stored = spark.createDataFrame([(1, "/a", 1, 1, "h", 5), (2, "/b", 1, 1, "g", 9)], meta + ", content_hash string, asset_id bigint")
    listing = spark.createDataFrame([(1, "/a", 1, 1), (1, "/c", 1, 1)], meta)
    merged, _ = N.index_run(listing, stored, lambda p: listing.join(p.select("abs_path"), "abs_path").withColumn(
        "content_hash", F.lit("new")), 1)
    assert {(r["abs_path"], r["content_hash"], r["asset_id"]) for r in merged.collect()} == {
        ("/a", "h", 5), ("/b", "g", 9), ("/c", "new", 10)}


def test_header_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", 4000) + b"\xff\xc0" * 1999 + b"\xff\xc4\0\x05abc" + b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 33, 44) + b"\x03"
    rows = [("png", png(300, 70000 % 5000)), ("jpeg", jpeg), ("webp", webp(1 << 20, 3)), ("cut", png(3, 3)[:18]),
            ("jpegcut", jpeg[:30]), ("none", b""), ("null", None)]
    df = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b in rows], "n string, b binary")
    got = {r["n"]: r["s"] and (r["s"]["width"], r["s"]["height"]) for r in df.select("n", header_size(F.col("b")).alias("s")).collect()}
    assert got["png"] == (300, 0) and got["jpeg"] == (44, 33) and got["webp"] == (1 << 20, 3)
    assert got["jpegcut"] == (None, None) and got["none"] is None and got["null"] is None


def test_copies_inside_and_across_batches(spark, tmp_path):
    schema = "abs_path string, content_hash string, arrived timestamp"
    known = spark.createDataFrame([("z", "old", 1), ("y", "old", 2)], "rel_path string, content_hash string, asset_id bigint")
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def arrive(*rows):
        spark.createDataFrame(rows, "abs_path string, content_hash string, t bigint").selectExpr(
            "abs_path", "content_hash", "timestamp_seconds(t) as arrived").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        I.start_arrival_alerts(stream, known, out, f"{tmp_path}/state").awaitTermination()
        return {r["content_hash"]: (r["first_path"], r["files"], r["known_path"], r["copies"]) for r in I.latest_alerts(spark, out).collect()}

    assert arrive(("a", "one", 5), ("b", "one", 4), ("c", "two", 5)) == {"one": ("b", 2, None, 0)}
    assert arrive(("d", "two", 9), ("e", "old", 9), ("b", "one", 4)) == {
        "one": ("b", 2, None, 0), "two": ("c", 2, None, 0), "old": ("e", 1, "y", 2)}


def test_state_ends_with_the_delay(spark, tmp_path):
    df = spark.createDataFrame([(f"p{i}", "one", 1000 + i) for i in range(3)], "abs_path string, content_hash string, t bigint")
    df.selectExpr("abs_path", "content_hash", "timestamp_seconds(t) as arrived").write.parquet(f"{tmp_path}/in")
    later = spark.createDataFrame([("q", "other", 100000)], "abs_path string, content_hash string, t bigint")
    later.selectExpr("abs_path", "content_hash", "timestamp_seconds(t) as arrived").write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("abs_path string, content_hash string, arrived timestamp").parquet(f"{tmp_path}/in")
    known = spark.createDataFrame([], "rel_path string, content_hash string, asset_id bigint")
    I.start_arrival_alerts(stream, known, f"{tmp_path}/out", f"{tmp_path}/state", delay="10 minutes").awaitTermination()
    assert {(r["content_hash"], r["files"]) for r in I.latest_alerts(spark, f"{tmp_path}/out").collect()} == {("one", 3)}
