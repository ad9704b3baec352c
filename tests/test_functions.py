"""Scalar functions on hand-checked values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from asset_atlas.functions import color as P
from asset_atlas.functions import fingerprint as FP
from asset_atlas.functions import names as N
from asset_atlas.functions import typography as T
from asset_atlas.functions.comments import commented_at, syntax


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (0,)], list(values) or ["_"])
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a,b,h",
    [
        ("0f0f0f0f0f0f0f0f", "f0f00f0f0f0f0f0f", 16),
        ("ffffffffffffffff", "0000000000000000", 64),
        ("8000000000000000", "8000000000000001", 1),
        ("00ff", "00ff00ff00ff00ff", 64),
    ],
)
def test_hamming(spark, a, b, h):
    assert one(spark, FP.hamming(F.col("a"), F.col("b")), a=a, b=b) == h


def test_degenerate_bounds(spark):
    rows = [("%016x" % ((1 << k) - 1), k) for k in (0, 11, 12, 52, 53, 64)]
    df = spark.createDataFrame(rows, ["h", "k"]).select("k", FP.is_degenerate(F.col("h")).alias("d"))
    assert {r["k"]: r["d"] for r in df.collect()} == {
        0: True, 11: True, 12: False, 52: False, 53: True, 64: True
    }


def test_dhash_reads_rows_of_nine(spark):
    grid = [0] * 72
    grid[0], grid[9] = 5, 7
    assert one(spark, FP.dhash(F.col("g")), g=grid) == "8080000000000000"


def test_cosine_edges(spark):
    assert one(spark, FP.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[0.0, 0.0]) == 0
    assert one(spark, FP.cosine(F.col("a"), F.col("b")), a=[1.0, 2.0, 9.0], b=[2.0, 4.0]) == pytest.approx(1)


@pytest.mark.parametrize(
    "raw,color,alpha",
    [
        ("#fff", "#ffffff", None),
        ("#F008", "#ff0000", 8 * 17 / 255),
        ("#ff000080", "#ff0000", 128 / 255),
        (" Red ", "#ff0000", None),
        ("transparent", "#000000", 0.0),
        ("rgb(64,38,120)", "#402678", None),
        ("rgba(64, 38, 120, .5)", "#402678", 0.5),
        ("rgb(100% 0% 0% / 50%)", "#ff0000", 0.5),
        ("hsl(120, 100%, 25%)", "#008000", None),
        ("hsl(270deg 60% 70%)", "#b385e0", None),
        ("hwb(0 20% 20%)", "#cc3333", None),
        ("lab(50% 40 59.5)", "#bf5700", None),
        ("oklch(62.8% 0.2577 29.23)", "#ff0000", None),
        ("RebeccaPurple", "#663399", None),
    ],
)
def test_normalize_color(spark, raw, color, alpha):
    got = one(spark, P.normalize_color("v"), v=raw)
    assert got["color"] == color
    assert got["alpha"] == (pytest.approx(alpha) if alpha is not None else None)


@pytest.mark.parametrize("raw", ["var(--x)", "color-mix(in srgb, red, blue)", "$x", "#12345", "hello", ""])
def test_unresolvable_colors(spark, raw):
    assert one(spark, P.normalize_color("v"), v=raw) is None


@pytest.mark.parametrize(
    "a,b,d",
    [("#402678", "#3f2678", 0.2068), ("#808080", "#909090", 5.726), ("#808080", "#a0a0a0", 10.845)],
)
def test_ciede2000(spark, a, b, d):
    assert one(spark, P.ciede2000("a", "b"), a=a, b=b) == pytest.approx(d, abs=1e-3)


def test_published_ciede2000_pairs(spark):
    """Pairs of the published CIEDE2000 test data, among them hue-rotation and grey cases."""
    rows = [
        (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
        (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0000),
        (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
        (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
        (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
        (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
        (2.0776, 0.0795, -1.1350, 0.9033, -0.0636, -0.5514, 0.9082),
    ]
    df = spark.createDataFrame(rows, "l1 double,a1 double,b1 double,l2 double,a2 double,b2 double,d double")
    df = df.selectExpr("struct(l1 as l, a1 as a, b1 as b) as p", "struct(l2 as l, a2 as a, b2 as b) as q", "d")
    for r in df.select(P.delta_e_lab("p", "q").alias("x"), "d").collect():
        assert r["x"] == pytest.approx(r["d"], abs=1e-4)


def test_neutral(spark):
    assert one(spark, P.is_neutral("v"), v="#808080")
    assert not one(spark, P.is_neutral("v"), v="#402678")


@pytest.mark.parametrize(
    "axis,raw,value",
    [
        ("size", "13px", "13"),
        ("size", "0.8125rem", "13"),
        ("size", "11pt", "14.666666666666666"),
        ("size", "50%", None),
        ("size", "3ex", None),
        ("weight", "Bold", "700"),
        ("weight", "normal", "400"),
        ("weight", "lighter", None),
        ("weight", "1001", None),
        ("line-height", "1.50", "1.5"),
        ("line-height", "24px", "24px"),
        ("family", "\t\"Inter\" , Sans-Serif,", "inter, sans-serif"),
        ("family", " , ", None),
    ],
)
def test_normalize_type(spark, axis, raw, value):
    assert one(spark, T.normalize_type(F.col("a"), F.col("r")), a=axis, r=raw) == value


@pytest.mark.parametrize(
    "stem,canonical",
    [
        ("ic-Arrow-left-24-filled", "arrow-left"),
        ("icon-16", "16"),
        ("foo-outline-sm-bold", "foo"),
        ("-sm", "-sm"),
        ("bar_128", "bar_128"),
    ],
)
def test_canonical_stem_is_a_fixpoint(spark, stem, canonical):
    once = N.canonical_stem(F.col("s"))
    assert one(spark, once, s=stem) == canonical
    assert one(spark, N.canonical_stem(once), s=stem) == canonical or canonical == "16"


def test_tokens_and_jaccard(spark):
    assert one(spark, N.name_tokens(F.col("s")), s="Arrow_left.arrow-24 icon-chevron-12345-go") == [
        "arrow", "chevron"
    ]
    assert one(spark, N.jaccard(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z"]) == pytest.approx(1 / 3)


def test_pixel_sizes(spark):
    got = one(spark, N.pixel_suffix(F.col("s")), s="home_24")
    assert (got["canonical"], got["size"]) == ("home", 24)
    assert one(spark, N.pixel_suffix(F.col("s")), s="home-25") is None
    assert one(spark, N.pixel_size_from_path(F.col("d")), d="icons/48/solid") == 48
    assert one(spark, N.pixel_size_from_path(F.col("d")), d="icons/482/solid") is None


def test_accents_fold(spark):
    assert one(spark, N.search_tokens(F.col("s")), s="Éclair Über-7") == ["eclair", "uber", "7"]


def test_query_terms():
    assert N.query_terms("Big-Arrow  24!") == ["big", "arrow", "24"]
    assert N.query_terms("--") == []


@pytest.mark.parametrize(
    "line,pos,ext,in_js,expect",
    [
        ("a // b", 5, "ts", False, True),
        ('"http://x" color', 12, "ts", False, False),
        (" * doc", 3, "ts", False, True),
        ("/* x */ y", 8, "css", False, False),
        ("/* x y", 5, "css", False, True),
        ("live", 1, "css", True, True),
        ("<!-- a --> b", 11, "html", False, False),
        ("<!-- a b", 7, "html", False, True),
        ("// a", 3, "html", False, False),
        ("// a", 3, "vue", False, True),
        ("k: v # note", 8, "yml", False, True),
        ("k: v # note", 3, "yml", False, False),
        ("// a", 3, "json", False, False),
        ("x 'it\\'s // ' y", 14, "ts", False, False),
    ],
)
def test_comment_state(spark, line, pos, ext, in_js, expect):
    col = commented_at(F.col("l"), F.col("p"), syntax(F.col("e")), F.col("j"), F.lit(False))
    assert one(spark, col, l=line, p=pos, e=ext, j=in_js) is expect


def test_categories(spark):
    rows = [("svg", 64, 64, "icon"), ("svg", 65, 10, "illustration"), ("svg", None, 3, "illustration"),
            ("png", 64, 1, "icon"), ("png", 512, 1, "illustration"), ("png", 513, 1, "photo"),
            ("png", None, 1, "other")]
    df = spark.createDataFrame(rows, "e string, w int, h int, c string")
    got = df.select(N.category(F.col("e"), F.col("w"), F.col("h")).alias("g"), "c").collect()
    assert all(r["g"] == r["c"] for r in got)
