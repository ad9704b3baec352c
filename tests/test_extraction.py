"""Extraction from source text snippets."""

from __future__ import annotations

import re

import pytest

from asset_atlas.operators.styles import extract_styles
from asset_atlas.operators.text import code_lines, left_out, regex_hits, with_block_state
from asset_atlas.operators.usages import FILE_NAME, reference_hits, scan_usages
from asset_atlas.session import cut
from asset_atlas.schemas import CODE_FILES


def files(spark, *items):
    rows = [(1, path, f"/r/{path}", path.rsplit(".", 1)[-1], text) for path, text in items]
    return spark.createDataFrame(rows, CODE_FILES)


def hits(spark, kind, path, text):
    rows = extract_styles(files(spark, (path, text)), kind).collect()
    for r in rows:
        assert text[r["start_offset"] : r["end_offset"]] == r["raw_token"]
    return sorted((r["raw_token"], r["normalized_value"], r["context_kind"], r["context_detail"]) for r in rows)


CSS = """.a { color: #402678; }
.b { background: red; }
:root { --brand: #3f2678; }
.c { color: var(--brand); }
.d { font-family: Georgia, serif; }
#face { color: #1c7a74; }
"""


def test_css_colors(spark):
    assert hits(spark, "color", "a.css", CSS) == [
        ("#1c7a74", "#1c7a74", "css-decl", "color"),
        ("#3f2678", "#3f2678", "css-var-def", "--brand"),
        ("#402678", "#402678", "css-decl", "color"),
        ("red", "#ff0000", "css-decl", "background"),
        ("var(--brand)", None, "css-var-ref", "--brand"),
    ]


def test_js_colors(spark):
    text = 'const c = "#402678"; const status = "red";\n<div className="bg-[#402678] text-red-500" />'
    assert hits(spark, "color", "a.tsx", text) == [
        ("#402678", "#402678", "js-literal", None),
        ("bg-[#402678]", "#402678", "tailwind-arbitrary", "bg"),
        ("text-red-500", None, "tailwind-named", "text"),
    ]


def test_functions_and_overlaps(spark):
    text = ".a { border: 1px solid rgba(255, 0, 0, .5); background: url(#fff) var(--x, #abc) none }"
    assert hits(spark, "color", "a.scss", text) == [
        ("#fff", "#ffffff", "css-decl", "background"),
        ("rgba(255, 0, 0, .5)", "#ff0000", "css-decl", "border"),
        ("var(--x, #abc)", None, "css-var-ref", "--x"),
    ]


@pytest.mark.parametrize(
    "path,text",
    [
        ("a.ts", 'const c = "#abc1234";'),
        ("a.ts", "// #402678"),
        ("a.css", "/* .x { color: #402678; }\n .y { color: #111111; } */"),
        ("a.md", "color: #402678"),
        ("a.json", '{"c": "#402678"}'),
        ("src/theme.spec.css", ".a { color: #402678; }"),
        ("src/__tests__/theme.ts", 'const c = "#402678"'),
        ("tests/unit/_colors.scss", ".a { color: #402678; }"),
        ("lib/x.min.css", ".a { color: #402678; }"),
    ],
)
def test_no_colors(spark, path, text):
    assert hits(spark, "color", path, text) == []


def test_limits_are_opt_in_and_leave_a_trace(spark):
    big = files(spark, ("a.css", ".a { color: #402678; }" + " " * 60_000), ("b.css", ".b { color: red; }"))
    assert extract_styles(big, "color").count() == 2
    assert extract_styles(big, "color", max_line=50_000).count() == 1
    assert [r["file"] for r in left_out(big, max_line=50_000).collect()] == ["a.css"]
    assert [r["file"] for r in left_out(big, max_chars=30).collect()] == ["a.css"]
    assert left_out(big).isEmpty()


def test_many_lines_and_hits_in_one_file(spark):
    lines = [f'x{i}.png /* y{i}.svg' if i % 7 == 0 else f'*/ "z{i}.png"' if i % 7 == 3 else f"w{i}.gif v{i}.png" for i in range(900)]
    lines.append(" ".join(f"q{i}.png" for i in range(1500)))
    text = "\n".join(lines)
    found = reference_hits(files(spark, ("a.css", text))).collect()
    want = [(n, c) for n, line in enumerate(lines, 1) for c in [m.start() for m in re.finditer(r"[a-z0-9]+\.(?:png|svg|gif)", line)]]
    assert sorted((r["line"], r["col"]) for r in found) == want
    spread = {r["line_no"]: (r["line_offset"], r["in_js"]) for r in code_lines(files(spark, ("a.css", text))).collect()}
    state, offset = False, 0
    for n, line in enumerate(lines, 1):
        assert spread[n] == (offset, state)
        net = line.count("/*") - line.count("*/")
        state = True if net > 0 else False if net < 0 else state
        offset += len(line) + 1


def test_css_type(spark):
    text = (
        '.a { font-size: 13px; font-family: "Inter", sans-serif /*rtl:x*/; font-weight: bold; }\n'
        ".b { font-size: 0.8125rem; line-height: 1.5; font-weight: 50% }\n"
        ".c { font-size: var(--fs); font-family: $font-family-base; }"
    )
    assert hits(spark, "type", "a.scss", text) == [
        ('"Inter", sans-serif', "inter, sans-serif", "css-decl", "font-family"),
        ("0.8125rem", "13", "css-decl", "font-size"),
        ("1.5", "1.5", "css-decl", "line-height"),
        ("13px", "13", "css-decl", "font-size"),
        ("50%", None, "css-decl", "font-weight"),
        ("bold", "700", "css-decl", "font-weight"),
        ("var(--fs)", None, "css-var-ref", "--fs"),
    ]


def test_js_type_and_family_guard(spark):
    text = (
        'const a = { fontSize: "16px", fontWeight: 600 };\n'
        "const b = { fontFamily: theme.typography.fontFamily };\n"
        "type T = { fontFamily: string };\n"
        'const c = { fontFamily: "Inter" + theme.fallback };\n'
        "const d = { fontFamily: 'Inter, serif' };"
    )
    assert hits(spark, "type", "a.ts", text) == [
        ("'Inter, serif'", "inter, serif", "js-literal", "fontFamily"),
        ("16px", "16", "js-literal", "fontSize"),
        ("600", "600", "js-literal", "fontWeight"),
    ]


def test_tailwind_type(spark):
    text = '<p class="text-sm font-bold font-sans leading-6 text-red-500">'
    assert [h[0] for h in hits(spark, "type", "a.html", text)] == [
        "font-bold", "font-sans", "leading-6", "text-sm"
    ]


def test_line_state_agrees_with_the_window_form(spark):
    text = "\n".join(
        ["a", "/* open", "b", "c */ d", "<!-- x", "y -->", "/* z */", "*/", "/*", "e"] * 60
    )
    rows = code_lines(files(spark, ("a.vue", text)))
    offset, lines = 0, text.split("\n")
    got = sorted(rows.collect(), key=lambda r: r["line_no"])
    assert [r["line"] for r in got] == lines
    for r, line in zip(got, lines, strict=True):
        assert r["line_offset"] == offset
        offset += len(line) + 1
    window = with_block_state(rows.drop("in_js", "in_html"), ["rel_path"])
    expect = {r["line_no"]: (r["in_js"], r["in_html"]) for r in window.collect()}
    assert {r["line_no"]: (r["in_js"], r["in_html"]) for r in got} == expect


def test_references(spark):
    assets = spark.createDataFrame(
        [(1, 1, "a.svg"), (1, 2, "a.svg"), (1, 3, "B.PNG"), (2, 4, "a.svg")],
        "source_id bigint, asset_id bigint, name string",
    )
    code = files(
        spark,
        ("x.tsx", 'import a from "./a.svg"; // a.svg\nimport b from "b.png"\nuse("B.PNG") // ok'),
        ("y.html", "<!-- a.svg -->\n<img src=a.svg>"),
    )
    rows = scan_usages(code, assets).collect()
    got = sorted((r["asset_id"], r["rel_path"], r["line"], r["commented"]) for r in rows)
    one = [("x.tsx", 1, False), ("x.tsx", 1, True), ("y.html", 1, True), ("y.html", 2, False)]
    assert got == sorted([(i, *u) for i in (1, 2) for u in one] + [(3, "x.tsx", 3, False)])
    assert reference_hits(code).filter("name = 'b.png'").count() == 1


def test_reference_cap_is_per_asset_and_ordered(spark):
    assets = spark.createDataFrame([(1, 1, "a.svg"), (1, 2, "a.svg")], "source_id bigint, asset_id bigint, name string")
    code = files(spark, *[(f"f{i:03}.ts", "a.svg\n" * 3) for i in range(40)])
    rows = scan_usages(code, assets, cap=50).collect()
    for asset in (1, 2):
        own = sorted((r["rel_path"], r["line"]) for r in rows if r["asset_id"] == asset)
        assert len(own) == 50
        assert own[-1] == ("f016.ts", 2)


def test_usages_broadcast_no_asset(spark):
    assets = cut(spark.createDataFrame([(1, i, f"n{i % 3}.svg") for i in range(9)], "source_id bigint, asset_id bigint, name string"))
    text = "<img src='n1.svg'>\n<img src='n2.svg'> <img src='other.svg'>"
    code = spark.createDataFrame([(1, "a.html", "/a.html", "html", text)], "source_id bigint, rel_path string, abs_path string, ext string, text string")
    for cap in (None, 5):
        found = scan_usages(code, assets, cap)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted((r["asset_id"], r["line"]) for r in found.collect()) == sorted((i, i % 3) for i in range(9) if i % 3)


def test_marks_in_a_line_do_not_move_matches(spark):
    lines = [
        "a.png b.svg", "x a.pngx a.png", "\x01a.png\x01 b.gif", "\x01", "", "no name", "\U0001f600 c.JPEG,d.webp e.jpg", "a.png" * 3,
    ]
    df = spark.createDataFrame([(i, line) for i, line in enumerate([*lines, None])], "i int, line string")
    got = {r["i"]: r["hits"] for r in df.withColumn("hits", regex_hits("line", FILE_NAME)).collect()}
    assert got.pop(len(lines)) is None
    assert {i: [(h["tok"], h["col"]) for h in hs] for i, hs in got.items()} == {
        i: [(m[0], m.start()) for m in re.finditer(FILE_NAME, line)] for i, line in enumerate(lines)
    }


def test_a_line_is_searched_once_for_names(spark):
    plan = reference_hits(files(spark, ("a.html", "a.png")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "line_offset" not in plan


def test_comment_state_where_blocks_open_often(spark):
    text = "<!-- a.png --> b.png <!-- c.png\nd.png --> e.png <!----> f.png\n/* g.png"
    found = {r["name"]: r["commented"] for r in reference_hits(files(spark, ("a.html", text))).collect()}
    assert found == {"a.png": True, "b.png": False, "c.png": True, "d.png": True, "e.png": True, "f.png": True, "g.png": False}
