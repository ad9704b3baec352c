"""Content and perceptual fingerprints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_ENTROPY = 12
MAX_ENTROPY = 52
SVG_NEAR_MAX = 8
DEGENERATE_WHITE = 0.98
NEAR_WHITE = 250


def phash_bits(hex16: Column) -> Column:
    """16 hex digits to a signed 64-bit long with the same bits."""
    return F.conv(hex16, 16, -10).cast("long")


def bits_to_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def popcount(hex16: Column) -> Column:
    return F.bit_count(phash_bits(hex16))


def popcount_backfill(known: Column, hex16: Column) -> Column:
    return F.coalesce(known, popcount(hex16))


def hamming_bits(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two hex fingerprints; 64 when they cannot be compared."""
    usable = (F.length(a) == F.length(b)) & (F.length(a) > 0)
    return F.when(usable, hamming_bits(phash_bits(a), phash_bits(b))).otherwise(F.lit(64))


def is_degenerate(hex16: Column, lo: int = MIN_ENTROPY, hi: int = MAX_ENTROPY) -> Column:
    return ~popcount(hex16).between(lo, hi)


def is_degenerate_bits(bits: Column, lo: int = MIN_ENTROPY, hi: int = MAX_ENTROPY) -> Column:
    return ~F.bit_count(bits).between(lo, hi)


def dhash(grid: Column) -> Column:
    """Difference hash of a row-major 9x8 grey grid: one bit per left/right neighbour pair."""
    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.lit(0).cast("long"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(
            F.when(
                F.get(grid, (i + F.floor(i / 8)).cast("int"))
                > F.get(grid, (i + F.floor(i / 8)).cast("int") + 1),
                F.lit(1).cast("long"),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )
    return F.when(F.size(grid) == 72, bits_to_hex(bits))


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(
        F.transform(v, lambda x: x.cast("double") / norm)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length, 0 when either side is the zero vector."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)

    def dot(p: Column, q: Column) -> Column:
        products = F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, t: s + t)

    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((n == 0) | (norms == 0), F.lit(0.0)).otherwise(dot(x, y) / norms)


def content_hash(content: Column) -> Column:
    return F.lower(F.lpad(F.hex(F.xxhash64(content)), 16, "0"))


def white_fraction(reds: Column, greens: Column, blues: Column) -> Column:
    """Share of pixels whose three channels all reach the near-white level."""
    pixels = F.arrays_zip(reds.alias("r"), greens.alias("g"), blues.alias("b"))
    white = F.filter(
        pixels,
        lambda p: (p["r"] >= NEAR_WHITE) & (p["g"] >= NEAR_WHITE) & (p["b"] >= NEAR_WHITE),
    )
    return F.when(F.size(pixels) == 0, F.lit(1.0)).otherwise(F.size(white) / F.size(pixels))


def embed_status(white: Column, failed: Column) -> Column:
    return (
        F.when(failed, F.lit("failed"))
        .when(white >= DEGENERATE_WHITE, F.lit("degenerate"))
        .otherwise(F.lit("ok"))
    )


#: an attribute with its value in either kind of quotes
ATTRIBUTE = r"([A-Za-z_][A-Za-z0-9_.:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
_HEX_COLOR = "#[0-9a-fA-F]{3,8}(?![A-Za-z0-9_])"
_COMMA = r"\s*,\s*"
_RGB_COLOR = r"(?i)rgba?\(\s*" + _COMMA.join(["[0-9]+"] * 3) + rf"(?:{_COMMA}[0-9.]+)?\s*\)"


def attributes(markup: Column) -> Column:
    """Attributes in order as array<struct<name, value>>, names in lower case."""
    return F.transform(
        F.regexp_extract_all(markup, F.lit(ATTRIBUTE), F.lit(0)),
        lambda t: F.struct(
            F.lower(F.regexp_extract(t, ATTRIBUTE, 1)).alias("name"),
            F.concat(F.regexp_extract(t, ATTRIBUTE, 2), F.regexp_extract(t, ATTRIBUTE, 3)).alias("value"),
        ),
    )


def svg_stats(text: Column) -> Column:
    """Structure counts, stroke widths and literal colours of one SVG document."""

    def values(attrs: Column, name: str) -> Column:
        return F.filter(attrs, lambda a: (a["name"] == name) & (a["value"] != ""))["value"]

    everything = attributes(text)
    tags = F.regexp_extract_all(text, F.lit("<([A-Za-z][^>]*)"), F.lit(1))
    paths = F.filter(tags, lambda t: F.lower(F.regexp_extract(t, "^[A-Za-z0-9_]+", 0)) == "path")
    bodies = F.filter(
        F.transform(paths, lambda t: F.try_element_at(F.filter(attributes(t), lambda a: a["name"] == "d")["value"], F.lit(-1))),
        lambda d: d.isNotNull(),
    )
    commands = F.aggregate(
        bodies, F.lit(0), lambda n, d: n + F.length(d) - F.length(F.regexp_replace(d, "(?i)[achlmqstvz]", ""))
    )
    hexes = F.transform(F.regexp_extract_all(text, F.lit(_HEX_COLOR), F.lit(0)), F.lower)
    rgbs = F.regexp_extract_all(text, F.lit(_RGB_COLOR), F.lit(0))
    return F.struct(
        F.get(values(everything, "viewbox"), F.lit(0)).alias("view_box"),
        F.size(bodies).alias("paths_count"),
        commands.alias("commands_count"),
        F.exists(values(everything, "fill"), lambda f: f != "none").alias("has_fill"),
        F.array_distinct(values(everything, "stroke-width")).alias("stroke_widths"),
        F.concat(F.array_distinct(hexes), F.array_distinct(rgbs)).alias("literal_colors"),
    )


def _number(content: Column, at: int | Column, size: int, little: bool = False) -> Column:
    """Unsigned number of ``size`` bytes from byte ``at`` (0-based) of a binary column."""
    places = [at + i for i in range(size)]
    digits = [F.hex(F.substring(content, (p if isinstance(p, Column) else F.lit(p)) + 1, F.lit(1))) for p in places]
    return F.conv(F.concat(*(digits[::-1] if little else digits)), 16, 10).cast("long")


def _bytes_at(content: Column, at: int, text: str) -> Column:
    return F.substring(content, F.lit(at + 1), F.lit(len(text) // 2)) == F.unhex(F.lit(text))


def _jpeg_frame(content: Column) -> Column:
    """(width, height) of the first frame header, found by stepping from segment to segment."""
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(2).cast("long").alias("at"), none.alias("width"), none.alias("height"))

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        kind = _number(content, at.cast("int") + 1, 1)
        # frame headers, without the tables and extensions that share their range
        frame = kind.between(0xC0, 0xCF) & ~kind.isin(0xC4, 0xC8, 0xCC)
        after = at + 2 + _number(content, at.cast("int") + 2, 2)
        return F.when(state["width"].isNotNull() | (at < 0), state).otherwise(
            F.struct(
                F.when(~frame & (after < F.length(content)), after).otherwise(F.lit(-1)).cast("long").alias("at"),
                F.when(frame, _number(content, at.cast("int") + 7, 2)).alias("width"),
                F.when(frame, _number(content, at.cast("int") + 5, 2)).alias("height"),
            )
        )

    # a segment takes four bytes at least
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(content) / 4).cast("int")), start, step)


def header_size(content: Column) -> Column:
    """Struct (width, height) out of the header bytes of a png, gif, jpeg or webp file, null for others."""

    def size(width: Column, height: Column) -> Column:
        return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"))

    packed = _number(content, 21, 4, little=True)
    low14 = F.lit(0x3FFF)
    webp = (
        F.when(
            _bytes_at(content, 12, "56503820"),  # lossy
            size(_number(content, 26, 2, True).bitwiseAND(low14), _number(content, 28, 2, True).bitwiseAND(low14)),
        )
        .when(
            _bytes_at(content, 12, "5650384C"),  # lossless
            size(packed.bitwiseAND(low14) + 1, F.shiftright(packed, 14).bitwiseAND(low14) + 1),
        )
        .when(
            _bytes_at(content, 12, "56503858"),  # extended
            size(_number(content, 24, 3, True) + 1, _number(content, 27, 3, True) + 1),
        )
    )
    frame = _jpeg_frame(content)
    return (
        F.when(_bytes_at(content, 0, "89504E470D0A1A0A"), size(_number(content, 16, 4), _number(content, 20, 4)))
        .when(_bytes_at(content, 0, "47494638"), size(_number(content, 6, 2, True), _number(content, 8, 2, True)))
        .when(_bytes_at(content, 0, "52494646") & _bytes_at(content, 8, "57454250"), webp)
        .when(_bytes_at(content, 0, "FFD8"), size(frame["width"], frame["height"]))
    )
