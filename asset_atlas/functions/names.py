"""File-name and path scalars."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Variant words a stem may end in.
STYLE_SUFFIXES = [
    "outline", "filled", "bold", "regular", "duotone", "sm", "md", "lg", "xl", "xxl", "16", "20", "24",
    "28", "32", "40", "48", "56", "64", "circle", "square", "solid", "light", "thin", "rounded",
]

# Words that say nothing about what an image shows.
STOPWORDS = [
    "icon", "ic", "img", "image", "asset", "logo", "pic", "filled", "fill", "outline", "outlined",
    "solid", "stroke", "regular", "bold", "light", "thin", "duotone", "twotone", "sm", "md", "lg", "xl",
    "xxs", "xs", "xxl", "small", "medium", "large", "circle", "square", "rounded", "round", "sharp",
    "active", "inactive", "disabled", "hover", "pressed", "default", "primary", "secondary", "tertiary",
    "red", "green", "blue", "yellow", "black", "white", "gray", "grey", "orange", "purple", "pink",
    "brown", "cyan", "magenta", "dark", "color", "colored", "mono", "monochrome", "colour", "padded",
    "padding", "margin", "new", "old", "legacy", "v1", "v2", "v3", "bg", "fg", "alt", "copy", "vertical",
    "horizontal", "left", "right", "top", "bottom", "up", "down",
]

# Pixel sizes that count as icon sizes.
PIXEL_SIZES = [8, 10, 12, 14, 16, 18, 20, 24, 28, 32, 36, 40, 48, 56, 64, 72, 96, 128, 256]

# Image extensions the catalogue accepts.
IMAGE_EXTENSIONS = ["svg", "png", "jpg", "jpeg", "webp", "gif"]

TSHIRT = "xs|sm|md|lg|xl|xxl|small|medium|large"


def extension(name: Column) -> Column:
    """Lower-cased extension without the dot, jpeg folded into jpg, empty when there is none."""
    raw = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(raw == "jpeg", F.lit("jpg")).otherwise(raw)


def path_extension(name: Column) -> Column:
    """As ``extension``, but a leading dot alone does not start an extension."""
    raw = F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))
    return F.when(raw == "jpeg", F.lit("jpg")).otherwise(raw)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def is_image_name(name: Column) -> Column:
    raw = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return raw.isin(IMAGE_EXTENSIONS)


def category(ext: Column, width: Column, height: Column) -> Column:
    side = F.greatest(width, height)
    unknown = width.isNull() | height.isNull()
    return (
        F.when((ext == "svg") & ~unknown & (side <= 64), F.lit("icon"))
        .when(ext == "svg", F.lit("illustration"))
        .when(unknown, F.lit("other"))
        .when(side <= 64, F.lit("icon"))
        .when(side <= 512, F.lit("illustration"))
        .otherwise(F.lit("photo"))
    )


def canonical_stem(s: Column) -> Column:
    """Variant-free stem. The lookahead leaves the next hyphen in place, so one pass is a fixpoint."""
    lower = F.lower(s)
    bare = F.regexp_replace(lower, r"^(?:ic|icon)-", "")
    cut = F.regexp_replace(bare, rf"-(?:{'|'.join(STYLE_SUFFIXES)})(?=-|$)", "")
    return F.when(cut == "", lower).otherwise(cut)


def name_tokens(s: Column) -> Column:
    """Distinct meaningful words of a stem, in order of first appearance."""
    noise = STOPWORDS + [str(n) for n in PIXEL_SIZES]
    words = F.split(F.lower(s), r"[-_\s.]+")
    return F.array_distinct(
        F.filter(
            words,
            lambda w: (F.length(w) >= 3) & ~w.rlike(r"^[0-9]+$") & ~w.isin(noise),
        )
    )


def shared_tokens(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def jaccard(a: Column, b: Column) -> Column:
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(
        F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    )


def pixel_suffix(s: Column) -> Column:
    """(canonical, size) when the stem ends in a known pixel size, else null."""
    digits = F.regexp_extract(s, r"[-_]([0-9]{2,3})$", 1)
    size = F.try_to_number(digits, F.lit("999")).cast("int")
    return F.when(
        size.isin(PIXEL_SIZES),
        F.struct(
            F.regexp_replace(s, r"[-_][0-9]{2,3}$", "").alias("canonical"), size.alias("size")
        ),
    )


def pixel_size_from_path(d: Column) -> Column:
    digits = F.regexp_extract(d, r"(?:^|/)([0-9]{2,3})(?:/|$)", 1)
    size = F.try_to_number(digits, F.lit("999")).cast("int")
    return F.when(size.isin(PIXEL_SIZES), size)


def has_tshirt_signal(s: Column, d: Column) -> Column:
    return s.rlike(rf"(?i)[-_](?:{TSHIRT})$") | d.rlike(rf"(?i)(?:^|/)(?:{TSHIRT})(?:/|$)")


def has_pixel_path_signal(d: Column) -> Column:
    return d.rlike(r"(?:^|/)[0-9]{2,3}(?:/|$)")


def query_terms(q: str) -> list[str]:
    """Prefix terms of one search string."""
    return [t for t in re.split(r"[^a-z0-9]+", q.lower()) if t]


def _accent_map() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decomposition."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


def fold_accents(s: Column) -> Column:
    src, dst = _accent_map()
    return F.translate(s, src, dst)


def search_tokens(s: Column) -> Column:
    """Case- and accent-folded runs of letters and digits."""
    return F.regexp_extract_all(F.lower(fold_accents(s)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def filename_tips(s: Column) -> Column:
    """Style advice codes for a file stem."""

    def tip(cond: Column, code: str) -> Column:
        return F.when(cond, F.lit(code))

    return F.array_compact(
        F.array(
            tip(s.rlike(r"\s"), "CONTAINS_SPACE"),
            tip(s.rlike(r"[A-Z]") & s.rlike(r"[a-z]"), "UPPERCASE"),
            tip(s.contains("-") & s.contains("_"), "MIXED_SEPARATORS"),
            tip(s.contains("--") | s.contains("__"), "DOUBLE_SEPARATOR"),
            tip(s.rlike(r"[^\x20-\x7e]"), "NON_ASCII"),
            tip(s.rlike(r"^[._-]"), "LEADING_PUNCT"),
            tip(s.rlike(r"[._-]$"), "TRAILING_PUNCT"),
        )
    )


def new_rel_path(d: Column, name: Column) -> Column:
    return F.when(d == "", name).otherwise(F.concat_ws("/", d, name))


def percent_text(ratio: Column) -> Column:
    """Whole percent for display, ``n/a`` when there is nothing to score."""
    return F.coalesce(
        F.concat(F.floor(ratio * 100 + 0.5).cast("string"), F.lit("%")), F.lit("n/a")
    )
