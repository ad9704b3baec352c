"""Type values to comparable keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import js_number, let, trim_blanks

AXES = ["size", "family", "weight", "line-height"]
ROOT_PX = 16


def size_px(raw: Column) -> Column:
    """Length in px at a 16px root; null for units that depend on context."""
    pattern = r"(?i)^\s*(-?[0-9]*\.?[0-9]+)(px|rem|em|pt)?\s*$"
    number = F.regexp_extract(raw, pattern, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(raw, pattern, 2))
    return (
        F.when(unit.isin("", "px"), number)
        .when(unit.isin("rem", "em"), number * ROOT_PX)
        .when(unit == "pt", number * F.lit(4.0 / 3.0))
    )


def weight_number(raw: Column) -> Column:
    v = F.lower(trim_blanks(raw))
    n = F.when(v.rlike(r"^[0-9]+(?:\.0*)?$"), v.try_cast("double"))
    return (
        F.when(v == "normal", F.lit(400))
        .when(v == "bold", F.lit(700))
        .when(n.between(1, 1000), n.cast("int"))
    )


def line_height(raw: Column) -> Column:
    """Unitless ratios stay ratios; lengths become ``<px>px``."""
    v = trim_blanks(raw)
    ratio = js_number(v.try_cast("double"))
    px = F.concat(js_number(size_px(v)), F.lit("px"))
    return F.when(v.rlike(r"^[0-9]*\.?[0-9]+$"), ratio).otherwise(px)


def family_stack(raw: Column) -> Column:
    """Lower-cased, quote-free, comma-joined font stack."""
    parts = F.transform(
        F.split(raw, ","), lambda f: F.lower(F.regexp_replace(trim_blanks(f), r"^['\"]|['\"]$", ""))
    )
    stack = F.array_join(F.filter(parts, lambda p: p != ""), ", ")
    return F.when(stack != "", stack)


def first_family(stack: Column) -> Column:
    return trim_blanks(F.substring_index(stack, ",", 1))


def normalize_type(axis: Column, raw: Column) -> Column:
    return (
        F.when(axis == "size", let(size_px(raw), js_number))
        .when(axis == "weight", weight_number(raw).cast("string"))
        .when(axis == "line-height", line_height(raw))
        .when(axis == "family", family_stack(raw))
    )
