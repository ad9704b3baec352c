"""Small column builders used across the function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so ``body`` may use it many times."""
    return F.transform(F.array(value), body).getItem(0)


def js_number(x: Column) -> Column:
    """Shortest decimal text of a double: whole numbers print without a point."""
    whole = x == F.floor(x)
    tiny = F.abs(x) < F.lit(1e-3)
    text = (
        F.when(whole & (F.abs(x) < F.lit(1e15)), x.cast("long").cast("string"))
        .when(tiny, F.rtrim(x.cast("decimal(38,18)").cast("string"), F.lit("0")))
        .otherwise(x.cast("string"))
    )
    return text


BLANKS = " \t\r\n\x0b\x0c\u00a0\ufeff"


BLANKS_SQL = r"'\u0020\t\r\n\u000b\u000c\u00a0\ufeff'"


def sql_let(name: str, value: str, body: str) -> str:
    """SQL text form of ``let``: ``body`` may use ``name`` many times."""
    return f"transform(array({value}), {name} -> {body})[0]"


def trim_blanks(s: Column) -> Column:
    """Strip every kind of blank, not only the space."""
    return F.trim(s, F.lit(BLANKS))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Folder part of a relative path; the root folder is the empty string."""
    return F.when(F.instr(path, "/") == 0, F.lit("")).otherwise(F.regexp_replace(path, r"/[^/]*$", ""))
