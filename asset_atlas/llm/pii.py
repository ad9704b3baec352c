"""Personal data: regular expressions propose spans, checksums confirm, context words score.

All steps are Spark expressions. A kind's matches and the pieces between them come from the same
pattern, so a match's place is a running sum of lengths; the sums are taken over the short rows of
matches, never over the text, and cost no more for a text with very many matches.

Patterns use possessive loops and start only where a run starts, so they stay linear in long runs
and never recurse. Defined cases: null text counts as empty and has no span; a null id stays null;
repeated rows are reported one by one; an empty table gives an empty result; other columns
pass through ``find_spans``, one named ``found`` or with a leading underscore is left out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import carried, whole_text

CONTEXT = 40


class Kind(NamedTuple):
    """``pattern`` proposes, ``confirm`` decides, ``near`` are context words that raise the score."""

    name: str
    pattern: str
    hint: str
    base: bool
    prior: float
    near: str


#: characters of an account number by country, as the registry of ISO 13616 prescribes them
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """An account of its country's length, so that words behind it stay outside, else of any length."""
    ways = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        tail = rf"\x20?[A-Z0-9]{{{rest}}}" if rest else ""
        ways.append(rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    ways.append(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?")
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(ways)})"


_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"

KINDS = [
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", True, 0.9,
         "mail|contact|write|correo|schreib"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True, 0.7, "ip|host|server|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", True, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", True, 0.7, "phone|call|tel|mobile|fax"),
    Kind("iban", _iban(), "", False, 0.8,
         "iban|bank|account|konto|compte|cuenta"),
]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits."""
    places = F.split(F.reverse(digits), "")
    worth = F.transform(
        places, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    )
    return F.aggregate(worth, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(compact: Column) -> Column:
    """ISO 7064 check of an account number without blanks: the remainder must be 1."""
    turned = F.concat(F.substr(compact, F.lit(5)), F.left(compact, F.lit(4)))
    return F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c == "", acc)
        .when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97)
        .otherwise((acc * 100 + F.ascii(c) - 55) % 97),
    ) == 1


def _confirm(kind: str, match: Column) -> Column:
    n = F.length(_digits(match))
    if kind == "ip":
        part = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(
            F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255")
        )
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        compact = F.regexp_replace(match, " ", "")
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


def _proposals(number: int, kind: Kind, text: Column) -> Column:
    """Matches of one kind in order, each with the length and tail of the piece before it."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    rows = F.transform(
        F.arrays_zip(found.alias("m"), pieces.alias("p")),
        lambda x: F.struct(
            F.lit(number).alias("kind"),
            F.length(x["p"]).alias("gap"),
            F.lower(F.right(x["p"], F.lit(CONTEXT))).alias("before"),
            x["m"].alias("match"),
        ),
    )
    rows = F.filter(rows, lambda x: x["match"].isNotNull())
    empty = F.array().cast("array<struct<kind:int,gap:int,before:string,match:string>>")
    hint = F.contains(text, F.lit(kind.hint)) if kind.hint else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(hint, rows).otherwise(empty)


def find_spans(docs: DataFrame, text: str = "text", kinds: list[Kind] = KINDS,
               keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``found``: the confirmed spans by start, then kind.

    A span is (start, kind number, end, score), code points with the end exclusive. Only the kept
    columns travel through the shuffle.
    """
    whole = whole_text(text)
    keep = carried(docs, "found").columns if keep is None else keep
    wide = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.struct(*[F.col(c) for c in keep]).alias("_doc"),
        F.flatten(F.array(*[_proposals(i, k, whole) for i, k in enumerate(kinds)])).alias("_all"),
    )
    return _placed(wide, kinds)


def _placed(wide: DataFrame, kinds: list[Kind]) -> DataFrame:
    rows = wide.select(
        "_row", "_doc", F.posexplode_outer("_all").alias("_i", "_x")
    ).select("_row", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_doc")).alias("_doc"), "_i", "_x.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("match")
    rows = rows.withColumn("end", F.sum(F.col("gap") + size).over(so_far)).withColumn("start", F.col("end") - size)
    confirmed, score = F.lit(False), F.lit(0.0)
    for i, k in enumerate(kinds):
        mine = F.col("kind") == i
        confirmed = F.when(mine, _confirm(k.name, F.col("match"))).otherwise(confirmed)
        lift = F.when(F.col("before").rlike(k.near), 1.0 - k.prior).otherwise(0.0)
        score = F.when(mine, F.lit(k.prior) + lift).otherwise(score)
    span = F.when(
        F.col("match").isNotNull() & confirmed,
        F.struct("start", F.col("kind"), "end", score.alias("score")),
    )
    return (
        rows.withColumn("_span", span)
        .groupBy("_row")
        .agg(F.first("_doc", ignorenulls=True).alias("_doc"), F.sort_array(F.collect_list("_span")).alias("found"))
        .select("_doc.*", "found")
    )


def digest(spans: Column, kinds: list[Kind] = KINDS) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def redact_counts(found: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """Counts per kind and the digests of ``find_spans``' result."""
    spans = F.col("found")

    def count(number: int) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(kinds)]
    n_base = sum(k.base for k in kinds)
    base = F.filter(spans, lambda s: s["kind"] < n_base)
    scores = F.array_join(F.transform(spans, lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id",
        *counts[:n_base],
        F.sha2(digest(base, kinds), 256).alias("base_sha256"),
        digest(spans, kinds).alias("spans"),
        *counts[n_base:],
        scores.alias("scores"),
    )
