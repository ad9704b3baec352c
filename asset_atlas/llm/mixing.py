"""Mixing to target weights: iterative proportional fitting, then calibrated sampling.

Documents are first summed into cells, one per combination of the margins' values; fitting works on
that aggregate alone. A sweep rescales the cell weights to each margin's target in turn; sweeps go on
until every value of every margin is within ``TOLERANCE`` of its target. Targets that contradict each
other over the cells there are end in a warning with the error left. Every
rescaling is a grouped sum joined back on the margin's value, so no task needs a margin's cells
together. A document's rate is its cell's fitted tokens over the cell's own tokens; the number of
copies drawn has exactly that expectation, so the drawn tokens meet the targets without a cap.

Defined cases: null margin values form a value of their own (written as the empty string); a text
without words weighs nothing and takes its cell's rate; cells without tokens or with a value that has
no target have rate 0; targets of values that hold no tokens are left out and the others rescaled; a null id draws like the empty
id; an empty table gives an empty result; other columns pass through, those with a leading underscore
are left out; a column ``topic`` is taken as the topic.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .rows import BLANKS, carried, whole_text

MARGINS = ["source", "lang", "topic"]
#: sweeps at least, and at most
SWEEPS = 8
MOST_SWEEPS = 100
#: largest error of a value's share, relative to its target
TOLERANCE = 0.01
TEMPERATURE = 0.5
SHARE = 0.5

#: form topics by the first pattern that fits, tried in order; anything else is prose
TOPICS = [
    ("empty", r"^[\x20\x09-\x0D]*$"),
    ("license", r"(?i)(licensed under|all rights reserved|released under)"),
    ("table", r"( \| [^|\n]*){3}"),
    ("markup", r"[#*$%&<>]{3}"),
    ("contact", r"(@[A-Za-z0-9-]+\.|\+[0-9] ?\(?[0-9]{3})"),
]


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), name).otherwise(topic)
    return topic


def n_words(text: Column) -> Column:
    bare = F.trim(text, F.lit(BLANKS))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def tempered_targets(cells: DataFrame, margin: str, temperature: float = TEMPERATURE) -> DataFrame:
    """Default targets: each value's token share raised to ``temperature``, as shares of one."""
    sums = cells.groupBy(margin).agg(F.sum("_tokens").alias("t")).filter("t > 0")
    power = sums.select(margin, F.pow(F.col("t").cast("double"), F.lit(temperature)).alias("p"))
    total = power.agg(F.sum("p")).first()[0]
    return power.select(margin, (F.col("p") / F.lit(total or 1.0)).alias("_target"))


def margin_error(state: DataFrame, margins: list[str]) -> float:
    """Largest error of a value's weight relative to its target, over all margins."""
    off = [state.groupBy(m).agg(F.abs(F.sum("_weight") / F.first(f"_t_{m}") - 1).alias("e")).select("e") for m in margins]
    return reduce(DataFrame.unionByName, off).agg(F.max("e")).first()[0] or 0.0


def fit(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame], sweeps: int = SWEEPS,
        tolerance: float = TOLERANCE, most: int = MOST_SWEEPS) -> DataFrame:
    """Cells with ``_weight``: shares that meet the margins' targets, starting from the token shares.

    ``cells``: the margins and ``_tokens``. ``targets[m]``: m's values with ``_target``. After
    ``sweeps`` sweeps more follow while an error is above ``tolerance``, up to ``most`` in all or until
    sweeps change it no more; what is left then is warned of.
    """
    state = cells.filter("_tokens > 0").withColumn("_weight", F.col("_tokens").cast("double"))
    for m in margins:
        state = state.join(targets[m].filter("_target > 0").withColumnRenamed("_target", f"_t_{m}"), m)
    state = cut(state)
    # values that vanished, also with a partner's target, leave shares below one: rescale what stays
    for m in margins:
        total = state.select(m, f"_t_{m}").distinct().agg(F.sum(f"_t_{m}")).first()[0]
        state = state.withColumn(f"_t_{m}", F.col(f"_t_{m}") / F.lit(total or 1.0))
    done, error = 0, None
    while done < max(sweeps, most):
        for m in margins:
            sums = state.groupBy(m).agg((F.first(f"_t_{m}") / F.sum("_weight")).alias("_scale"))
            state = state.join(sums, m).withColumn("_weight", F.col("_weight") * F.col("_scale")).drop("_scale")
        state = cut(state)
        done += 1
        if done >= sweeps:
            before, error = error, margin_error(state, margins)
            if error <= tolerance or (before is not None and abs(before - error) <= 1e-6 * before):
                break
    if error is not None and error > tolerance:
        warnings.warn(f"mixing: a margin is {error:.3g} off its target after {done} sweeps", stacklevel=2)
    return state.select(*margins, "_tokens", "_weight")


def mix_sources(docs: DataFrame, margins: list[str] | None = None, text: str = "text", share: float = SHARE,
                sweeps: int = SWEEPS, temperature: float = TEMPERATURE,
                targets: dict[str, DataFrame] | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """``docs`` with ``_n_words``, ``_topic``, ``_rate`` (expected copies) and ``_copies`` drawn.

    ``share`` is the fraction of the corpus' tokens to draw; ``targets`` may name its own shares
    for any margin; ``tolerance`` bounds the error of a value's share relative to its target.
    """
    margins, docs = margins or MARGINS, carried(docs)
    whole = whole_text(text)
    rows = docs.withColumns({"_n_words": n_words(whole), "_topic": topic_of(whole)})
    value = {m: F.coalesce(F.col("_topic" if m == "topic" and m not in docs.columns else m).cast("string"), F.lit(""))
             for m in margins}
    keyed = rows.select("*", *[value[m].alias(f"_m_{m}") for m in margins])
    names = [f"_m_{m}" for m in margins]
    cells = cut(keyed.groupBy(*names).agg(F.sum("_n_words").alias("_tokens")))
    goals = {}
    for m, name in zip(margins, names, strict=True):
        given = (targets or {}).get(m)
        if given is None:
            goals[name] = tempered_targets(cells, name, temperature)
        else:
            goals[name] = given.select(F.coalesce(F.col(m).cast("string"), F.lit("")).alias(name), "_target")
    fitted = fit(cells, names, goals, sweeps, tolerance)
    total = cells.agg(F.sum("_tokens")).first()[0] or 0
    rate = F.col("_weight") * F.lit(float(total) * share) / F.col("_tokens")
    rates = fitted.select(*names, F.round(rate, 9).alias("_rate"))
    out = keyed.join(rates, names, "left").withColumn("_rate", F.coalesce("_rate", F.lit(0.0)))
    # 52 bits of the id's digest as a fraction of one
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10)
    part = draw.cast("double") / float(1 << 52)
    copies = F.floor("_rate") + (part < F.col("_rate") - F.floor("_rate")).cast("long")
    return out.select(*docs.columns, "_n_words", "_topic", "_rate", copies.alias("_copies"))
