"""Exact similarity joins built on equi-joins.

Every join here finds all qualifying pairs. Candidate keys come from a pigeonhole or bucket
argument, the predicate runs inside the join condition, and a pair is reported by exactly one of
its keys, so no de-duplicating shuffle follows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.color import NEAR_MISS, delta_e_steps, lab65
from ..functions.fingerprint import hamming_bits
from ..functions.util import let
from ..session import cut

ALL_BITS = 64
# |dE| >= |dL| / S_L and S_L never exceeds 1.748
MAX_LIGHTNESS_WEIGHT = 1.748
HOT_TOKEN_ROWS = 20_000
HOT_BAND_ROWS = 20_000
#: bounds on the search for a band layout: more keys make the probing side too wide
MOST_BANDS, MOST_KEYS = 16, 20_000
RADIUS_STEPS = (4, 8, 12, 16)
GROW_FROM_ROWS = 10_000
#: compared pairs that cost as much as writing, shuffling and sorting one band key
KEY_PAIRS = 50
#: rows a side of a tile where all pairs of a block are compared
TILE_ROWS = 5_000
#: the same where only a tile's connecting pairs are kept
LINK_ROWS = 20_000
#: pairs of a tile that are compared at once
LINK_PAIRS = 1 << 19


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def band_layout(d: int, m: int) -> list[tuple[list[int], int]]:
    """(bit positions, radius) of ``m`` bands for Hamming distance ``d``.

    Band j takes every m-th bit, so a blank image row does not fill one whole band with zeros. If each
    band differs by more than its radius, the total exceeds d, because the radii add up to d + 1 - m.
    """
    base, extra = divmod(d + 1 - m, m)
    return [(list(range(j, ALL_BITS, m)), base + (1 if j < extra else 0)) for j in range(m)]


def band_cost(d: int, m: int) -> tuple[int, float]:
    """Keys a fingerprint is probed with, and candidates per fingerprint of evenly spread ones."""
    balls = [(len(bits), sum(comb(len(bits), r) for r in range(radius + 1))) for bits, radius in band_layout(d, m)]
    return sum(ball for _, ball in balls), sum(ball / 2.0**bits for bits, ball in balls)


def best_bands(d: int, rows: int) -> int:
    """Bands with the least keys and candidates for a fingerprint in a block of ``rows``.

    Few wide bands leave few candidates but need many keys; they pay in large blocks only.
    """

    def work(m: int) -> float:
        keys, share = band_cost(d, m)
        return keys + share * rows if keys <= MOST_KEYS else float("inf")

    return min(range(1, min(MOST_BANDS, d + 1) + 1), key=work)


def bands_or_none(d: int, rows: int) -> int | None:
    """Bands for a block of ``rows``; None where comparing all pairs costs less than the keys of any layout."""
    costs = {m: band_cost(d, m) for m in range(1, min(MOST_BANDS, d + 1) + 1)}
    work = {m: KEY_PAIRS * keys + share * rows for m, (keys, share) in costs.items() if keys <= MOST_KEYS}
    m = min(work, key=work.get)
    return m if work[m] < rows else None


def band_plan(d: int, bands: int) -> list[tuple[int, int, list[int]]]:
    """(mask, radius, probe masks) per band for Hamming distance ``d``."""
    plan = []
    for positions, radius in band_layout(d, min(bands, d + 1)):
        probes = [
            _signed(sum(1 << p for p in combo))
            for r in range(radius + 1)
            for combo in combinations(positions, r)
        ]
        plan.append((_signed(sum(1 << p for p in positions)), radius, probes))
    return plan


def _longs(values: list[int]) -> Column:
    # one literal, folded by the optimizer; a literal per value would be thousands
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def block_rows(df: DataFrame, block: list[str]) -> tuple[int, int]:
    """Rows of the largest block, and of all."""
    n = df.groupBy(*block).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return n["most"] or 0, n["all"] or 0


def band_sides(probe: DataFrame, keyed: DataFrame, plan: list, block: list[str]) -> tuple[DataFrame, DataFrame]:
    """(``block``, bits_a, band, key) with every key in reach, and (``block``, bits_b, band, key) with the own ones."""

    def within(j: int, mask: int, masks: list[int]) -> Column:
        return F.transform(
            _longs(masks),
            lambda p: F.struct(
                F.lit(j).alias("band"),
                F.col("bits").bitwiseAND(F.lit(mask)).bitwiseXOR(p).alias("key"),
            ),
        )

    probes = F.concat(*[within(j, mask, masks) for j, (mask, _, masks) in enumerate(plan)])
    keys = F.array(
        *[
            F.struct(F.lit(j).alias("band"), F.col("bits").bitwiseAND(F.lit(mask)).alias("key"))
            for j, (mask, _, _) in enumerate(plan)
        ]
    )
    return (
        probe.select(*block, F.col("bits").alias("bits_a"), F.inline(probes)),
        keyed.select(*block, F.col("bits").alias("bits_b"), F.inline(keys)),
    )


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled whatever its guessed size.

    Fingerprints and ids take a few bytes in a file and some hundred as rows of a broadcast, which the
    driver would hold for every row of the input.
    """
    return df.hint("merge")


def split_hot(left: DataFrame, right: DataFrame, on: list[str], member: str, hot: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part``: keys of over ``hot`` rows on the right are dealt over parts, and the
    left rows of such a key go to each of them."""
    often = cut(
        right.groupBy(*on).agg(F.count("*").alias("n")).filter(F.col("n") > hot)
        .select(*on, F.ceil(F.col("n") / hot).cast("int").alias("parts"))
    )
    parts = F.coalesce("parts", F.lit(1))
    spread = left.join(often, on, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = right.join(often, on, "left").withColumn("part", F.pmod(F.xxhash64(member), parts).cast("int"))
    return spread.drop("parts"), dealt.drop("parts")


def tile_sides(probe: DataFrame, keyed: DataFrame, block: list[str], tile: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a tile (``i``, ``j``): each row of one side meets each row of the other in exactly one.

    A block is cut into slices of about ``tile`` rows on either side, so a tile's work is bounded, and
    the tiles of a block are spread over the tasks.
    """
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def slices(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias(name))

    grid = cut(slices(probe, "lefts").join(slices(keyed, "rights"), block))

    def dealt(df: DataFrame, name: str, own: str, others: str) -> DataFrame:
        at, over = ("i", "j") if own == "lefts" else ("j", "i")
        rows = df.join(grid, block).select(
            *block, F.col("bits").alias(name), F.pmod(F.xxhash64("bits"), F.col(own)).cast("int").alias(at),
            F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(over),
        )
        # a tile's work does not show in its bytes, so partitions must not be merged by size
        return rows.repartition(tasks, *block, "i", "j")

    return dealt(probe, "bits_a", "lefts", "rights"), dealt(keyed, "bits_b", "rights", "lefts")


def hamming_join(
    probe: DataFrame,
    keyed: DataFrame,
    d: int,
    block: list[str],
    bands: int | None = None,
    ordered: bool = False,
    hot: int = HOT_BAND_ROWS,
    rows: int | None = None,
) -> DataFrame:
    """Pairs (``block``, bits_a, bits_b, hamming) with hamming <= ``d`` inside a block.

    Both inputs hold distinct (``block``, bits) rows. ``probe`` is expanded with every key within
    the band radius, ``keyed`` emits one key per band. ``ordered`` keeps bits_a < bits_b only, for
    self-joins. The number of bands follows from ``rows``, those of the largest block, counted if
    not given; only a block of over ``hot`` rows can hold a key that must be split. Where bands would
    leave most pairs as candidates, all pairs of a block are compared in tiles.
    """
    if rows is None:
        rows = block_rows(keyed, block)[0]
    if rows == 0:
        none = keyed.limit(0).select(*block, F.col("bits").alias("bits_a"), F.col("bits").alias("bits_b"))
        return none.withColumn("hamming", hamming_bits(F.col("bits_a"), F.col("bits_b")))
    bands = bands or bands_or_none(d, rows)
    plan = band_plan(d, bands) if bands else []
    if plan:
        left, right = band_sides(probe, keyed, plan, block)
        on = [*block, "band", "key"]
    else:
        left, right = tile_sides(probe, keyed, block)
        on = [*block, "i", "j"]
    if plan and rows > hot:
        left, right = split_hot(left, right, on, "bits_b", hot)
        on = [*on, "part"]
    diff = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    first = F.lit(True)
    for j in range(len(plan) - 1, 0, -1):
        earlier_miss = reduce(
            lambda x, y: x & y,
            [F.bit_count(diff.bitwiseAND(F.lit(mask))) > radius for mask, radius, _ in plan[:j]],
        )
        first = F.when(F.col("l.band") == j, earlier_miss).otherwise(first)
    same = reduce(lambda x, y: x & y, [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on])
    keep = (F.bit_count(diff) <= d) & first
    if ordered:
        keep = keep & (F.col("bits_a") < F.col("bits_b"))
    return (
        left.alias("l")
        # sizes are guessed from the rows before they are expanded
        .join(unsent(right).alias("r"), same & keep, "inner")
        .select(
            *[F.col(f"l.{c}").alias(c) for c in block],
            "bits_a",
            "bits_b",
            hamming_bits(F.col("bits_a"), F.col("bits_b")).alias("hamming"),
        )
    )


def hamming_self_join(
    df: DataFrame, d: int, block: list[str], bands: int | None = None, hot: int = HOT_BAND_ROWS
) -> DataFrame:
    """Unordered pairs of distinct fingerprints within ``d`` of each other inside a block."""
    nodes = cut(df.select(*block, "bits").distinct())
    return hamming_join(nodes, nodes, d, block, bands, ordered=True, hot=hot)


def connecting_pairs(a: np.ndarray, b: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links values of ``a`` and ``b`` within Hamming distance ``d``.

    Rows are taken some at a time. A row is compared with all of ``b`` until one link ties it to the
    largest part; of the pairs inside that part no more are needed. Memory follows the rows, not the
    pairs in reach.
    """
    values, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    at_a, at_b = place[: len(a)], place[len(a) :]
    part = np.arange(len(values))
    links = [(at_a[:0], at_a[:0])]

    def connect(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal part
        while True:
            apart = part[x] != part[y]
            x, y = x[apart], y[apart]
            if not len(x):
                return
            # every part hangs itself on the least one it meets: numbers only fall, so there is no cycle
            high, low = np.maximum(part[x], part[y]), np.minimum(part[x], part[y])
            order = np.lexsort((low, high))
            hung, at = np.unique(high[order], return_index=True)
            pick = order[at]
            links.append((x[pick], y[pick]))
            to = np.arange(len(values))
            to[hung] = low[pick]
            while (to != to[to]).any():
                to = to[to]
            part = to[part]

    step = max(1, LINK_PAIRS // max(1, len(b)))
    inside, outside = np.arange(0), np.arange(len(b))
    main, known = -1, 1
    for first in range(0, len(a), step):
        if len(links) > known:
            main, known = np.bincount(part).argmax(), len(links)
            of_main = part[at_b] == main
            inside, outside = np.flatnonzero(of_main), np.flatnonzero(~of_main)
        rows = np.arange(first, min(first + step, len(a)))
        stray = rows[part[at_a[rows]] != main]
        if len(stray) and len(inside):
            # one link to the largest part is as good as all
            near = np.bitwise_count(a[stray, None] ^ b[inside]) <= d
            at = near.argmax(axis=1)
            hit = near[np.arange(len(stray)), at]
            connect(at_a[stray[hit]], at_b[inside[at[hit]]])
        i, j = np.nonzero(np.bitwise_count(a[rows, None] ^ b[outside]) <= d)
        connect(at_a[rows[i]], at_b[outside[j]])
    return tuple(values[np.concatenate(side)] for side in zip(*links, strict=True))


def hamming_links(
    df: DataFrame, d: int, block: list[str], bands: int | None = None, tile: int = LINK_ROWS
) -> DataFrame:
    """Pairs (``block``, bits_a, bits_b) within ``d`` that connect just what all such pairs connect.

    Where bands pay, these are all pairs. Else the pairs of a block are compared in tiles as in
    ``hamming_join``, each tile once and not also turned around, and a tile hands over a spanning forest:
    at most a pair for each of its rows, however many lie in reach.
    """
    nodes = cut(df.select(*block, "bits").distinct())
    rows = block_rows(nodes, block)[0]
    if rows == 0 or bands or bands_or_none(d, rows):
        return hamming_join(nodes, nodes, d, block, bands, ordered=True, rows=rows).drop("hamming")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grid = cut(nodes.groupBy(*block).agg(F.ceil(F.count("*") / tile).cast("int").alias("slices")))
    own, other = F.col("own"), F.col("other")
    tiles = (
        nodes.join(grid, block)
        .withColumn("own", F.pmod(F.xxhash64("bits"), F.col("slices")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(*block, "bits", "own", F.least(own, other).alias("i"), F.greatest(own, other).alias("j"))
        # a tile's work does not show in its bytes, so partitions must not be merged by size
        .repartition(tasks, *block, "i", "j")
    )

    def linked(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits, own = rows["bits"].to_numpy().view(np.uint64), rows["own"].to_numpy()
        a, b = connecting_pairs(bits[own == key[-2]], bits[own == key[-1]], d)
        out = pd.DataFrame({"bits_a": a.view(np.int64), "bits_b": b.view(np.int64)})
        for at, (name, value) in enumerate(zip(block, key, strict=False)):
            out.insert(at, name, [value] * len(out))
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.select(*block).schema)
    return tiles.groupBy(*block, "i", "j").applyInPandas(linked, f"{schema}, bits_a bigint, bits_b bigint")


def hamming_query_join(
    queries: DataFrame, df: DataFrame, d: int, block: list[str], bands: int | None = None, hot: int = HOT_BAND_ROWS
) -> DataFrame:
    """Distinct query fingerprints against distinct catalogue fingerprints; the smaller side is expanded."""
    asked, known = (cut(x.select(*block, "bits").distinct()) for x in (queries, df))
    (most_asked, all_asked), (most_known, all_known) = block_rows(asked, block), block_rows(known, block)
    if all_asked <= all_known:
        return hamming_join(asked, known, d, block, bands, hot=hot, rows=most_known)
    turned = hamming_join(known, asked, d, block, bands, hot=hot, rows=most_asked)
    return turned.select(*block, F.col("bits_b").alias("bits_a"), F.col("bits_a").alias("bits_b"), "hamming")


def by_growing_radius(
    asked: DataFrame, key: str, k: int, radii: list[int], hits_at: Callable[[DataFrame, int], DataFrame]
) -> DataFrame:
    """``hits_at(asked, radius)`` of each asked row at the first radius that gives it ``k`` hits.

    Hits within a radius come before all others, so the ``k`` closest of a filled row are among
    them; only rows still short of ``k`` meet the wider and more expensive radius.
    """
    parts = []
    for d in radii[:-1]:
        hits = cut(hits_at(asked, d))
        full = unsent(hits.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= k).select(key))
        parts.append(hits.join(full, key, "left_semi"))
        asked = cut(asked.join(full, key, "left_anti"))
        if asked.isEmpty():
            return reduce(DataFrame.unionByName, parts)
    return reduce(DataFrame.unionByName, [*parts, hits_at(asked, radii[-1])])


def growing_radii(ceiling: int, rows: int) -> list[int]:
    """Steps up to ``ceiling``; small blocks are searched at once, as a step costs more than it saves."""
    return [r for r in RADIUS_STEPS if r < ceiling and rows > GROW_FROM_ROWS] + [ceiling]


def _rare_first(sets: DataFrame, key: list[str], freq: DataFrame) -> DataFrame:
    """Add ``ordered``: the tokens of a set from rarest to most common, with their frequency."""
    return (
        sets.select(*key, "tokens", F.explode("tokens").alias("token"))
        .join(freq, "token")
        .groupBy(*key, "tokens")
        .agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("ordered"))
    )


def jaccard_join(
    left: DataFrame, right: DataFrame, threshold: float, self_join: bool = False
) -> DataFrame:
    """Pairs of token sets (tokens_a, tokens_b, score) with Jaccard >= ``threshold`` > 0.

    Both inputs hold one ``tokens`` column and are collapsed to distinct sets first. Only the
    rarest tokens of each set are joined (prefix filter); a token shared by very many sets is
    split over several join keys in proportion to its measured frequency.
    """
    a_sets = left.select("tokens").filter(F.size("tokens") > 0).distinct()
    b_sets = right.select("tokens").filter(F.size("tokens") > 0).distinct()
    universe = b_sets if self_join else a_sets.unionByName(b_sets)
    freq = universe.select(F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n")
    )

    def prefixes(sets: DataFrame, side: str) -> DataFrame:
        n = F.size("tokens")
        length = n - F.ceil(n * F.lit(float(threshold)) - F.lit(1e-9)).cast("int") + 1
        words = _rare_first(sets, [], freq)
        return words.select(
            F.col("tokens").alias(f"tokens_{side}"),
            F.transform("ordered", lambda o: o["token"]).alias(f"order_{side}"),
            F.inline(F.slice("ordered", F.lit(1), length)),
        ).withColumn("parts", F.ceil(F.col("n") / HOT_TOKEN_ROWS).cast("int"))

    a = prefixes(a_sets, "a").withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    b = prefixes(b_sets, "b").withColumn(
        "part", F.pmod(F.xxhash64("tokens_b"), F.col("parts")).cast("int")
    )
    sizes = F.size("tokens_a") + F.size("tokens_b")
    t = F.lit(float(threshold))

    def passes(shared: Column) -> Column:
        """The token at hand is the rarest shared one, and enough is shared."""
        score = F.size(shared) / (sizes - F.size(shared))
        return (F.get(shared, F.lit(0)) == F.col("a.token")) & (score >= t)

    keep = (
        (F.size("tokens_a") >= F.size("tokens_b") * t - F.lit(1e-9))
        & (F.size("tokens_b") >= F.size("tokens_a") * t - F.lit(1e-9))
        & let(F.array_intersect("order_a", "order_b"), passes)
    )
    if self_join:
        keep = (F.col("tokens_a") <= F.col("tokens_b")) & keep
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return (
        a.alias("a")
        .join(
            b.alias("b"),
            (F.col("a.token") == F.col("b.token")) & (F.col("a.part") == F.col("b.part")) & keep,
        )
        .select("tokens_a", "tokens_b", (common / (sizes - common)).alias("score"))
    )


def bucket_pairs(
    rows: DataFrame, value: str, width: float, reach: int, block: list[str], keep: Column
) -> DataFrame:
    """Equi-join each row with the buckets at most ``reach`` away on a numeric axis.

    Columns of the two sides are available as ``a.*`` and ``b.*`` inside ``keep``.
    """
    bucket = F.floor(F.col(value) / width).cast("long")
    near = rows.withColumn("bucket", bucket)
    wide = near.withColumn(
        "bucket", F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach))
    )
    on = reduce(
        lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in [*block, "bucket"]]
    )
    return wide.alias("a").join(near.alias("b"), on & keep)


def with_delta_e(pairs: DataFrame, limit: float, keep: list[str]) -> DataFrame:
    """Rows of ``pairs`` whose structs ``p`` and ``q`` (Lab) differ by less than ``limit``.

    The steps are separate columns, so the formula compiles to straight-line code. The limit is
    applied by a generator, not a filter: a filter would be pushed down through the steps and
    repeat them.
    """
    for step in delta_e_steps("p", "q"):
        pairs = pairs.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return pairs.select(
        *keep,
        F.explode(F.when(F.col("delta_e") < limit, F.array("delta_e"))).alias("delta_e"),
    )


def delta_e_pairs(
    colors: DataFrame, block: list[str] | None = None, limit: float = NEAR_MISS
) -> DataFrame:
    """Unordered pairs of distinct ``color`` values closer than ``limit`` in CIEDE2000."""
    block = block or []
    lab = colors.select(*block, "color").distinct().withColumn("lab", lab65("color"))
    lab = lab.withColumn("lightness", F.col("lab.l"))
    reach = limit * MAX_LIGHTNESS_WEIGHT
    middle = (F.col("a.lightness") + F.col("b.lightness")) / 2 - 50
    weight = 1 + 0.015 * middle * middle / F.sqrt(20 + middle * middle)
    close = (F.col("a.color") < F.col("b.color")) & (
        F.abs(F.col("a.lightness") - F.col("b.lightness")) < limit * weight + 1e-9
    )
    pairs = bucket_pairs(lab, "lightness", reach / 4, 4, block, close).select(
        *[F.col(f"a.{c}").alias(c) for c in block],
        F.col("a.color").alias("color_a"),
        F.col("b.color").alias("color_b"),
        F.col("a.lab").alias("p"),
        F.col("b.lab").alias("q"),
    )
    return with_delta_e(pairs, limit, [*block, "color_a", "color_b"])


def range_pairs(
    sizes: DataFrame, block: list[str] | None = None, width: float = 1.0
) -> DataFrame:
    """(anchor, variant) sizes less than ``width`` apart where the variant is strictly less used."""
    block = block or []
    close = (F.abs(F.col("a.px") - F.col("b.px")) < width) & (F.col("b.n") < F.col("a.n"))
    return bucket_pairs(sizes, "px", width, 1, block, close).select(
        *[F.col(f"a.{c}").alias(c) for c in block],
        F.col("a.value").alias("hi"),
        F.col("a.n").alias("hi_n"),
        F.col("a.px").alias("hi_px"),
        F.col("b.value").alias("lo"),
        F.col("b.n").alias("lo_n"),
        F.col("b.px").alias("lo_px"),
    )
