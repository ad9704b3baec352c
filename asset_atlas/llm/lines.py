"""Line dedup over a family of levelled sorted runs of line hashes.

A run holds one row per line key: two hashes, the number of documents with the line and the largest
id among them, sorted by hash. Each batch is merge-joined with the runs: keys no run holds are the
anti-join and start a run of their own together with the increments of known keys, and once
``fan_in`` runs stand on a level they are compacted into one run of the next. Summing a key over the
live runs gives its exact count, so no batch rereads earlier documents.

Defined cases: null or empty text is one empty line; a line repeated inside one document counts it
once; null ids count as the smallest id; each row counts as a document, and rows that share the largest id all keep their lines; an empty table gives
an empty result; other columns pass through, those with a leading underscore are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from .rows import BLANKS, carried, whole_text

BATCHES = 4
FAN_IN = 2
MIN_CHARS = 20
MIN_DOCS = 3
#: a key in at least this share of the line rows is joined apart; there are at most 1 / share of them
HOT_SHARE = 1e-4


def line_key(line: Column) -> Column:
    """The line without outer blanks, A-Z lowered."""
    return F.translate(
        F.trim(line, F.lit(BLANKS)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    )


def _row_key(text: str) -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(whole_text(text)).alias("_sum")]


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def line_rows(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(_row, _doc, _sum, place, h1, h2) of every line whose key is long enough; _row tells rows apart."""
    # rows are numbered below the explode: beside it, each line would get a number of its own
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), *_row_key(text), whole_text(text).alias("_text"))
    lines = numbered.select("_row", "_doc", "_sum", F.posexplode(F.split("_text", "\n")).alias("place", "line"))
    keyed = lines.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return keyed.select("_row", "_doc", "_sum", "place", *_hashes(F.col("key")))


def batch_runs(lines: DataFrame, batches: int) -> DataFrame:
    """(batch, h1, h2, n_docs, max_doc): what each batch of documents adds, summed per key."""
    once = lines.groupBy("_row", "h1", "h2").agg(F.first("_doc").alias("_doc"))
    return once.groupBy(F.pmod(F.xxhash64("_doc"), F.lit(batches)).cast("int").alias("batch"), "h1", "h2").agg(
        F.count("*").alias("n_docs"), F.max("_doc").alias("max_doc")
    )


def merged(runs: list[DataFrame]) -> DataFrame:
    """One row per key over several runs."""
    return (
        reduce(DataFrame.unionByName, runs)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))
    )


class RunFamily:
    """Levels of runs in the shared folder; ``levels[i]`` holds fewer than ``fan_in`` runs."""

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Keys of the batch that no run holds."""
        return reduce(lambda left, run: left.join(run, ["h1", "h2"], "left_anti"), self.runs(), batch)

    def add(self, batch: DataFrame) -> None:
        """Add a batch's keys as a run; ``first`` marks those the anti-join let through."""
        fresh = self.unseen(batch).select("h1", "h2", F.lit(True).alias("first"))
        run = batch.join(fresh, ["h1", "h2"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
        self._place(stored(run.sortWithinPartitions("h1", "h2"), "line-run"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) < self.fan_in:
            return
        old = self.levels[level]
        self.levels[level] = []
        # at least one of the runs a key is in saw it first, unless a deeper level did
        both = (
            reduce(DataFrame.unionByName, old)
            .groupBy("h1", "h2")
            .agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.max("first").alias("first"))
        )
        self._place(stored(both.sortWithinPartitions("h1", "h2"), "line-run"), level + 1)
        for gone in old:
            discard(gone)

    def totals(self) -> DataFrame:
        return merged(self.runs())


def build_family(lines: DataFrame, batches: int = BATCHES, fan_in: int = FAN_IN) -> RunFamily:
    """Feed line rows to a family batch by batch; they are read once."""
    parts = stored(batch_runs(lines, batches), "line-batches", "batch")
    family = RunFamily(fan_in)
    for b in range(batches):
        family.add(parts.filter(F.col("batch") == b).drop("batch"))
    discard(parts)
    return family


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                batches: int = BATCHES, fan_in: int = FAN_IN) -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept``, the lines left joined again.

    A key found in ``min_docs`` documents or more keeps its lines only in the largest id.
    """
    docs = carried(docs)
    lines = stored(line_rows(docs, text, min_chars), "line-rows")
    family = build_family(lines, batches, fan_in)
    totals = family.totals().filter(F.col("n_docs") >= min_docs)
    spread = stored(totals, "line-spread")
    n = sum(run.agg(F.sum("n_docs")).first()[0] or 0 for run in family.runs())
    hot = F.col("n_docs") >= max(1000, int(n * HOT_SHARE))
    # at most 1 / HOT_SHARE keys reach the hot bound, so their side has a proven size
    common = lines.join(F.broadcast(spread.filter(hot)), ["h1", "h2"])
    rare = lines.join(spread.filter(~hot), ["h1", "h2"])
    lost = (
        common.unionByName(rare)
        .filter(F.col("_doc") < F.col("max_doc"))
        .groupBy("_doc", "_sum")
        .agg(F.collect_list("place").alias("_lost"))
    )
    doc, total = _row_key(text)
    left = docs.withColumns({"_doc": doc, "_sum": total})
    lines_of = F.split(whole_text(text), "\n")
    out = left.join(lost, ["_doc", "_sum"], "left").withColumn("_lines", lines_of)
    places = F.sequence(F.lit(0), F.size("_lines") - 1)
    stay = F.when(F.col("_lost").isNull(), places).otherwise(F.array_except(places, "_lost"))
    out = out.withColumn("_stay", stay)
    kept = F.when(F.col("_lost").isNull(), whole_text(text)).otherwise(
        F.array_join(F.transform("_stay", lambda i: F.get("_lines", i)), "\n")
    )
    return out.select(
        *docs.columns,
        F.size("_lines").cast("long").alias("_n_lines"),
        (F.size("_lines") - F.size("_stay")).cast("long").alias("_n_dropped"),
        kept.alias("_kept"),
    )
