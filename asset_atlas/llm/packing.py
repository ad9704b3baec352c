"""Best-fit packing of token pieces by linear grouping.

Documents are tokenised once, cut at the capacity and stored as pieces. The packing itself works on the
histogram of piece lengths, which has at most ``capacity`` rows whatever the corpus holds:

1. Large lengths are sorted, dealt into groups of equal cardinality and rounded up to the largest of
   their group, so few sizes are left.
2. Configurations, multisets of sizes that fit a sequence, are optimised by a linear programme whose
   columns come from a knapsack over the dual prices; its solution is rounded down.
3. Actual pieces take the slots of their group, longest first; what they leave of the rounded size is
   free again.
4. The pieces that rounding down left over, then the small ones, go longest first to the sequence with
   the least sufficient room.

Sequences that hold the same lengths stay one entry with a number of copies, so the plan is a bounded
list of runs: pieces of one length with ranks lo .. hi go to sequences first, first + 1, ... Ranks
within a length come from counters per task and prefix sums over tasks; no group of equal lengths is
ever sorted or gathered.

Defined cases: a null text is empty and an empty text is its end token alone; ids may be null or
repeat, every row is packed; very long texts are cut into pieces of the capacity and one rest; an
empty table gives no pieces; other columns pass through, those with a leading underscore are left out.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import carried, chunks, whole_text, words

CAPACITY = 4096
END = 1
#: pieces longer than this share of the capacity are large
LARGE_SHARE = 1 / 3
GROUPS = 256
#: most words a task keeps the ids of; beyond it the table starts anew
KNOWN_WORDS = 1 << 20
#: simplex steps; a solution short of the optimum is a valid packing too
MOST_STEPS = 4000

_U = np.uint64
#: the tokenizer's own splits between ASCII letters and these marks, made before it for fewer distinct words
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[*range(65, 91), *range(97, 123)]] = 1
_KINDS[[ord(c) for c in ",.;:!?()"]] = 2


def vocabulary(path: str | None = None) -> str:
    """The tokenizer file's text; read on the driver, so executors need no such file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


@lru_cache(maxsize=2)
def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


class WordIds:
    """Token ids of distinct words. The tokenizer lowers letters, drops white space and splits there and
    between letters and marks before any merge, so a text's ids are those of its words in order. Only its
    special tokens, which start with <|, are told by case."""

    def __init__(self, text: str):
        self.tok = _tokenizer(text)
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, dtype=_U)
        self.start = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        got = [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=size.sum())])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.start = np.concatenate([self.start, start])[order]
        self.size = np.concatenate([self.size, size])[order]

    def texts(self, chunk) -> Iterator[np.ndarray]:
        """Ids of each text of a chunk."""
        marks = np.flatnonzero(chunk.data[:-1] == ord("<"))
        w = words(chunk, lower=not (chunk.data[marks + 1] == ord("|")).any(), kinds=_KINDS)
        keys, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KNOWN_WORDS:
            self._reset()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            spelled = [chunk.data[w.start[i] : w.end[i]].tobytes().decode() for i in first[fresh]]
            self._learn(keys[fresh], spelled)
            place = np.searchsorted(self.keys, keys)
        start, size = self.start[place][at], self.size[place][at]
        ahead = np.concatenate([[0], np.cumsum(size)])
        flat = self.ids[np.repeat(start - ahead[:-1], size) + np.arange(ahead[-1])]
        edge = ahead[np.searchsorted(w.doc, np.arange(chunk.last - chunk.first + 1))]
        for i in range(chunk.last - chunk.first):
            yield flat[edge[i] : edge[i + 1]]


def pieces(docs: DataFrame, text: str = "text", vocabulary_text: str | None = None, capacity: int = CAPACITY,
           keep: list[str] | None = None, end: int = END) -> DataFrame:
    """A row per piece: ``keep`` columns (all but the text by default), ``_piece``, ``_start``, ``_length``
    and ``_ids``, little-endian 32-bit numbers; ``_block`` and ``_nth`` count equal lengths in a task."""
    docs = carried(docs)
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_text or vocabulary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, block = WordIds(shipped.value), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for c in chunks(batch.column("_text")):
                row, piece, start, size, ids, nth = [], [], [], [], [], []
                for i, found in enumerate(table.texts(c)):
                    whole = np.append(found, end).astype("<u4")
                    for k, at in enumerate(range(0, len(whole), capacity)):
                        part = whole[at : at + capacity]
                        row.append(c.first + i)
                        piece.append(k)
                        start.append(at)
                        size.append(len(part))
                        ids.append(part.tobytes())
                        nth.append(seen[len(part)])
                        seen[len(part)] += 1
                take = pa.array(row, pa.int64())
                columns = [batch.column(j).take(take) for j in range(len(keep))]
                columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                            pa.array(ids, pa.binary()), pa.array([block] * len(row), pa.int64()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    columns, names=[*keep, "_piece", "_start", "_length", "_ids", "_block", "_nth"])

    schema = docs.select(*keep).schema.add("_piece", "integer")
    for name, kind in (("_start", "long"), ("_length", "long"), ("_ids", "binary"), ("_block", "long"), ("_nth", "long")):
        schema = schema.add(name, kind)
    return docs.select(*keep, whole_text(text).alias("_text")).mapInArrow(run, schema)


class Run(NamedTuple):
    """Pieces of one length, ranks lo .. hi: ``each`` of them a sequence, from ``sequence`` and ``offset`` on."""

    length: int
    lo: int
    hi: int
    sequence: int
    offset: int
    each: int


def grouped(lengths: np.ndarray, counts: np.ndarray, groups: int) -> list[list[tuple[int, int]]]:
    """Descending (length, count) runs dealt into groups of equal cardinality (the last may be smaller)."""
    per = -(-int(counts.sum()) // groups)
    out, room = [], 0
    for length, n in zip(lengths.tolist(), counts.tolist(), strict=True):
        while n:
            if not room:
                out.append([])
                room = per
            take = min(n, room)
            out[-1].append((length, take))
            n, room = n - take, room - take
    return out


def _best_column(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most."""
    most = capacity // int(sizes.min())
    best = np.zeros(capacity + 1)
    picks = []
    for _ in range(most):
        grown, pick = best.copy(), np.full(capacity + 1, -1)
        for i in np.flatnonzero(price > 1e-12):
            s = int(sizes[i])
            value = best[: capacity + 1 - s] + price[i]
            better = value > grown[s:] + 1e-12
            grown[s:][better] = value[better]
            pick[s:][better] = i
        picks.append(pick)
        if np.array_equal(grown, best):
            break
        best = grown
    column, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[c] >= 0:
            column[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[capacity]), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(multiset, copies): the configuration programme's solution, rounded down."""
    g = len(sizes)
    columns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(MOST_STEPS):
        value, fresh = _best_column(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ fresh
        ratio = np.full(g, np.inf)
        up = step > 1e-9
        ratio[up] = x[up] / step[up]
        out = int(ratio.argmin())
        columns[:, out] = fresh
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out] if ratio[out] > 0 else 0.0
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
    whole = np.floor(x + 1e-6).astype(np.int64)
    # round-off must not hand out more slots than there are pieces
    out, left = [], demand.astype(np.int64).copy()
    for i in np.argsort(-whole, kind="stable"):
        column = columns[:, i].astype(np.int64)
        used = column > 0
        copies = int(min(whole[i], (left[used] // column[used]).min())) if used.any() else 0
        if copies:
            left -= column * copies
            out.append((column, copies))
    return out


class Rooms:
    """Runs of sequences with equal room, found by least sufficient room."""

    def __init__(self):
        self.sizes: list[int] = []
        self.runs: dict[int, list[tuple[int, int, int]]] = {}

    def add(self, room: int, sequence: int, copies: int, offset: int) -> None:
        if room > 0 and copies > 0:
            if room not in self.runs:
                insort(self.sizes, room)
            self.runs.setdefault(room, []).append((sequence, copies, offset))

    def take(self, length: int) -> tuple[int, int, int, int] | None:
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        room = self.sizes[at]
        got = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room], self.sizes[at]
        return room, *got


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS,
         large_share: float = LARGE_SHARE) -> list[Run]:
    """Runs that place every piece of the histogram; ranks start from 0 within a length."""
    order = np.argsort(-lengths, kind="stable")
    lengths, counts = lengths[order], counts[order]
    runs: list[Run] = []
    rank = dict.fromkeys(lengths.tolist(), 0)
    rooms, sequence = Rooms(), 0
    left = dict(zip(lengths.tolist(), counts.tolist(), strict=True))

    def place(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        runs.append(Run(length, rank[length], rank[length] + n, first, offset, each))
        rank[length] += n
        left[length] -= n

    if left.get(capacity):
        n = left[capacity]
        place(capacity, n, sequence, 0)
        sequence += n
    large = (lengths < capacity) & (lengths > capacity * large_share)
    if large.any():
        parts = grouped(lengths[large], counts[large], groups)
        sizes = np.array([p[0][0] for p in parts])
        demand = np.array([sum(n for _, n in p) for p in parts])
        queue = [list(p) for p in parts]
        for column, copies in configurations(sizes, demand, capacity):
            slots = np.repeat(np.arange(len(sizes)), column)
            # sequences filled slot by slot; a change of length in any slot ends a stretch of equal ones
            stretches = [(sequence, copies, 0)]
            for g in slots:
                filled = []
                for first, n, used in stretches:
                    while n:
                        length, have = queue[g][0]
                        take = min(n, have)
                        place(length, take, first, used)
                        filled.append((first, take, used + length))
                        first, n = first + take, n - take
                        if take == have:
                            queue[g].pop(0)
                        else:
                            queue[g][0] = (length, have - take)
                stretches = filled
            for first, n, used in stretches:
                rooms.add(capacity - used, first, n, used)
            sequence += copies
    for length in lengths.tolist():
        while left[length]:
            n = left[length]
            found = rooms.take(length)
            if found is None:
                each = capacity // length
                full = n // each
                if full:
                    place(length, full * each, sequence, 0, each)
                    rooms.add(capacity - each * length, sequence, full, each * length)
                elif n:
                    place(length, n, sequence, 0, n)
                    rooms.add(capacity - n * length, sequence, 1, n * length)
                sequence += max(full, 1)
                continue
            room, first, copies, offset = found
            each = min(room // length, n)
            full = min(copies, n // each)
            place(length, full * each, first, offset, each)
            rooms.add(room - each * length, first, full, offset + each * length)
            rooms.add(room, first + full, copies - full, offset)
    return runs


def packed(table: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """A stored table of ``pieces`` with ``_sequence`` and ``_offset``."""
    counts = table.groupBy("_block", "_length").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_block", "_length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    # at most ``capacity`` rows
    rows = counts.groupBy("_length").agg(F.sum("_n").alias("n")).collect()
    got = plan(np.array([r["_length"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.int64),
               capacity, groups)
    got.sort()
    runs = np.array(got, dtype=np.int64).reshape(-1, 6)
    shipped = table.sparkSession.sparkContext.broadcast(runs)
    keep = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shipped.value
        # ranks within a length start at 0, so lengths and ranks together order the runs
        edges = np.searchsorted(runs[:, 0], np.arange(capacity + 2))
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("_length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            at = np.zeros(len(length), dtype=np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                mine = order[a:b]
                lo, hi = edges[length[mine[0]]], edges[length[mine[0]] + 1]
                at[mine] = lo + np.searchsorted(runs[lo:hi, 1], rank[mine], side="right") - 1
            found = runs[at]
            turn, nth = np.divmod(rank - found[:, 1], found[:, 5])
            columns = [batch.column(c) for c in keep]
            columns += [pa.array(found[:, 3] + turn, pa.int64()), pa.array(found[:, 4] + nth * length, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_sequence", "_offset"])

    ranked = table.join(base, ["_block", "_length"]).select(*keep, (F.col("_base") + F.col("_nth")).alias("_rank"))
    schema = table.schema.add("_sequence", "long").add("_offset", "long")
    return ranked.mapInArrow(run, schema).drop("_block", "_nth")


def pack(docs: DataFrame, text: str = "text", vocabulary_text: str | None = None, capacity: int = CAPACITY,
         groups: int = GROUPS, keep: list[str] | None = None) -> DataFrame:
    """Pieces of ``docs`` with their ids, ``_sequence`` and ``_offset``."""
    return packed(stored(pieces(docs, text, vocabulary_text, capacity, keep), "packing-pieces"), capacity, groups)


def sequences(placed: DataFrame) -> DataFrame:
    """(_sequence, _length, _ids): the training rows; a sequence holds at most ``capacity`` pieces."""
    part = F.struct("_offset", "_ids", "_length")
    rows = placed.groupBy("_sequence").agg(F.sort_array(F.collect_list(part)).alias("_parts"))
    join = F.aggregate("_parts", F.lit(b""), lambda x, p: F.concat(x, p["_ids"]))
    size = F.aggregate("_parts", F.lit(0).cast("long"), lambda x, p: x + p["_length"])
    return rows.select("_sequence", size.alias("_length"), join.alias("_ids"))
