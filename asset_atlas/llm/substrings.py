"""Suffix-array dedup of long byte strings with a logarithmic family of indexes.

Suffixes are sampled by content: of every 400-byte string the position with the least hash of 128
bytes is kept, so equal strings keep a suffix at the same place. A batch's array holds its sampled
suffixes in the order of the fingerprint of their first 128 bytes, and beside it the array of whole
neighbourhoods, the text of all strings that sampled this suffix. Arrays of equal level merge
geometrically; a batch is answered by merge-scanning its own sorted keys with all live levels.

A neighbourhood found twice is repeated as a whole. Where different neighbourhoods share the 128
bytes, the strings of one copy of each are compared one by one by their own hashes. A string is told
by a 64-bit hash of all its bytes.

The same family finds repeated passages by words: there a symbol is the hash of a word and a string is 51
of them, so a passage counts whatever its bytes.

Defined cases: null and empty texts have no bytes; texts under 400 bytes keep all; a repeated row
is another place of all its strings; ids may be null or repeat; an empty table gives an empty
result; other columns pass through, those with a leading underscore are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored
from . import exchange
from .rows import Chunk, carried, chunks, mix, pack, prefix_hash, range_hash, unpack, whole_text, words

LENGTH = 400
PREFIX = 128
BATCHES = 4
FAN_IN = 2
BLOCK_BYTES = 16 << 20
SUFFIXES, PLACES, STRINGS = 1, 2, 3
BLOCK = "block bigint, batch int, docs array<bigint>, sums array<bigint>, n bigint, doc binary, first binary, last binary, suffix binary, place binary"
MARKS = "_doc bigint, _sum bigint, sure array<bigint>, open array<bigint>"
STRING_BLOCK = "block bigint, docs array<bigint>, sums array<bigint>, n bigint, doc binary, start binary, hash binary"
SPANS = "_doc bigint, _sum bigint, spans array<bigint>"

_U = np.uint64


def _as_words(chunk: Chunk) -> Chunk:
    """The chunk with a symbol per word."""
    w = words(chunk)
    return Chunk(chunk.first, chunk.last, w.hash, np.searchsorted(w.doc, np.arange(chunk.last - chunk.first + 1)))


class Grain(NamedTuple):
    """Strings of ``length`` symbols, sampled by ``prefix`` of them; ``symbols`` turns a chunk's bytes into symbols."""

    length: int
    prefix: int
    symbols: Callable[[Chunk], Chunk]


BYTES = Grain(LENGTH, PREFIX, lambda chunk: chunk)
#: passages of over 50 words
WORDS = Grain(51, 16, _as_words)


def _row_key(text: str) -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(whole_text(text)).alias("_sum")]


def sampled(chunk: Chunk, length: int = LENGTH, prefix: int = PREFIX) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, suffix hash, neighbourhood hash) of each sampled suffix.

    The strings of ``length`` bytes that start at first .. last have their sample in common.
    """
    n, width = len(chunk.data), length - prefix + 1
    none = np.zeros(0, dtype=np.int64)
    if n < length:
        return none, none, none, none.astype(_U), none.astype(_U)
    hashes = prefix_hash(chunk.data)
    at = np.arange(n - prefix + 1)
    key = (range_hash(hashes, at, at + prefix) & _U(0xFFFFFFFF00000000)) | at.astype(_U)
    # sliding minimum: suffix minima of one stretch of ``width`` meet prefix minima of the next
    size = len(key)
    rows = -(-size // width)
    grid = np.full(rows * width, ~_U(0), dtype=_U)
    grid[:size] = key
    grid = grid.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    last = n - length
    least = np.minimum(behind[: last + 1], ahead[width - 1 : width + last])
    pick = (least & _U(0xFFFFFFFF)).astype(np.int64)
    del grid, ahead, behind, key, least
    # starts whose string lies inside one text
    edge = np.zeros(n + 1, dtype=np.int32)
    bounds = chunk.offsets
    np.add.at(edge, bounds[:-1], 1)
    text = np.cumsum(edge[: last + 1], dtype=np.int64) - 1
    inside = np.flatnonzero(np.arange(last + 1) + length <= bounds[text + 1])
    if not len(inside):
        return none, none, none, none.astype(_U), none.astype(_U)
    pick, text = pick[inside], text[inside]
    fresh = np.ones(len(inside), dtype=bool)
    fresh[1:] = (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(fresh)
    stop = np.append(start[1:], len(inside)) - 1
    first, last, pick, text = inside[start], inside[stop], pick[start], text[start]
    suffix = range_hash(hashes, pick, pick + prefix)
    place = range_hash(hashes, first, last + length)
    place = mix(place + (pick - first).astype(_U) * _U(0x9E3779B97F4A7C15) + (last - first).astype(_U))
    base = bounds[text]
    return text, first - base, last - base, suffix, place


def _sample(batches_of: int, grain: Grain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit() -> pa.RecordBatch:
            docs, sums, parts = zip(*held, strict=True)
            shift = np.cumsum([0, *[len(d) for d in docs]])
            text = np.concatenate([p[0] + s for p, s in zip(parts, shift, strict=False)])
            first, last, suffix, place = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
            block = base + number
            batch = int(mix(np.array([block], dtype=_U))[0] % _U(batches_of))
            row = [block, batch, pa.concat_arrays(docs).to_pylist(), pa.concat_arrays(sums).to_pylist(), len(text),
                   pack(np.diff(text, prepend=0).astype(np.uint32)), pack(first.astype(np.uint32)),
                   pack((last - first).astype(np.uint32)), pack(suffix), pack(place)]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 5]
            names = [f.split()[0] for f in BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for c in chunks(batch.column("_text")):
                rows = c.last - c.first
                held.append((batch.column("_doc").slice(c.first, rows), batch.column("_sum").slice(c.first, rows), sampled(grain.symbols(c), grain.length, grain.prefix)))
                size += len(c.data)
                if size >= BLOCK_BYTES:
                    yield emit()
                    number, held, size = number + 1, [], 0
        if held:
            yield emit()

    return run


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.unique(values, return_counts=True)
    return keys, counts.astype(np.uint32)[:, None]


def _arrays(shards: int, hits: bool):
    """Sorted keys of each block, with their counts for an index and without for a question."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                rows = []
                for kind, body in ((SUFFIXES, row.suffix), (PLACES, row.place)):
                    keys, counts = _distinct(unpack(body, _U))
                    rows += exchange.messages(kind, row.block, keys, counts if hits else counts * np.uint32(0), shards)
                yield exchange.as_frame(rows, ["kind", "shard", "block", "keys", "body"])

    return run


class IndexFamily:
    """Sorted arrays on levels; ``fan_in`` arrays of a level merge into one of the next."""

    def __init__(self, fan_in: int = FAN_IN):
        self.fan_in = fan_in
        self.levels: list[list[DataFrame]] = []

    def live(self) -> list[DataFrame]:
        return [a for level in self.levels for a in level]

    def add(self, arrays: DataFrame) -> None:
        """Add a batch's messages as one sorted array per shard."""
        merged = exchange.by_shard(arrays, exchange.merge_index(np.uint32, 1), exchange.MESSAGE)
        self._place(stored(merged, "suffix-level", "kind"), 0)

    def _place(self, array: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(array)
        if len(self.levels[level]) < self.fan_in:
            return
        old, self.levels[level] = self.levels[level], []
        both = old[0]
        for other in old[1:]:
            both = both.unionByName(other)
        merged = exchange.by_shard(both, exchange.merge_index(np.uint32, 1), exchange.MESSAGE)
        self._place(stored(merged, "suffix-level", "kind"), level + 1)
        for gone in old:
            discard(gone)

    def answer(self, questions: DataFrame) -> DataFrame:
        """Merge-scan of the questions with every live level."""
        rows = questions
        for array in self.live():
            rows = rows.unionByName(array.select(questions.columns))
        return exchange.by_shard(rows, exchange.sums(np.uint32, 1, owners=True), exchange.ANSWER)


def _mark(length: int):
    """Repeated spans, and ranges of starts still open, of each text of a block."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            suffix, place = unpack(row.suffix, _U), unpack(row.place, _U)
            text = np.cumsum(unpack(row.doc, np.uint32).astype(np.int64))
            first = unpack(row.first, np.uint32).astype(np.int64)
            last = first + unpack(row.last, np.uint32)
            found = []
            for kind, values in ((SUFFIXES, suffix), (PLACES, place)):
                _, one, at = np.unique(values, return_index=True, return_inverse=True)
                answer = exchange.read_answers(right, kind, np.uint32)[0]
                found.append(answer[at] // 2)
            sure = found[1] > 1
            # one place stands for all of its copies where other places share the suffix
            speaks = np.zeros(len(place), dtype=bool)
            speaks[one] = answer % 2 == 1
            open_ = (found[0] > found[1]) & (~sure | speaks)
            docs, sums = np.asarray(row.docs), np.asarray(row.sums)
            for t in np.unique(text[sure | open_]):
                a, b = np.searchsorted(text, [t, t + 1])
                s, o = sure[a:b], open_[a:b]
                out.append((int(docs[t]), int(sums[t]),
                            np.stack([first[a:b][s], last[a:b][s] + length], 1).ravel().tolist(),
                            np.stack([first[a:b][o], last[a:b][o] + 1], 1).ravel().tolist()))
        return pd.DataFrame(out, columns=["_doc", "_sum", "sure", "open"])

    return run


def _spread(ranges: np.ndarray) -> np.ndarray:
    """All whole numbers of ascending [start, end) ranges."""
    size = ranges[:, 1] - ranges[:, 0]
    return np.repeat(ranges[:, 0] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _strings(grain: Grain):
    """Hashes of the open strings of each text, gathered into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def emit() -> pa.RecordBatch:
            docs, sums, text, start, h = zip(*held, strict=True)
            shift = np.cumsum([0, *[len(d) for d in docs]])
            text = np.concatenate([t + s for t, s in zip(text, shift, strict=False)])
            row = [base + number, pa.concat_arrays(docs).to_pylist(), pa.concat_arrays(sums).to_pylist(), len(text),
                   pack(np.diff(text, prepend=0).astype(np.uint32)), pack(np.concatenate(start).astype(np.uint32)),
                   pack(np.concatenate(h))]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * 3]
            names = [f.split()[0] for f in STRING_BLOCK.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            ranges = batch.column("open").to_pylist()
            for c in map(grain.symbols, chunks(batch.column("_text"))):
                hashes = prefix_hash(c.data)
                text, start = [], []
                for i in range(c.last - c.first):
                    at = _spread(np.asarray(ranges[c.first + i], dtype=np.int64).reshape(-1, 2))
                    text.append(np.full(len(at), i))
                    start.append(at)
                text, start = np.concatenate(text), np.concatenate(start)
                at = start + c.offsets[text]
                rows = c.last - c.first
                held.append((batch.column("_doc").slice(c.first, rows), batch.column("_sum").slice(c.first, rows),
                             text, start, range_hash(hashes, at, at + grain.length)))
                size += len(text)
                if size >= 2_000_000:
                    yield emit()
                    number, held, size = number + 1, [], 0
        if held:
            yield emit()

    return run


def _ask_strings(shards: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                keys, counts = _distinct(unpack(row.hash, _U))
                rows = exchange.messages(STRINGS, row.block, keys, counts, shards)
                yield exchange.as_frame(list(rows), ["kind", "shard", "block", "keys", "body"])

    return run


def _runs(start: np.ndarray, length: int) -> list[int]:
    """[start, end) of the merged strings at ascending starts, flattened."""
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:] > start[:-1] + length
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(start)) - 1
    return np.stack([start[first], start[last] + length], 1).ravel().tolist()


def _settle(length: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            text = np.cumsum(unpack(row.doc, np.uint32).astype(np.int64))
            start = unpack(row.start, np.uint32).astype(np.int64)
            _, at = np.unique(unpack(row.hash, _U), return_inverse=True)
            twice = exchange.read_answers(right, STRINGS, np.uint32)[0][at] > 1
            text, start = text[twice], start[twice]
            docs, sums = np.asarray(row.docs), np.asarray(row.sums)
            for t in np.unique(text):
                a, b = np.searchsorted(text, [t, t + 1])
                out.append((int(docs[t]), int(sums[t]), _runs(np.sort(start[a:b]), length)))
        return pd.DataFrame(out, columns=["_doc", "_sum", "spans"])

    return run


def merged(flat: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that flattened [start, end) spans cover."""
    pairs = np.asarray(flat, dtype=np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    first = np.flatnonzero(np.append(True, pairs[1:, 0] > reach[:-1]))
    return pairs[first, 0], reach[np.append(first[1:], len(pairs)) - 1]


def _cut_bytes(keep: int):
    """Adds byte counts and the bytes left to the first ``keep`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, n_bytes, n_removed, n_spans, kept = batch.column("_spans").to_pylist(), [], [], [], []
            for c in chunks(batch.column("_text")):
                for i in range(c.last - c.first):
                    data = c.data[c.offsets[i] : c.offsets[i + 1]]
                    n_bytes.append(len(data))
                    flat = spans[c.first + i]
                    if not flat:
                        n_removed.append(0)
                        n_spans.append(0)
                        kept.append(data.tobytes())
                        continue
                    start, end = merged(flat)
                    lost = np.zeros(len(data) + 1, dtype=np.int32)
                    lost[start] += 1
                    lost[end] -= 1
                    kept.append(data[np.cumsum(lost[:-1]) == 0].tobytes())
                    n_removed.append(int((end - start).sum()))
                    n_spans.append(len(start))
            columns = [batch.column(i) for i in range(keep)]
            columns += [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)] + [pa.array(kept, pa.binary())]
            names = [*batch.schema.names[:keep], "_n_bytes", "_n_removed", "_n_spans", "_kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def build_family(blocks: DataFrame, shards: int, batches: int = BATCHES, fan_in: int = FAN_IN) -> IndexFamily:
    family = IndexFamily(fan_in)
    for b in range(batches):
        mine = blocks.filter(F.col("batch") == b).mapInPandas(_arrays(shards, True), exchange.MESSAGE)
        family.add(mine)
    return family


def repeated_spans(docs: DataFrame, text: str = "text", batches: int = BATCHES, fan_in: int = FAN_IN,
                   grain: Grain = BYTES) -> DataFrame:
    """(_doc, _sum, _spans): spans of repeated strings in symbols, unmerged, of the texts that have some."""
    source = docs.select(*_row_key(text), F.col(text).alias("_text"))
    blocks = stored(source.mapInArrow(_sample(batches, grain), BLOCK), "suffix-blocks")
    shards = exchange.shard_count(exchange.count_rows(blocks, "n"))
    family = build_family(blocks, shards, batches, fan_in)
    asked = blocks.mapInPandas(_arrays(shards, False), exchange.MESSAGE)
    answers = family.answer(asked)
    marks = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_mark(grain.length), MARKS)
    marks = stored(marks, "suffix-marks")
    for used in (blocks, *family.live()):
        discard(used)
    open_ = marks.filter(F.size("open") > 0).select("_doc", "_sum", "open")
    strings = stored(
        source.join(open_, ["_doc", "_sum"]).select("_doc", "_sum", "_text", "open").mapInArrow(_strings(grain), STRING_BLOCK),
        "suffix-strings")
    shards = exchange.shard_count(exchange.count_rows(strings, "n"))
    asked = strings.mapInPandas(_ask_strings(shards), exchange.MESSAGE)
    answers = exchange.by_shard(asked, exchange.sums(np.uint32, 1), exchange.ANSWER)
    settled = strings.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_settle(grain.length), SPANS)
    found = marks.filter(F.size("sure") > 0).select("_doc", "_sum", F.col("sure").alias("spans")).unionByName(settled)
    spans = found.groupBy("_doc", "_sum").agg(F.flatten(F.collect_list("spans")).alias("_spans"))
    spans = stored(spans, "suffix-spans")
    for used in (marks, strings):
        discard(used)
    return spans


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, batches: int = BATCHES,
                   fan_in: int = FAN_IN) -> DataFrame:
    """``keep`` columns (all by default) with ``_n_bytes``, ``_n_removed``, ``_n_spans`` and ``_kept`` bytes."""
    docs = carried(docs)
    keep = docs.columns if keep is None else keep
    spans = repeated_spans(docs, text, batches, fan_in)
    doc, total = _row_key(text)
    wide = docs.withColumns({"_doc": doc, "_sum": total}).join(spans, ["_doc", "_sum"], "left")
    wide = wide.select(*keep, F.col(text).alias("_text"), "_spans")
    schema = docs.select(*keep).schema
    for name in ("_n_bytes", "_n_removed", "_n_spans"):
        schema = schema.add(name, "long")
    return wide.mapInArrow(_cut_bytes(len(keep)), schema.add("_kept", "binary"))


def repeated_passages(docs: DataFrame, text: str = "text", keep: list[str] | None = None, batches: int = BATCHES,
                      fan_in: int = FAN_IN, grain: Grain = WORDS) -> DataFrame:
    """``keep`` columns with ``_passages``, the maximal runs of words covered by strings of ``grain.length``
    words that also start elsewhere, as (first, last + 1) word numbers; empty for texts without."""
    docs = carried(docs)
    keep = docs.columns if keep is None else keep
    spans = repeated_spans(docs, text, batches, fan_in, grain)
    runs_type = "array<struct<first:bigint,last:bigint>>"

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            runs = [list(zip(*(x.tolist() for x in merged(list(f))), strict=True)) for f in pdf["_spans"]]
            yield pdf[["_doc", "_sum"]].assign(_passages=[[{"first": a, "last": b} for a, b in r] for r in runs])

    found = spans.mapInPandas(run, f"_doc bigint, _sum bigint, _passages {runs_type}")
    doc, total = _row_key(text)
    wide = docs.select(*keep, doc, total).join(found, ["_doc", "_sum"], "left")
    return wide.select(*keep, F.coalesce("_passages", F.array().cast(runs_type)).alias("_passages"))
