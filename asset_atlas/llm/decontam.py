"""Benchmark decontamination: SimHash windows of the items' sizes against a Hamming multi-index.

Items are the query set; they come to the driver in blocks of ``BLOCK_ITEMS`` and every block is
held against all documents inside an Arrow map. A window can only resemble an item if they share a
shingle, so fingerprints are taken of just those windows, of each item size, that hold a shingle of
the block. The fingerprints meet the items' through four 16-bit tables: two 64-bit fingerprints
within ``RADIUS`` agree to within a quarter of it in one of the four, and the tables list all such
values, so no pair within the radius is missed. Candidates are verified by the weighted Jaccard
similarity of their shingle counts.

Defined cases: null and empty texts match nothing; items without words match nothing; items of fewer
words than a shingle are one shingle of all their words and match where those words stand; texts
shorter than an item are one window; items that share an id or a text are reported one by one; a
null id stays null; with no items nothing matches and all documents are clean; other columns pass
through ``clean``, those with a leading underscore are left out, and are ignored by ``matches``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Chunk, carried, chunks, mix, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 19
BLOCK_ITEMS = 1000
_PARTS, _WIDTH = 4, 16

_U = np.uint64
_ONES = np.array([bin(i).count("1") for i in range(1 << _WIDTH)], dtype=np.uint8)


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words."""
    n = max(len(h) - size + 1, 0)
    out = np.zeros(n, dtype=_U)
    for k in range(size):
        out = out * _U(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """One row of 64 signs per shingle."""
    bits = (shingles[:, None] >> np.arange(64, dtype=_U)[None, :]) & _U(1)
    return bits.astype(np.int32) * 2 - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    """SimHash of rows of 64 sums; a tie counts as one."""
    return np.packbits(sums >= 0, axis=1, bitorder="little").view("<u8").ravel()


class Item(NamedTuple):
    key: int
    n_words: int
    shingles: np.ndarray
    counts: np.ndarray


class Index(NamedTuple):
    """One block of items ready for search."""

    items: list[Item]
    sizes: np.ndarray
    known: np.ndarray
    sieve: np.ndarray
    prints: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def build_index(texts: list[tuple[int, str]], radius: int = RADIUS) -> Index:
    items, short = [], {}
    for key, text in texts:
        column = pa.array([text], pa.large_string())
        h = np.concatenate([words(c).hash for c in chunks(column)] or [np.zeros(0, _U)])
        if len(h) >= SHINGLE:
            s, n = np.unique(_runs(h, SHINGLE), return_counts=True)
            items.append(Item(key, len(h), s, n))
        elif len(h):
            short.setdefault(len(h), []).append((_runs(h, len(h))[0], key))
    prints = np.zeros(len(items), dtype=_U)
    for i, it in enumerate(items):
        prints[i] = _fingerprint((_signs(it.shingles) * it.counts[:, None]).sum(axis=0)[None, :])[0]
    values = np.arange(1 << _WIDTH, dtype=np.uint32)
    tables = []
    for p in range(_PARTS):
        part = ((prints >> _U(p * _WIDTH)) & _U(0xFFFF)).astype(np.uint32)
        hits = [np.flatnonzero(_ONES[values ^ v] <= radius // _PARTS) for v in part]
        at = np.concatenate([*hits, np.zeros(0, int)])
        who = np.repeat(np.arange(len(items)), [len(x) for x in hits])
        order = np.argsort(at, kind="stable")
        tables.append((np.searchsorted(at[order], np.arange((1 << _WIDTH) + 1)), who[order].astype(np.int32)))
    known = np.unique(np.concatenate([it.shingles for it in items] or [np.zeros(0, _U)]))
    sieve = np.zeros(1 << 20, dtype=bool)
    sieve[(known >> _U(44)).astype(np.int64)] = True
    exact = {}
    for n, pairs in short.items():
        pairs.sort(key=lambda x: int(x[0]))
        exact[n] = (np.array([x[0] for x in pairs], _U), np.array([x[1] for x in pairs]))
    return Index(items, np.unique([it.n_words for it in items]).astype(int), known, sieve, prints, tables, exact)


def _near(prints: np.ndarray, index: Index, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) pairs within the radius, each once, nearest first."""
    wins, whos, apart_by = [], [], []
    for p, (edge, who) in enumerate(index.tables):
        v = ((prints >> _U(p * _WIDTH)) & _U(0xFFFF)).astype(np.int64)
        n = edge[v + 1] - edge[v]
        win = np.repeat(np.arange(len(prints)), n)
        at = np.repeat(edge[v], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        item = who[at]
        apart = prints[win] ^ index.prints[item]
        distance = sum(_ONES[((apart >> _U(q * _WIDTH)) & _U(0xFFFF)).astype(np.int64)].astype(int) for q in range(_PARTS))
        wins.append(win[distance <= radius])
        whos.append(item[distance <= radius])
        apart_by.append(distance[distance <= radius])
    n = max(len(index.items), 1)
    pair, first = np.unique(np.concatenate(wins) * n + np.concatenate(whos), return_index=True)
    pair = pair[np.argsort(np.concatenate(apart_by)[first], kind="stable")]
    return pair // n, pair % n


def _similarity(window: np.ndarray, item: Item) -> float:
    s, n = np.unique(window, return_counts=True)
    at = np.searchsorted(item.shingles, s)
    at[at == len(item.shingles)] = 0
    shared = np.where(item.shingles[at] == s, np.minimum(n, item.counts[at]), 0).sum()
    return float(shared / (len(window) + item.counts.sum() - shared))


def _search(h: np.ndarray, hits: np.ndarray, index: Index, radius: int, least: float) -> dict[int, tuple]:
    """Best (similarity, first word, end word) of each item found in one text.

    ``h``: word hashes; ``hits``: places where a shingle of the block starts, ascending. Hits
    further apart than the longest item share no window and are searched apart.
    """
    found: dict[int, tuple] = {}
    runs = _runs(h, SHINGLE)
    reach = int(index.sizes[-1])
    lengths = np.array([it.n_words - SHINGLE + 1 for it in index.items])
    for hit in np.split(hits, np.flatnonzero(np.diff(hits) > reach) + 1):
        low, high = max(int(hit[0]) - reach, 0), min(int(hit[-1]) + reach, len(runs))
        sums = np.zeros((high - low + 1, 64), dtype=np.int32)
        np.cumsum(_signs(runs[low:high]), axis=0, out=sums[1:])
        before = np.zeros(high - low + 1, dtype=np.int64)
        before[hit - low + 1] = 1
        before = np.cumsum(before)
        starts, ends = [], []
        for width in np.unique(np.minimum(index.sizes, len(h)) - SHINGLE + 1):
            start = np.arange(max(high - low - int(width), 0) + 1)
            start = start[before[np.minimum(start + width, high - low)] > before[start]]
            starts.append(start)
            ends.append(np.minimum(start + width, high - low))
        start, end = np.concatenate(starts), np.concatenate(ends)
        for a in range(0, len(start), 8192):
            x, y = start[a : a + 8192], end[a : a + 8192]
            win, who = _near(_fingerprint(sums[y] - sums[x]), index, radius)
            # what a window shares with an item is at most its shingles known to the block
            size, mine, known = lengths[who], y[win] - x[win], (before[y] - before[x])[win]
            shared = np.minimum(np.minimum(mine, size), known)
            ok = shared >= least * (mine + size - shared)
            for w, i in zip(win[ok], who[ok], strict=True):
                best = found.get(int(i), (0.0, 0, 0))
                if best[0] == 1.0:
                    continue
                s = _similarity(runs[low + x[w] : low + y[w]], index.items[i])
                if s >= least and s > best[0]:
                    found[int(i)] = (s, int(low + x[w]), int(low + y[w]) + SHINGLE - 1)
    return found


def search_chunk(chunk: Chunk, index: Index, radius: int = RADIUS, least: float = SIMILARITY) -> list[tuple]:
    """(text of the chunk, item key, similarity, first byte, end byte) of every item found."""
    w = words(chunk)
    out = []
    if not len(w.hash):
        return out
    edge = np.searchsorted(w.doc, np.arange(len(chunk.offsets)))

    def inside(size: int) -> np.ndarray:
        last = np.arange(len(w.doc) - size + 1)
        return last[w.doc[last] == w.doc[last + size - 1]] if len(last) else last

    if len(index.items) and len(w.doc) >= SHINGLE:
        at = inside(SHINGLE)
        h = _runs(w.hash, SHINGLE)[at]
        maybe = index.sieve[(h >> _U(44)).astype(np.int64)]
        at, h = at[maybe], h[maybe]
        place = np.searchsorted(index.known, h)
        place[place == len(index.known)] = 0
        at = at[index.known[place] == h]
        for doc in np.unique(w.doc[at]):
            a, b = edge[doc], edge[doc + 1]
            mine = at[np.searchsorted(at, a) : np.searchsorted(at, b)] - a
            for i, (s, x, y) in _search(w.hash[a:b], mine, index, radius, least).items():
                base = chunk.offsets[doc]
                out.append((int(doc), index.items[i].key, s, int(w.start[a + x] - base), int(w.end[a + y - 1] - base)))
    for size, (hashes, keys) in index.short.items():
        if len(w.doc) < size:
            continue
        at = inside(size)
        h = _runs(w.hash, size)[at]
        for hash_, key in zip(hashes, keys, strict=True):
            for doc, first in zip(*np.unique(w.doc[at[h == hash_]], return_index=True), strict=True):
                x, base = at[h == hash_][first], chunk.offsets[doc]
                out.append((int(doc), int(key), 1.0, int(w.start[x] - base), int(w.end[x + size - 1] - base)))
    return out


def item_blocks(items: DataFrame, text: str = "text", block: int = BLOCK_ITEMS) -> Iterator[Index]:
    """Indexes over blocks of about ``block`` items; only one block is on the driver at a time."""
    n = items.count()
    parts = max(1, -(-n // block))
    keyed = items.select(F.col("item_id").cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for p in range(parts):
        mine = keyed.filter(F.pmod(F.xxhash64("key", "text"), F.lit(parts)) == p) if parts > 1 else keyed
        yield build_index([(r["key"], r["text"]) for r in mine.orderBy("key", "text").collect()])


def _matcher(index: Index, radius: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c.first + d, *rest) for c in chunks(batch.column("_text")) for d, *rest in search_chunk(c, index, radius, least)]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(take), *[pa.array([r[i] for r in rows], t) for i, t in
                 ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]],
                names=["doc_id", "item_id", "similarity", "first_byte", "end_byte"],
            )

    return run


def matches(docs: DataFrame, items: DataFrame, text: str = "text", radius: int = RADIUS,
            least: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, first_byte, end_byte): the best window of each item per row."""
    source = docs.select("doc_id", F.col(text).alias("_text"))
    fields = "doc_id bigint, item_id bigint, similarity double, first_byte bigint, end_byte bigint"
    out = None
    for index in item_blocks(items, text, block):
        part = source.mapInArrow(_matcher(index, radius, least), fields)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, text: str = "text", radius: int = RADIUS,
          least: float = SIMILARITY, block: int = BLOCK_ITEMS) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    docs = carried(docs)
    columns = docs.columns
    out = docs.withColumn("_text", F.col(text))
    for index in item_blocks(items, text, block):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = [c.first + r[0] for c in chunks(batch.column("_text")) for r in search_chunk(c, index, radius, least)]
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[bad] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.select(*columns)
