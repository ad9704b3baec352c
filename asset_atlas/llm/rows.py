"""Column builders and byte-level text tools shared by the corpus operators.

The numpy part works on the value buffer of an Arrow string column, so a batch of documents is
handled with a few array passes and no Python string per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: blanks of the word and line contracts: space and tab .. carriage return
BLANKS = " \t\n\x0b\x0c\r"
CHUNK_BYTES = 2 << 20

_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)
_U = np.uint64


def whole_text(text: str = "text") -> Column:
    """The document's text; null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every input bit over the word."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[ord(c) for c in BLANKS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size + 1, _STEP, dtype=_U), np.full(size + 1, _BACK, dtype=_U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least ``size`` + 1 of each."""
    return _powers(1 << max(16, int(size).bit_length()))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any range of bytes, or of 64-bit symbols, follows with two lookups."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((_TABLE[data] if data.dtype == np.uint8 else mix(data)) * up[: len(data)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end), equal for equal bytes wherever they stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class Chunk(NamedTuple):
    """Rows ``first`` .. ``last`` of a batch: their bytes and where each text starts."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Byte views of a string column in runs of at most ``limit`` bytes (or one longer text)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    values = column.buffers()[2]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(bounds, bounds[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Chunk(first, last, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first])
        first = last


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def words(chunk: Chunk, lower: bool = True, kinds: np.ndarray | None = None,
          inside: np.ndarray | None = None) -> Words:
    """Maximal runs of non-blank bytes, A-Z lowered before hashing when asked for.

    ``kinds`` numbers byte values; a run is also cut between two bytes of different kinds above 0.
    ``inside`` marks the byte values of a word where these are not all but blanks.
    """
    data = _LOWER[chunk.data] if lower else chunk.data
    n = len(data)
    if n == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(_U))
    solid = ~_SPACE[data] if inside is None else inside[data]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[chunk.offsets] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | fresh[1:n]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | fresh[1:n]
    if kinds is not None:
        kind = kinds[data]
        turn = (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
        opens[1:] |= turn
        closes[:-1] |= turn
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    doc = np.searchsorted(chunk.offsets, start, side="right") - 1
    return Words(doc, start, end, range_hash(prefix_hash(data), start, end))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of each run of ``size`` words; a shorter text is one shingle of its words."""
    n_docs = int(w.doc[-1]) + 1 if len(w.doc) else 0
    count = np.bincount(w.doc, minlength=n_docs)
    h = np.zeros(len(w.hash), dtype=_U)
    reach = np.zeros(len(w.hash), dtype=np.int64)
    last = np.cumsum(count)[w.doc] if len(w.doc) else reach
    pos = np.arange(len(w.hash))
    for k in range(size):
        ok = pos + k < last
        at = pos[ok]
        h[at] = h[at] * _U(_STEP) + w.hash[at + k]
        reach[at] += 1
    first = np.cumsum(count) - count
    keep = reach == size
    short = np.flatnonzero((count > 0) & (count < size))
    keep[first[short]] = True
    return w.doc[keep], mix(h[keep])


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array of fixed-width numbers, stored plane by plane."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.dtype.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    head = len(raw).to_bytes(8, "little")
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(body: bytes, dtype) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    dtype = np.dtype(dtype)
    if not size:
        return np.zeros(0, dtype=dtype)
    raw = pa.decompress(body[8:], decompressed_size=size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """``pack`` of ascending keys as their differences."""
    return pack(np.diff(keys, prepend=_U(0)))


def unpack_sorted(body: bytes) -> np.ndarray:
    return np.cumsum(unpack(body, _U), dtype=_U)


def carried(docs: DataFrame, *outputs: str) -> DataFrame:
    """``docs`` without columns that clash: working names start with an underscore."""
    return docs.drop(*[c for c in docs.columns if c.startswith("_") or c.lower() in outputs])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
