"""Sums per key across blocks of documents, with sorted packed runs in place of one row per key.

A block asks for its distinct 64-bit keys. Its sorted keys fall into shards by their leading bits; a
message carries one shard's keys as differences together with the block's values. A shard adds the
values of equal keys over all messages and answers every block in the order of the keys it sent, so
an answer needs no keys. Keys are hashes, so shards are even whatever the data; a key held by many
documents is one entry per block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import pack, pack_sorted, unpack, unpack_sorted

MESSAGE = "kind int, shard int, block bigint, keys binary, body binary"
ANSWER = "kind int, shard int, block bigint, body binary, stats array<bigint>"
#: level rows hold an index instead of a question
INDEX = -1

_U = np.uint64


def shard_count(keys: int, per_shard: int = 1_000_000) -> int:
    """Power of two that leaves a shard about ``per_shard`` keys."""
    return 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / per_shard)))) if keys > per_shard else 1


def messages(kind: int, block: int, keys: np.ndarray, values: np.ndarray, shards: int) -> Iterator[tuple]:
    """Rows of ``MESSAGE`` for one block's ascending distinct keys; ``values`` has a row per key."""
    if shards == 1:
        edge = np.array([0, len(keys)])
    else:
        cuts = np.arange(1, shards, dtype=_U) << _U(64 - (shards.bit_length() - 1))
        edge = np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])
    for s in np.flatnonzero(np.diff(edge)):
        part = slice(edge[s], edge[s + 1])
        yield kind, int(s), block, pack_sorted(keys[part]), pack(np.ascontiguousarray(values[part].T))


def as_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns)


class Shard:
    """All messages of one shard, keys merged."""

    def __init__(self, pdf: pd.DataFrame, dtype, width: int):
        pdf = pdf.sort_values("block", kind="stable")
        self.kind, self.shard = int(pdf["kind"].iloc[0]), int(pdf["shard"].iloc[0])
        self.blocks = pdf["block"].tolist()
        runs = [unpack_sorted(b) for b in pdf["keys"]]
        self.edge = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        keys = np.concatenate(runs)
        del runs
        values = np.concatenate([unpack(b, dtype).reshape(width, -1) for b in pdf["body"]], axis=1)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        self.first = np.flatnonzero(fresh)
        self.keys = ranked[self.first]
        self.order = order
        self.place = np.empty(len(keys), dtype=np.int64)
        self.place[order] = np.cumsum(fresh) - 1
        self.values = values
        self.totals = np.add.reduceat(values[:, order], self.first, axis=1, dtype=dtype)

    def owner(self, has: np.ndarray) -> np.ndarray:
        """Marks, per entry sent, the first of its key among the entries that ``has`` admits."""
        out = np.zeros(len(self.order), dtype=bool)
        has = has[self.order]
        rank = np.cumsum(has)
        start = rank[self.first] - has[self.first]
        out[self.order] = has & (rank - start[self.place[self.order]] == 1)
        return out

    def asked(self) -> np.ndarray:
        """Marks the entries that a block asked for, as opposed to index entries."""
        return np.repeat(np.asarray(self.blocks) != INDEX, np.diff(self.edge))


def merge_index(dtype, width: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Grouped map that turns a shard's messages into one index row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Shard(pdf, dtype, width)
        return as_frame(
            [(s.kind, s.shard, INDEX, pack_sorted(s.keys), pack(s.totals))],
            ["kind", "shard", "block", "keys", "body"],
        )

    return run


def sums(dtype, width: int, owners: bool = False) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Grouped map that answers every block with the totals of its keys.

    With ``owners``, whole totals are doubled and one more marks the first block that asked.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = Shard(pdf, dtype, width)
        own = s.owner(s.asked()) if owners else None
        rows = []
        for i, block in enumerate(s.blocks):
            if block != INDEX:
                part = slice(s.edge[i], s.edge[i + 1])
                totals = s.totals[:, s.place[part]]
                if owners:
                    totals = totals * dtype(2) + own[part].astype(dtype)
                rows.append((s.kind, s.shard, block, pack(np.ascontiguousarray(totals)), None))
        return as_frame(rows, ["kind", "shard", "block", "body", "stats"])

    return run


def by_shard(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    return rows.groupBy("kind", "shard").applyInPandas(run, schema)


def read_answers(pdf: pd.DataFrame, kind: int, dtype, width: int = 1) -> np.ndarray:
    """A block's answers of one kind in the order of its keys, one row per value."""
    mine = pdf[pdf["kind"] == kind].sort_values("shard")
    parts = [unpack(b, dtype).reshape(width, -1) for b in mine["body"]]
    return np.concatenate([*parts, np.zeros((width, 0), dtype=dtype)], axis=1)


def count_rows(df: DataFrame, column: str) -> int:
    return df.agg(F.sum(column)).first()[0] or 0
