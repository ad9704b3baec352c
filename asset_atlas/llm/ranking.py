"""Ranked lexical search with per-term geometric blocks.

The index is a table of shards, each the whole index of some megabytes of documents, so no posting list
outgrows a task. In a shard every term has a posting list. A list that is long is clustered into blocks
of similar documents: members near the same centre, a document of the list, by the cosine of small
sketches of their weighted terms. A block stores the largest value of each coordinate over its
documents, rounded up: the most common terms have a coordinate each, the others share the rest.

A search takes an item's lists from the rarest term to the commonest. A document not seen in an earlier
list holds none of the earlier terms, so the summary of a block times the weights of the remaining terms
bounds every unseen document in it. The block is skipped only if that bound is below the tenth best
score found so far, and the search of a shard ends where the bound of all remaining lists is. Documents
of the other blocks are scored in full from the shard's forward rows. Shards report their best, and the
best of these are the answer.

Terms are told by a 64-bit hash of their bytes; all scores are exact integers.

Defined cases: null and empty texts and items have no terms; a null id sorts before all others among
equal scores; repeated rows of either table count one by one; an item without hits gives no rows; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .rows import Chunk, chunks, mix, pack, unpack, words

BEST = 10
#: the length norm of a document: FLAT, and BY_LENGTH for a document of average length
FLAT, BY_LENGTH = 100 - 75, 75
#: a shard ends at either bound
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 14
#: documents a block aims at; shorter lists are one block without a summary
BLOCK_DOCS = 64
SKETCH = 32
#: coordinates of their own for the commonest terms of a shard, and coordinates the others share
OWN, SHARED = 512, 128
#: summaries are in units of this, rounded up; an impact is below a million, so they fit a byte
UNIT = 4096
#: items searched in one pass over the index
ITEM_BLOCK = 5000
NO_ID = -(1 << 63)

_U = np.uint64
_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

FIELDS = (
    ("terms", _U), ("listed", np.uint32), ("most", np.uint32), ("postings", np.uint32), ("blocks", np.uint32),
    ("block_sizes", np.uint32), ("block_most", np.uint8), ("summaries", np.uint8), ("doc_terms", np.uint32),
    ("doc_impacts", np.uint32), ("doc_sizes", np.uint32),
)
SHARD = "shard bigint, n_docs bigint, docs array<bigint>, " + ", ".join(f"{n} binary" for n, _ in FIELDS)


class Index(NamedTuple):
    """Shards, the number of documents with a term and the number of their terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def _terms(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of the distinct terms of each text, ordered by document."""
    w = words(chunk, inside=_INSIDE)
    order = np.lexsort((w.hash, w.doc))
    doc, term = w.doc[order], w.hash[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    first = np.flatnonzero(fresh)
    return doc[first], term[first], np.diff(first, append=len(doc))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n_docs = n_terms = 0
    for batch in batches:
        for c in chunks(batch.column("_text")):
            inside = _INSIDE[c.data]
            opens = inside.copy()
            fresh = np.zeros(len(c.data) + 1, dtype=bool)
            fresh[c.offsets] = True
            opens[1:] &= ~inside[:-1] | fresh[1 : len(c.data)]
            before = np.concatenate([[0], np.cumsum(opens)])
            sizes = np.diff(before[c.offsets])
            n_docs += int((sizes > 0).sum())
            n_terms += int(sizes.sum())
    yield pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], names=["n", "l"])


def _cosine_groups(sketch: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Nearest centre of each member; centres are every so-manieth member."""
    centres = members[:: BLOCK_DOCS]
    return (sketch[members] @ sketch[centres].T).argmax(axis=1)


def shard_arrays(sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """Forward rows, lists, blocks and summaries of one shard.

    ``sizes`` counts the distinct terms of each document, ``term`` and ``tf`` follow document by document.
    """
    docs = len(sizes)
    doc = np.repeat(np.arange(docs), sizes)
    length = np.bincount(doc, weights=tf, minlength=docs).astype(np.int64)
    m = FLAT + (BY_LENGTH * length * n_docs) // max(n_terms, 1)
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    known, at = np.unique(term, return_inverse=True)
    df = np.bincount(at, minlength=len(known))
    # coordinate 0 is the commonest term
    order = np.argsort(-df, kind="stable")
    rank = np.empty(len(known), dtype=np.int64)
    rank[order] = np.arange(len(known))
    at = rank[at]
    df = df[order]
    most = np.zeros(len(known), dtype=np.int64)
    np.maximum.at(most, at, impact)
    by_list = np.argsort(at, kind="stable")
    postings = doc[by_list]
    edge = np.concatenate([[0], np.cumsum(df)])
    column = np.where(at < OWN, at, OWN + at % SHARED)
    wide = np.zeros((docs, OWN + SHARED), dtype=np.uint8)
    np.maximum.at(wide, (doc, column), (-(-impact // UNIT)).astype(np.uint8))
    del by_list, column
    rare = np.log((1 + docs) / df)[at] * impact
    slot = (mix(known[order][at]) % _U(SKETCH)).astype(np.int64)
    sign = np.where((mix(known[order][at] + _U(1)) & _U(1)) == 0, 1.0, -1.0)
    sketch = np.bincount(doc * SKETCH + slot, weights=rare * sign, minlength=docs * SKETCH).reshape(docs, SKETCH)
    del rare, slot, sign, doc
    sketch = (sketch / np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    blocks = np.zeros(len(known), dtype=np.int64)
    block_sizes, block_most, summaries = [], [], []
    for r in range(int((df > BLOCK_DOCS).sum())):
        part = slice(edge[r], edge[r + 1])
        members = postings[part]
        group = _cosine_groups(sketch, members)
        turn = np.argsort(group, kind="stable")
        members = members[turn]
        postings[part] = members
        first = np.flatnonzero(np.diff(group[turn], prepend=-1))
        blocks[r] = len(first)
        block_sizes.append(np.diff(first, append=len(members)))
        block_most.append(np.maximum.reduceat(wide[members, r if r < OWN else OWN + r % SHARED], first))
        summaries.append(np.maximum.reduceat(wide[members, : r if r <= OWN else OWN + SHARED], first, axis=0).ravel())
    none = [np.zeros(0, dtype=np.int64)]
    return {
        "terms": known[order], "listed": df, "most": most, "postings": postings, "blocks": blocks[blocks > 0],
        "block_sizes": np.concatenate(block_sizes or none), "block_most": np.concatenate(block_most or none),
        "summaries": np.concatenate(summaries or none), "doc_terms": at, "doc_impacts": impact, "doc_sizes": sizes,
    }


def _shards(n_docs: int, n_terms: int, shard_bytes: int):
    names = ["shard", "n_docs", "docs", *[n for n, _ in FIELDS]]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * len(FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, number, held, size, rows = TaskContext.get().partitionId() << 32, 0, [], 0, 0

        def emit() -> pa.RecordBatch:
            ids, sizes, term, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            got = shard_arrays(sizes, term, tf, n_docs, n_terms)
            row = [base + number, len(ids), ids.tolist(), *[pack(got[n].astype(t)) for n, t in FIELDS]]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            ids = batch.column("_doc").to_numpy()
            for c in chunks(batch.column("_text")):
                doc, term, tf = _terms(c)
                held.append((ids[c.first : c.last], np.bincount(doc, minlength=c.last - c.first), term, tf))
                size, rows = size + len(c.data), rows + c.last - c.first
                if size >= shard_bytes or rows >= SHARD_DOCS:
                    yield emit()
                    number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield emit()

    return run


def build_index(docs: DataFrame, text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index all documents; the shards are written to the shared folder."""
    source = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_doc"), F.col(text).alias("_text"))
    totals = source.select("_text").mapInArrow(_totals, "n bigint, l bigint").agg(F.sum("n").alias("n"), F.sum("l").alias("l"))
    n_docs, n_terms = (x or 0 for x in totals.first())
    shards = stored(source.mapInArrow(_shards(n_docs, n_terms, shard_bytes), SHARD), "ranking-shards")
    return Index(shards, n_docs, n_terms)


class Shard:
    """One shard opened for searches."""

    def __init__(self, row: dict):
        for name, kind in FIELDS:
            if name in row:
                setattr(self, name, unpack(row[name], kind))
        self.docs = np.asarray(row["docs"], dtype=np.int64)
        self.order = np.argsort(self.terms, kind="stable")
        self.ranked = self.terms[self.order]
        self.edge = np.concatenate([[0], np.cumsum(self.listed, dtype=np.int64)])
        self.doc_edge = np.concatenate([[0], np.cumsum(self.doc_sizes, dtype=np.int64)])
        self.block_edge = np.concatenate([[0], np.cumsum(self.blocks, dtype=np.int64)])
        widths = np.arange(len(self.blocks))
        widths[widths > OWN] = OWN + SHARED
        self.summary_edge = np.concatenate([[0], np.cumsum(self.blocks * widths, dtype=np.int64)])
        self.widths = widths
        self.weight = np.zeros(len(self.terms), dtype=np.int64)
        self.scored = self.skipped = 0

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Coordinate of each term, -1 where the shard has none."""
        place = np.minimum(np.searchsorted(self.ranked, terms), max(len(self.ranked) - 1, 0))
        if not len(self.ranked):
            return np.full(len(terms), -1)
        return np.where(self.ranked[place] == terms, self.order[place], -1)

    def score(self, docs: np.ndarray) -> np.ndarray:
        """Full scores of documents under the weights set."""
        size = self.doc_sizes[docs].astype(np.int64)
        end = np.cumsum(size)
        at = np.repeat(self.doc_edge[docs] - (end - size), size) + np.arange(end[-1])
        value = self.weight[self.doc_terms[at]] * self.doc_impacts[at]
        return np.add.reduceat(value, end - size)

    def worth_reading(self, r: int, weight: int, later: np.ndarray, weights: np.ndarray, least: int) -> np.ndarray:
        """Documents of the blocks of list ``r`` whose summary bound reaches ``least``."""
        members = self.postings[self.edge[r] : self.edge[r + 1]]
        if r >= len(self.blocks):
            return members
        part = slice(self.block_edge[r], self.block_edge[r + 1])
        table = self.summaries[self.summary_edge[r] : self.summary_edge[r + 1]].reshape(self.blocks[r], self.widths[r])
        column = np.where(later < OWN, later, OWN + later % SHARED)
        bound = (self.block_most[part] * np.int64(weight) + table[:, column].astype(np.int64) @ weights) * UNIT
        reads = bound >= least
        self.skipped += int((~reads).sum())
        return members[np.repeat(reads, self.block_sizes[part])]

    def best(self, at: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, score) of the ``k`` best documents for terms at coordinates ``at``, ties by id."""
        # from the rarest list on; coordinates fall with rarity
        turn = np.argsort(-at, kind="stable")
        at, weights = at[turn], weights[turn]
        most = weights * self.most[at]
        rest = np.cumsum(most[::-1])[::-1]
        self.weight[at] = weights
        found, score = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        seen = np.zeros(len(self.docs), dtype=bool)
        least = 1
        for j in range(len(at)):
            if rest[j] < least:
                break
            docs = self.worth_reading(int(at[j]), int(weights[j]), at[j + 1 :], weights[j + 1 :], least)
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            self.scored += len(docs)
            value = self.score(docs)
            good = value >= least
            found, score = np.concatenate([found, docs[good]]), np.concatenate([score, value[good]])
            if len(found) > k:
                keep = np.lexsort((self.docs[found], -score))[:k]
                found, score = found[keep], score[keep]
            if len(found) == k:
                least = int(score.min())
        self.weight[at] = 0
        return found, score


def item_terms(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(row, key, terms, times) of each item with a term; ``row`` numbers the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            terms, times, rows = [], [], []
            for c in chunks(batch.column("_text")):
                doc, term, tf = _terms(c)
                edge = np.searchsorted(doc, np.arange(c.last - c.first + 1))
                for a, b in zip(edge, edge[1:], strict=False):
                    terms.append(term[a:b].view(np.int64).tolist())
                    times.append(tf[a:b].tolist())
                    rows.append(base + n)
                    n += 1
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int64()), batch.column(0), pa.array(terms, kind), pa.array(times, kind)],
                names=["row", "key", "terms", "times"])

    source = items.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"row bigint, key {kind}, terms array<bigint>, times array<bigint>").filter(F.size("terms") > 0)


def _frequencies(index: Index, terms: np.ndarray) -> np.ndarray:
    """Documents that hold each of the ascending terms, over all shards."""
    shipped = index.shards.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shipped.value), dtype=np.int64)
        for batch in batches:
            for a, b in zip(batch.column("terms"), batch.column("listed"), strict=True):
                known, df = unpack(a.as_py(), _U), unpack(b.as_py(), np.uint32)
                place = np.minimum(np.searchsorted(shipped.value, known), len(total) - 1)
                hit = shipped.value[place] == known
                total[place[hit]] += df[hit]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["at", "df"])

    out = np.zeros(len(terms), dtype=np.int64)
    for r in index.shards.select("terms", "listed").mapInArrow(run, "at bigint, df bigint").groupBy("at").agg(
            F.sum("df").alias("df")).collect():
        out[r["at"]] = r["df"]
    return out


def _search_block(index: Index, rows: list, kind: str, k: int) -> DataFrame:
    terms = [np.array(r["terms"], dtype=np.int64).view(_U) for r in rows]
    distinct = np.unique(np.concatenate(terms))
    df = _frequencies(index, distinct)
    weight = np.array([math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
    queries = []
    for r, t in zip(rows, terms, strict=True):
        at = np.searchsorted(distinct, t)
        queries.append((r["row"], r["key"], at, weight[at] * np.array(r["times"], dtype=np.int64)))
    shipped = index.shards.sparkSession.sparkContext.broadcast((distinct, queries))
    key_type = pa.schema([("key", {"string": pa.string(), "int": pa.int32()}.get(kind, pa.int64()))]).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, queries = shipped.value
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                place = shard.find(distinct)
                out = []
                for number, key, at, weights in queries:
                    here = place[at]
                    held = here >= 0
                    if held.any():
                        found, score = shard.best(here[held], weights[held], k)
                        out += [(number, key, int(shard.docs[f]), int(s)) for f, s in zip(found, score, strict=True)]
                columns = list(zip(*out, strict=True)) or [(), (), (), ()]
                kinds = [pa.int64(), key_type, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["row", "key", "doc", "score"])

    # one shard at a time in a task's memory
    found = index.shards.mapInArrow(run, f"row bigint, key {kind}, doc bigint, score bigint")
    turn = Window.partitionBy("row").orderBy(F.col("score").desc(), "doc")
    return found.withColumn("rank", F.row_number().over(turn)).filter(F.col("rank") <= k)


def search(index: Index, items: DataFrame, text: str = "text", key: str = "item_id", k: int = BEST,
           item_block: int = ITEM_BLOCK) -> DataFrame:
    """(``key``, rank, doc_id, score) of each item's ``k`` best documents."""
    asked = stored(item_terms(items, text, key), "ranking-items")
    kind = asked.schema["key"].dataType.simpleString()
    if kind not in ("string", "int", "bigint"):
        raise TypeError(f"items are named by a string or a whole number, not {kind}")
    spark = items.sparkSession
    out = spark.createDataFrame([], f"row bigint, key {kind}, doc bigint, score bigint, rank int")
    blocks = max(1, -(-asked.count() // item_block))
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).collect()
        if rows:
            out = out.unionByName(_search_block(index, rows, kind, k))
    doc = F.when(F.col("doc") != NO_ID, F.col("doc"))
    return out.select(F.col("key").alias(key), "rank", doc.alias("doc_id"), "score")
