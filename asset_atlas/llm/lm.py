"""LM scoring: Katz backoff over Good-Turing discounted counts with exact backoff weights.

The corpus is tokenised once into a table of blocks. A block numbers its words locally, so later
passes work on integers. Counts of all orders, and the sums behind the backoff weights, are exchanged
between blocks and hash shards (see ``exchange``); both are stored as tables partitioned by order,
sliced by block. Scoring then runs block by block and evaluates every token by the recursion

    P(w | c) = d_r r / C(c)          if the n-gram was seen r times in training,
               alpha(c) P(w | c')    otherwise, c' being c without its first word,

down to single words and one class for all unseen words. d_r is Katz's Good-Turing discount for
r <= K and 1 above. alpha(c) shares exactly the mass the seen words leave among all others: every
distinct n-gram is summed once, by the block that owns it. A context that leaves no mass counts one
more event, which is the mass of its unseen words.

Defined cases: null and empty texts are the end token alone; null ids train as empty ids; repeated
rows are scored and counted one by one; without training text every word is the unseen class, score
and base score 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import exchange
from .rows import chunks, id_fold, mix, pack, pack_sorted, unpack, unpack_sorted, words

ORDER = 2
KATZ_K = 5
FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS = 1_500_000

_U = np.uint64
END = mix(np.array([0xE0D], dtype=_U))[0]
BEGIN = mix(np.arange(0xB000, 0xB020, dtype=_U))
BLOCK = "block bigint, docs array<bigint>, held array<boolean>, sizes array<int>, n bigint, words binary, ids binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokenise a partition into blocks of about ``BLOCK_TOKENS`` tokens."""
    base, number = TaskContext.get().partitionId() << 32, 0
    docs, held, sizes, hashes, n = [], [], [], [], 0

    def emit() -> pa.RecordBatch:
        vocabulary, ids = np.unique(np.concatenate(hashes), return_inverse=True)
        row = {
            "block": base + number, "docs": pa.concat_arrays(docs).to_pylist(), "held": pa.concat_arrays(held).to_pylist(),
            "sizes": np.concatenate(sizes).tolist(), "n": n, "words": pack_sorted(vocabulary),
            "ids": pack(ids.astype(np.uint32)),
        }
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row.values(), kinds, strict=True)], names=list(row))

    for batch in batches:
        for c in chunks(batch.column("_text")):
            w = words(c)
            rows = c.last - c.first
            tokens = np.full(len(w.hash) + rows, END, dtype=_U)
            tokens[np.arange(len(w.hash)) + w.doc] = w.hash
            docs.append(batch.column("doc_id").slice(c.first, rows))
            held.append(batch.column("_held").slice(c.first, rows))
            sizes.append((np.bincount(w.doc, minlength=rows) + 1).astype(np.int32))
            hashes.append(tokens)
            n += len(tokens)
            if n >= BLOCK_TOKENS:
                yield emit()
                number += 1
                docs, held, sizes, hashes, n = [], [], [], [], 0
    if n:
        yield emit()


class Level(NamedTuple):
    """n-grams of one order in a block: distinct keys, each token's place among them, its context."""

    keys: np.ndarray
    place: np.ndarray
    context: np.ndarray


class Block:
    """One row of the block table, unpacked."""

    def __init__(self, row: pd.Series, order: int):
        self.block, self.docs = int(row["block"]), row["docs"]
        self.sizes = np.asarray(row["sizes"], dtype=np.int64)
        self.held = np.asarray(row["held"], dtype=bool)
        vocabulary = unpack_sorted(row["words"])
        ids = unpack(row["ids"], np.uint32).astype(np.int32)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)
        self.levels = [Level(vocabulary, ids, np.zeros(0, _U))]
        gram = vocabulary[ids]
        word = gram
        for m in range(2, order + 1):
            context = np.empty_like(gram)
            context[1:] = gram[:-1]
            context[self.first] = BEGIN[m]
            gram = mix(context * _U(0x9E3779B97F4A7C15) + word)
            keys, place = np.unique(gram, return_inverse=True)
            self.levels.append(Level(keys, place.astype(np.int32), context))


def _ask_counts(order: int, shards: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for _, row in pdf.iterrows():
                b = Block(row, order)
                for m, level in enumerate(b.levels, 1):
                    hits = np.bincount(level.place[b.training], minlength=len(level.keys)).astype(np.uint64)
                    rows = exchange.messages(m, b.block, level.keys, hits[:, None], shards)
                    yield exchange.as_frame(list(rows), ["kind", "shard", "block", "keys", "body"])

    return run


def _count(k: int):
    """Totals times two plus the owner's mark for every block; one row of statistics per shard."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        s = exchange.Shard(pdf, np.uint64, 1)
        total, own = s.totals[0], s.owner(s.values[0] > 0)
        rows = []
        for i, block in enumerate(s.blocks):
            part = slice(s.edge[i], s.edge[i + 1])
            rows.append((s.kind, s.shard, block, pack(total[s.place[part]] * _U(2) + own[part].astype(_U)), None))
        few = np.bincount(total[total <= k + 1].astype(np.int64), minlength=k + 2)[1:]
        stats = [int((total > 0).sum()), int(total.sum()), *few.tolist()]
        rows.append((s.kind, s.shard, exchange.INDEX, b"", stats))
        return exchange.as_frame(rows, ["kind", "shard", "block", "body", "stats"])

    return run


class Order(NamedTuple):
    """Training statistics of one order: types, tokens and the discount of each small count."""

    types: int
    tokens: int
    few: list[int]
    discount: np.ndarray


def discounts(few: list[int]) -> np.ndarray:
    """Factor d_r for r = 1 .. K from n_1 .. n_(K+1); index 0 is unused.

    Katz's formula is used with the largest k for which all its factors lie in (0, 1); where none
    does, an absolute discount n_1 / (n_1 + 2 n_2), or one half, is taken off each count.
    """
    top = len(few) - 1
    out = np.ones(top + 1)
    for k in range(top, 0, -1):
        if few[0] == 0 or any(x == 0 for x in few[: k + 1]):
            continue
        tail = (k + 1) * few[k] / few[0]
        if tail >= 1:
            continue
        d = [((r + 1) * few[r] / (r * few[r - 1]) - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            out[1 : k + 1] = d
            return out
    step = few[0] / (few[0] + 2 * few[1]) if top and few[0] and few[1] else 0.5
    for r in range(1, top + 1):
        out[r] = (r - step) / r
    return out


def _discounted(r: np.ndarray, o: Order) -> np.ndarray:
    """d_r r of counts."""
    small = np.minimum(r, len(o.discount) - 1).astype(np.int64)
    return np.where(r < len(o.discount), o.discount[small], 1.0) * r


def _single(r: np.ndarray, o: Order) -> np.ndarray:
    """Probability of words by training count, 0 standing for the class of unseen words."""
    if not o.tokens:
        return np.ones(len(r))
    taken = sum(n * (c - c * o.discount[c]) for c, n in enumerate(o.few[: len(o.discount) - 1], 1))
    extra = 0.0 if taken > 1e-9 * o.tokens else 1.0
    whole = o.tokens + extra
    return np.where(r > 0, _discounted(r, o), taken + extra) / whole


class Evaluator:
    """Probabilities of a block's tokens, order by order."""

    def __init__(self, block: Block, answers: pd.DataFrame, orders: list[Order]):
        self.block, self.orders, self.answers = block, orders, answers
        raw = [exchange.read_answers(answers, m, np.uint64)[0] for m in range(1, len(orders) + 1)]
        self.totals = [(x >> _U(1)).astype(np.float64) for x in raw]
        self.owned = [(x & _U(1)).astype(bool) for x in raw]
        end = np.searchsorted(block.levels[0].keys, END)
        self.texts = self.totals[0][end] if len(block.sizes) else 0.0

    def context_count(self, m: int) -> np.ndarray:
        """Training count of each token's context of order ``m``."""
        lower = self.block.levels[m - 2]
        out = np.empty(len(lower.place))
        out[1:] = self.totals[m - 2][lower.place[:-1]]
        out[self.block.first] = self.texts
        return out

    def contexts(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.block.levels[m - 1].context, return_inverse=True)

    def probabilities(self, m: int) -> np.ndarray:
        level, r = self.block.levels[m - 1], self.totals[m - 1]
        if m == 1:
            return _single(r, self.orders[0])[level.place]
        below = self.probabilities(m - 1)
        count = self.context_count(m)
        _, place = self.contexts(m)
        disc, low = exchange.read_answers(self.answers, -m, np.float64, 2)[:, place]
        left = count - disc
        full = left <= 1e-9 * count
        whole = count + full
        left = np.where(full, 1.0, left)
        seen = r[level.place]
        alpha = left / np.maximum(whole, 1.0) / np.maximum(1.0 - low, 1e-300)
        p = np.where(seen > 0, _discounted(seen, self.orders[m - 1]) / np.maximum(whole, 1.0), alpha * below)
        return np.where(count > 0, p, below)

    def sums(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of order ``m`` and, over the n-grams owned here, sums of d_r r and P(w | c')."""
        level = self.block.levels[m - 1]
        keys, place = self.contexts(m)
        token = np.zeros(len(level.keys), dtype=np.int64)
        token[level.place] = np.arange(len(level.place))
        token = token[self.owned[m - 1]]
        disc = _discounted(self.totals[m - 1][self.owned[m - 1]], self.orders[m - 1])
        low = self.probabilities(m - 1)[token]
        at = place[token]
        pair = [np.bincount(at, weights=x, minlength=len(keys)) for x in (disc, low)]
        return keys, np.stack(pair, axis=1)


def _ask_sums(m: int, orders: list[Order], shards: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in left.iterrows():
            b = Block(row, m)
            keys, values = Evaluator(b, right, orders[:m]).sums(m)
            rows += exchange.messages(-m, b.block, keys, values, shards)
        return exchange.as_frame(rows, ["kind", "shard", "block", "keys", "body"])

    return run


def _score(orders: list[Order]):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in left.iterrows():
            b = Block(row, len(orders))
            e = Evaluator(b, right, orders)
            count = e.totals[0][b.levels[0].place]
            n, v = orders[0].tokens, orders[0].types
            base = np.log10((count + 1) / (n + v + 1))
            score = np.log10(e.probabilities(len(orders)))
            out.append(pd.DataFrame({
                "doc_id": pd.array(list(b.docs), dtype="Int64"), "held_out": b.held, "n_tokens": b.sizes,
                "n_known": np.add.reduceat((count > 0).astype(np.int64), b.first), "train_tokens": n,
                "base_score": np.add.reduceat(base, b.first), "score": np.add.reduceat(score, b.first),
            }))
        return pd.concat(out) if out else pd.DataFrame(
            columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _orders(counts: DataFrame, order: int, k: int) -> list[Order]:
    rows = counts.filter(F.col("block") == exchange.INDEX).select("kind", F.posexplode("stats").alias("i", "x"))
    got = {(r["kind"], r["i"]): r["x"] for r in rows.groupBy("kind", "i").agg(F.sum("x").alias("x")).collect()}
    out = []
    for m in range(1, order + 1):
        few = [got.get((m, 2 + i), 0) for i in range(k + 1)]
        out.append(Order(got.get((m, 0), 0), got.get((m, 1), 0), few, discounts(few)))
    return out


def score_texts(docs: DataFrame, text: str = "text", order: int = ORDER, k: int = KATZ_K) -> DataFrame:
    """Train on the rows outside the held-out fold, score all: one row per document."""
    source = docs.select(
        "doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("_held"), F.col(text).alias("_text"))
    blocks = stored(source.mapInArrow(_blocks, BLOCK), "lm-blocks")
    shards = exchange.shard_count(exchange.count_rows(blocks, "n"))
    asked = blocks.mapInPandas(_ask_counts(order, shards), exchange.MESSAGE)
    answers = stored(exchange.by_shard(asked, _count(k), exchange.ANSWER), "lm-counts", "kind")
    orders = _orders(answers, order, k)
    tables = answers.filter(F.col("block") != exchange.INDEX)
    for m in range(2, order + 1):
        asked = blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(
            _ask_sums(m, orders, shards), exchange.MESSAGE)
        sums = stored(exchange.by_shard(asked, exchange.sums(np.float64, 2), exchange.ANSWER), "lm-backoff", "kind")
        tables = tables.unionByName(sums)
    fields = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double")
    return blocks.groupBy("block").cogroup(tables.groupBy("block")).applyInPandas(_score(orders), fields)
