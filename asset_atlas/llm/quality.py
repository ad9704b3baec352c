"""Quality classifier: a factorisation machine over hashed words, structure and size.

Every feature has a weight and a short vector; the pairwise term is the half difference of the
squared sum and the sum of squares, so a text costs time linear in its features. Fitting takes about
``SAMPLE`` labelled rows, chosen by the hash of the id, to the driver as features; scoring covers
every whole text in an Arrow map. The label, the language, the source and the id are no features.

Defined cases: null text counts as empty and still gets a score from its structure; no labelled row
gives score 0.5 to all; null labels are not learned; several labels of one id all count; repeated
rows score alike; other columns pass through, those with a leading underscore are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Chunk, carried, chunks, id_fold, mix, pack, prefix_hash, range_hash, unpack, words

WORD_BUCKETS = 1 << 16
BINS = 12
RANK = 8
SAMPLE = 6000
EPOCHS = 6
RATE, DECAY = 0.1, 1e-4
FOLDS, HELD_OUT = 3, 1

_U = np.uint64
_KINDS = np.zeros((5, 256), dtype=bool)
_KINDS[0, [ord(c) for c in "#*$%&|<>"]] = True
_KINDS[1, 65:91] = True
_KINDS[2, 48:58] = True
_KINDS[3, [ord(c) for c in "!?"]] = True
_KINDS[4, [ord(c) for c in ".,;:"]] = True
#: binned statistics, one block of buckets each, behind the words
STATISTICS = ["symbols", "capitals", "digits", "shouts", "stops", "word_length", "words", "distinct_words",
              "lines", "repeated_lines", "recorded_size"]
BUCKETS = WORD_BUCKETS + BINS * len(STATISTICS)


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[offsets])


def _distinct(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    fresh = np.ones(len(d), dtype=bool)
    fresh[1:] = (d[1:] != d[:-1]) | (x[1:] != x[:-1])
    return np.bincount(d[fresh], minlength=n_docs)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Bin of a ratio on a square-root scale; nothing of nothing is bin 0."""
    ratio = np.sqrt(np.minimum(part / np.maximum(whole, 1), 1.0))
    return np.ceil(ratio * (BINS - 1)).astype(np.int64)


def _size(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 0) + 1).astype(np.int64), BINS - 1)


def features(chunk: Chunk, recorded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of a chunk's texts, ordered by document; every text has some."""
    n = len(chunk.offsets) - 1
    w = words(chunk)
    n_words = np.bincount(w.doc, minlength=n)
    key = np.sort(w.doc * WORD_BUCKETS + (mix(w.hash) >> _U(48)).astype(np.int64))
    first = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    doc, bucket = key[first] // WORD_BUCKETS, key[first] % WORD_BUCKETS
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(doc, weights=value * value, minlength=n))
    value = value / np.maximum(norm[doc], 1e-12)

    size = np.diff(chunk.offsets)
    kinds = [_per_doc(k[chunk.data], chunk.offsets) for k in _KINDS]
    newline = np.flatnonzero(chunk.data == 10)
    start = np.sort(np.concatenate([chunk.offsets[:-1][size > 0], newline + 1]))
    start = start[start < len(chunk.data)]
    line_doc = np.searchsorted(chunk.offsets, start, side="right") - 1
    stop = np.append(start[1:], len(chunk.data))
    stop = np.minimum(stop, chunk.offsets[line_doc + 1]) if len(start) else stop
    n_lines = np.bincount(line_doc, minlength=n)
    fresh_lines = _distinct(line_doc, range_hash(prefix_hash(chunk.data), start, stop), n)
    bins = [
        *[_share(k, size) for k in kinds],
        np.minimum((size / np.maximum(n_words, 1)).astype(np.int64), BINS - 1),
        _size(n_words),
        _share(_distinct(w.doc, w.hash, n), n_words),
        _size(n_lines),
        _share(n_lines - fresh_lines, n_lines),
        np.where(recorded < 0, 0, np.maximum(_size(recorded), 1)),
    ]
    extra = np.stack([WORD_BUCKETS + i * BINS + b for i, b in enumerate(bins)], axis=1)
    docs = np.concatenate([doc, np.repeat(np.arange(n), len(bins))])
    order = np.argsort(docs, kind="stable")
    values = np.concatenate([value, np.full(extra.size, 1 / np.sqrt(len(bins)))])
    return docs[order], np.concatenate([bucket, extra.ravel()])[order], values[order]


class Model(NamedTuple):
    bias: float
    weights: np.ndarray
    vectors: np.ndarray


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> Model:
    """AdaGrad on the logistic loss over (label, buckets, values) rows."""
    rng = np.random.default_rng(11)
    w, v = np.zeros(BUCKETS), rng.normal(0, 0.02, (BUCKETS, RANK))
    bias, g_bias = 0.0, 1e-8
    g_w, g_v = np.full(BUCKETS, 1e-8), np.full((BUCKETS, RANK), 1e-8)
    for _ in range(epochs if rows else 0):
        for i in rng.permutation(len(rows)):
            y, b, x = rows[i]
            vb = v[b]
            total = x @ vb
            z = bias + x @ w[b] + 0.5 * float((total * total).sum() - ((x * x) @ (vb * vb)).sum())
            slope = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
            d_w = slope * x + DECAY * w[b]
            d_v = slope * (x[:, None] * total[None, :] - vb * (x * x)[:, None]) + DECAY * vb
            g_bias += slope * slope
            g_w[b] += d_w * d_w
            g_v[b] += d_v * d_v
            bias -= RATE * slope / np.sqrt(g_bias)
            w[b] -= RATE * d_w / np.sqrt(g_w[b])
            v[b] = vb - RATE * d_v / np.sqrt(g_v[b])
    return Model(float(bias), w.astype(np.float32), v.astype(np.float32))


def score_chunk(chunk: Chunk, recorded: np.ndarray, model: Model) -> np.ndarray:
    doc, b, x = features(chunk, recorded)
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    linear = np.add.reduceat(model.weights[b] * x, first)
    pair = np.zeros(len(first))
    for f in range(model.vectors.shape[1]):
        term = model.vectors[:, f][b] * x
        pair += np.add.reduceat(term, first) ** 2 - np.add.reduceat(term * term, first)
    z = model.bias + linear + 0.5 * pair
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _recorded(docs: DataFrame) -> F.Column:
    size = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return F.coalesce(size.cast("long"), F.lit(-1)).alias("_size")


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``_score``, the chance of a good label."""
    keep = carried(docs).columns if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("_size").to_numpy(zero_copy_only=False)
            parts = [score_chunk(c, size[c.first : c.last], model) for c in chunks(batch.column("_text"))]
            columns = [batch.column(i) for i in range(len(keep))]
            columns.append(pa.array(np.concatenate([*parts, np.zeros(0)]), pa.float64()))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_score"])

    source = docs.select(*keep, F.col(text).alias("_text"), _recorded(docs))
    return source.mapInArrow(run, docs.select(*keep).schema.add("_score", "double"))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
          sample: int = SAMPLE) -> Model:
    """Fit on about ``sample`` labelled rows outside the held-out fold."""
    known = labels.filter(F.col(label).isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("_h"))
    top = min(1.0, sample / max(known.count(), 1)) * 2.0**64 - 2.0**63
    # about ``sample`` ids by construction, so this side's size is a parameter
    some = F.broadcast(known.filter(F.col("_h").cast("double") <= top))
    rows = docs.select("doc_id", F.col(text).alias("_text"), _recorded(docs)).join(some, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, out = batch.column("_size").to_numpy(zero_copy_only=False), []
            for c in chunks(batch.column("_text"), limit=256 << 10):
                doc, b, x = features(c, size[c.first : c.last])
                edge = np.searchsorted(doc, np.arange(c.last - c.first + 1))
                for i in range(c.last - c.first):
                    part = slice(edge[i], edge[i + 1])
                    out.append((pack(b[part].astype(np.uint32)), pack(x[part].astype(np.float32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([o[0] for o in out], pa.binary()),
                 pa.array([o[1] for o in out], pa.binary()), batch.column("_h")],
                names=["label", "b", "x", "h"],
            )

    got = rows.select("label", "_text", "_size", "_h").mapInArrow(
        run, "label int, b binary, x binary, h bigint").collect()
    got.sort(key=lambda r: (r["h"], r["label"], r["b"]))
    return fit([(r["label"], unpack(r["b"], np.uint32).astype(np.int64), unpack(r["x"], np.float32).astype(float))
                for r in got])
