"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

The model is fitted on a bounded sample: about ``PER_CLASS`` labelled rows of each language, chosen
by the hash of the id, come to the driver as n-gram counts; over ``MOST_LANGUAGES`` are refused. Fitting is follow-the-regularised-leader
with an L1 and an L2 penalty per row; a fifth of the sample is held back to set the temperature.
Scoring reads every whole text inside an Arrow map, a few array passes for a batch of documents.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text when
no labelled row exists; a null id draws like an empty one; repeated rows score alike; ties go to the
language first in order; other columns pass through, those with a leading underscore are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import Chunk, carried, chunks, id_fold, mix, pack, unpack

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_CLASS = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: texts scored at a time; their grams take some thirty bytes for each byte of text
SCORE_BYTES = 256 << 10
#: more languages than this are refused, as the sample on the driver grows with them
MOST_LANGUAGES = 500

_U = np.uint64


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Is each code point a letter, and its lower case where that is one code point below U+3000."""
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x3000):
        small = chr(i).lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return letter, lower


def code_points(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the chunk's texts and where each text starts among them."""
    points = np.frombuffer(chunk.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    lead = np.zeros(len(chunk.data) + 1, dtype=np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=lead[1:])
    if lead[-1] == len(points):
        return points, lead[chunk.offsets]
    texts = [
        np.frombuffer(chunk.data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        for a, b in zip(chunk.offsets, chunk.offsets[1:], strict=False)
    ]
    return np.concatenate([*texts, points[:0]]), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


class Grams(NamedTuple):
    """Distinct n-gram buckets of each text in a chunk, with counts, ordered by text."""

    doc: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    has_letter: np.ndarray


def grams(chunk: Chunk, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS) -> Grams:
    letter, lower = _alphabet()
    points, starts = code_points(chunk)
    n_docs = len(starts) - 1
    sizes = np.diff(starts)
    doc = np.repeat(np.arange(n_docs, dtype=np.int64), sizes)
    has_letter = np.bincount(doc[letter[points]], minlength=n_docs) > 0
    low = lower[points].astype(_U)
    keys = []
    h = np.zeros(len(low), dtype=_U)
    for n in range(1, max(orders) + 1):
        keep = len(low) - n + 1
        if keep <= 0:
            break
        h = h[:keep] * _U(0x9E3779B97F4A7C15) + (low[n - 1 :] + _U(1)) * _U(0xD6E8FEB86659FD93)
        if n in orders:
            same = doc[:keep] == doc[n - 1 :]
            at = (mix(h[same]) >> _U(64 - (buckets.bit_length() - 1))).astype(np.int64)
            keys.append(doc[:keep][same] * buckets + at)
    key = np.sort(np.concatenate([*keys, np.zeros(0, dtype=np.int64)]))
    first = np.flatnonzero(np.concatenate([key[:1] == key[:1], key[1:] != key[:-1]]))
    count = np.diff(first, append=len(key))
    return Grams(key[first] // buckets, key[first] % buckets, count, has_letter)


class Model(NamedTuple):
    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], buckets: int = BUCKETS, epochs: int = EPOCHS) -> Model:
    """Fit on (label, distinct buckets, counts) rows."""
    labels = sorted({r[0] for r in rows})
    c = len(labels)
    if not c:
        return Model([], np.zeros(buckets, np.float32), np.zeros((buckets, 0)), np.zeros(0), 1.0)
    seen = np.zeros(buckets)
    for _, b, _n in rows:
        seen[b] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    data = []
    for label, b, n in rows:
        x = np.log1p(n) * idf[b]
        # narrow numbers: the whole sample is on the driver here
        data.append((labels.index(label), b.astype(np.int32), (x / max(np.sqrt((x * x).sum()), 1e-12)).astype(np.float32)))
    turn = np.random.default_rng(7).permutation(len(data))
    kept = max(1, len(data) * 4 // 5)
    train, hold = turn[:kept], turn[kept:]
    # the last row of each table is the bias, which carries no penalty
    z, n2 = np.zeros((buckets + 1, c)), np.zeros((buckets + 1, c))
    l1 = np.full(buckets + 1, L1)
    l1[-1] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        shrink = np.sign(zz) * np.maximum(np.abs(zz) - l1[at][:, None], 0)
        return -shrink / ((BETA + np.sqrt(n2[at])) / ALPHA + L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(train):
            y, b, x = data[i]
            at, v = np.append(b, buckets), np.append(x, 1.0)
            w = weights(at)
            p = _softmax(v @ w)
            p[y] -= 1
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA
            z[at] += g - sigma * w
            n2[at] += g * g
    final = weights(np.arange(buckets + 1))
    logits = [(data[i][0], data[i][2] @ final[data[i][1]] + final[-1]) for i in (hold if len(hold) else train)]

    def loss(t: float) -> float:
        return -sum(np.log(max(_softmax(s / t)[y], 1e-300)) for y, s in logits)

    grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
    return Model(labels, idf.astype(np.float32), final[:-1].astype(np.float32), final[-1], float(min(grid, key=loss)))


def score_chunk(chunk: Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(label index or -1, probability) of each text of a chunk."""
    g = grams(chunk, len(model.idf))
    n_docs = len(g.has_letter)
    best, prob = np.full(n_docs, -1), np.zeros(n_docs)
    if len(model.labels) and len(g.doc):
        x = (np.log1p(g.count) * model.idf[g.bucket]).astype(np.float32)
        first = np.flatnonzero(np.concatenate([[True], g.doc[1:] != g.doc[:-1]]))
        who = g.doc[first]
        norm = np.sqrt(np.add.reduceat(x * x, first))
        # one language at a time: no table of all grams by all languages
        z = np.stack([np.add.reduceat(x * model.weights[g.bucket, k], first) for k in range(len(model.labels))], axis=1)
        z = z.astype(np.float64) / norm[:, None]
        p = _softmax((z + model.bias) / model.temperature)
        best[who], prob[who] = p.argmax(axis=1), p.max(axis=1)
    best[~g.has_letter], prob[~g.has_letter] = -1, 0.0
    return best, prob


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``_lang`` and ``_score``."""
    keep = carried(docs).columns if keep is None else keep
    names = np.array([*model.labels, UNKNOWN], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score_chunk(ch, model) for ch in chunks(batch.column("_text"), SCORE_BYTES)]
            best = np.concatenate([p[0] for p in parts] or [np.zeros(0, int)])
            prob = np.concatenate([p[1] for p in parts] or [np.zeros(0)])
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array(names[best], pa.string()), pa.array(prob, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "_lang", "_score"])

    source = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).schema.add("_lang", "string").add("_score", "double")
    return source.mapInArrow(run, schema)


def train(docs: DataFrame, label: str = "lang", text: str = "text", per_class: int = PER_CLASS) -> Model:
    """Fit on about ``per_class`` rows of each language outside the held-out fold."""
    rows = docs.filter(F.col(label).isNotNull() & (id_fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("_text"), F.xxhash64("doc_id").alias("_h"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"{len(counts)} languages; the sample is bounded for {MOST_LANGUAGES}")
    # a row is taken when its hash falls in its language's share of the hash range
    cut = F.lit(False)
    for name, n in sorted(counts.items()):
        top = min(1.0, per_class / n) * 2.0**64 - 2.0**63
        cut = F.when(F.col("label") == name, F.col("_h").cast("double") <= top).otherwise(cut)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ch in chunks(batch.column("_text"), limit=256 << 10):
                g = grams(ch)
                edge = np.searchsorted(g.doc, np.arange(len(g.has_letter) + 1))
                for i in range(len(g.has_letter)):
                    part = slice(edge[i], edge[i + 1])
                    out.append((pack(g.bucket[part].astype(np.uint16)), pack(g.count[part].astype(np.uint32))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([o[0] for o in out], pa.binary()),
                 pa.array([o[1] for o in out], pa.binary()), batch.column("_h")],
                names=["label", "b", "n", "h"],
            )

    got = rows.filter(cut).mapInArrow(run, "label string, b binary, n binary, h bigint").collect()
    got.sort(key=lambda r: (r["h"], r["label"], r["b"], r["n"]))
    return fit([(r["label"], unpack(r["b"], np.uint16), unpack(r["n"], np.uint32)) for r in got])
