"""MinHash near-dedup with ProbMinHash signatures, banding and verification.

Each distinct shingle of five words is a Poisson process of rate one, however often it stands in the
text; its arrivals fall on registers at random and a register keeps its earliest arrival. A text's
processes stop once their next arrival lies behind all its registers. Two texts agree in a register
with a chance equal to the set Jaccard of their shingles, the measure of a link, and 32 bands of four
registers miss a pair at 0.8 with a chance under 1e-7.

Texts of the same words are one node from the start. In a band's bucket, members are first held
against its two leaders, the most central node and the one of the smallest id, so a bucket of K copies costs
2 K candidates; buckets whose members then share a class are done. Of the pairs left between
different classes those are formed whose rarest and own shingles allow a link. Every candidate whose
numbers of shingles allow a link is verified on its texts. A link is a set Jaccard of 0.8 or more;
classes are the connected components of the links.

Defined cases: null and empty texts have no shingle and stay alone; texts of one to four words are
one shingle of all their words; rows with the same id and text count as one document; a null id is
the smallest; a class is named by its smallest id; an empty table gives an empty result; other
columns pass through ``keep_one``, those with a leading underscore are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import discard, stored
from . import exchange
from .rows import Chunk, carried, chunks, mix, pack, shingles, unpack, whole_text, words

SHINGLE = 5
SHINGLE_BLOCK = "block bigint, nodes array<bigint>, n bigint, doc binary, hash binary"
SIMILARITY = 0.8
#: open texts that hold a rare shingle at most
FEW = 32
REGISTERS = 128
BANDS = 32

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def distinct_shingles(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of a chunk, ordered by document then shingle."""
    doc, h = shingles(words(chunk), SHINGLE)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    fresh = np.ones(len(doc), dtype=bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[fresh], h[fresh]


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n_docs: int,
               registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers of each text: the shingle whose arrival came first, 0 where none is."""
    best = np.full(n_docs * registers, np.inf)
    who = np.zeros(n_docs * registers, dtype=_U)
    live = np.arange(len(h))
    time = np.zeros(len(h))
    step = 0
    while len(live):
        step += 1
        draw = mix(h[live] + _U(int(_GOLD) * 2 * step & _MASK))
        time = time - np.log((draw >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / weight[live]
        slot = doc[live] * registers + (mix(draw ^ _GOLD) >> _U(32)).astype(np.int64) % registers
        better = np.flatnonzero(time < best[slot])
        # latest first, so that the earliest arrival of a register is the one that stays
        better = better[np.argsort(-time[better], kind="stable")]
        best[slot[better]] = time[better]
        who[slot[better]] = h[live[better]]
        limit = best.reshape(n_docs, registers).max(axis=1)
        stay = time < limit[doc[live]]
        live, time = live[stay], time[stay]
    return who.reshape(n_docs, registers)


def band_keys(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band of a signature."""
    rows = registers.shape[1] // bands
    parts = registers.reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _GOLD, parts.shape[:2]).copy()
    for r in range(rows):
        key = mix(key * _U(3) + parts[:, :, r])
    return key


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word-sequence hashes, number of shingles and band keys of each text; null where it has no word."""
    for batch in batches:
        for chunk in chunks(batch.column("_text")):
            n = chunk.last - chunk.first
            w = words(chunk)
            doc, h = distinct_shingles(chunk)
            # one weight for all: a link is a set Jaccard, so repeats inside a text must not count
            who = signatures(doc, h, np.ones(len(h)), n)
            size = np.bincount(w.doc, minlength=n)
            place = np.arange(len(w.doc)) - (np.cumsum(size) - size)[w.doc]
            exact = []
            for salt in (1, 2):
                term = mix(w.hash + _GOLD * (place.astype(_U) * _U(4) + _U(salt)))
                total = np.zeros(len(term) + 1, dtype=_U)
                np.cumsum(term, out=total[1:])
                edge = np.concatenate([[0], np.cumsum(size)])
                exact.append(mix(total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            none = size == 0
            keys = band_keys(who).view(np.int64)
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * keys.shape[1])
            bands = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel(), pa.int64()), mask=pa.array(none))
            piece = batch.slice(chunk.first, n)
            yield pa.RecordBatch.from_arrays(
                [piece.column("_doc"), piece.column("_sum"), pa.array(exact[0], mask=none),
                 pa.array(exact[1], mask=none), pa.array(np.bincount(doc, minlength=n), pa.int64()), bands],
                names=["_doc", "_sum", "s1", "s2", "size", "bands"],
            )


def _row_key(text: str) -> list[Column]:
    """Names a row: its id, null as the smallest, and the hash of its text."""
    return [F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(whole_text(text)).alias("_sum")]


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    source = docs.select(*_row_key(text), F.col(text).alias("_text"))
    fields = "_doc bigint, _sum bigint, s1 bigint, s2 bigint, size bigint, bands array<bigint>"
    return source.mapInArrow(_describe, fields)


def _jaccards(left: pa.Array, right: pa.Array) -> np.ndarray:
    """Set Jaccard of the shingles of two columns of texts, row by row."""

    def sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        docs, hs = [], []
        for c in chunks(column):
            doc, h = distinct_shingles(c)
            docs.append(doc + c.first)
            hs.append(h)
        return np.concatenate([*docs, np.zeros(0, int)]), np.concatenate([*hs, np.zeros(0, _U)])

    (d1, h1), (d2, h2) = sets(left), sets(right)
    n = len(left)
    doc, h = np.concatenate([d1, d2]), np.concatenate([h1, h2])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    twice = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    both = np.bincount(doc[1:][twice], minlength=n)
    return both / np.maximum(np.bincount(doc, minlength=n) - both, 1)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = 256
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            s = _jaccards(part.column("text_u"), part.column("text_v"))
            yield pa.RecordBatch.from_arrays(
                [part.column("u"), part.column("v"), pa.array(s, pa.float64())], names=["u", "v", "similarity"]
            )


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The (u, v) pairs of nodes whose shingles reach ``least``.

    A Jaccard is at most the smaller number of shingles over the larger, so pairs below that are left out.
    """
    side = {
        x: nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("_doc").alias(f"doc_{x}"),
                        F.col("_sum").alias(f"sum_{x}"))
        for x in "uv"
    }
    near = pairs.join(side["u"], "u").join(side["v"], "v").filter(
        F.least("size_u", "size_v") / F.greatest("size_u", "size_v") >= least
    ).drop("size_u", "size_v")
    for x in "uv":
        near = near.join(
            texts.select(F.col("_doc").alias(f"doc_{x}"), F.col("_sum").alias(f"sum_{x}"),
                         F.col("_text").alias(f"text_{x}")),
            [f"doc_{x}", f"sum_{x}"],
        )
    checked = near.select("u", "v", "text_u", "text_v").mapInArrow(_verify, "u bigint, v bigint, similarity double")
    return checked.filter(F.col("similarity") >= least).select("u", "v").distinct()


def _leader_pairs(members: DataFrame) -> DataFrame:
    """Each member with its bucket's leaders: the most central node and the one of the smallest id.

    A node is central if many others share its buckets, as the source of a group of copies does.
    """
    weight = members.groupBy("node").agg(F.sum("n").alias("weight"))
    known = members.join(weight, "node")
    heads = known.groupBy("key").agg(
        F.max(F.struct("weight", "node")).alias("a"), F.min(F.struct("_doc", "node")).alias("b"))
    heads = heads.select("key", F.explode(F.array_distinct(F.array("a.node", "b.node"))).alias("v"))
    both = members.select("key", F.col("node").alias("u")).join(heads, "key").filter("u <> v")
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _shingle_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct shingles of each text, a chunk of texts per row."""
    base, number = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for c in chunks(batch.column("_text")):
            doc, h = distinct_shingles(c)
            row = [base + number, batch.column("node").slice(c.first, c.last - c.first).to_pylist(), len(h),
                   pack(np.diff(doc, prepend=0).astype(np.uint32)), pack(h)]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in SHINGLE_BLOCK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)
            number += 1


def _ask_shingles(shards: int):
    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for row in pdf.itertuples():
                keys, counts = np.unique(unpack(row.hash, _U), return_counts=True)
                rows = exchange.messages(1, row.block, keys, counts.astype(np.uint32)[:, None], shards)
                yield exchange.as_frame(list(rows), ["kind", "shard", "block", "keys", "body"])

    return run


def _rare(least: float):
    """Per node of a block: its shingles, how many of them one text or few have, and its rarest ones.

    Two texts at the similarity share one of the rarest 1 - ``least`` of either's shingles.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            doc = np.cumsum(unpack(row.doc, np.uint32).astype(np.int64))
            h = unpack(row.hash, _U)
            _, at = np.unique(h, return_inverse=True)
            held = exchange.read_answers(right, 1, np.uint32)[0][at]
            order = np.lexsort((h, held, doc))
            doc, h, held = doc[order], h[order], held[order]
            for d in range(len(row.nodes)):
                a, b = np.searchsorted(doc, [d, d + 1])
                n = int(b - a)
                top = slice(a, a + n - int(np.ceil(least * n - 1e-9)) + 1)
                out.append((int(row.nodes[d]), n, int((held[a:b] == 1).sum()), int((held[a:b] <= FEW).sum()),
                            h[top].view(np.int64).tolist(), held[top].astype(np.int64).tolist()))
        return pd.DataFrame(out, columns=["node", "size", "own", "few", "rare", "held"])

    return run


def rare_shingles(texts: DataFrame, least: float) -> DataFrame:
    """(node, size, own, few, rare, held) of (node, _text) rows, see ``_rare``."""
    blocks = stored(texts.select("node", "_text").mapInArrow(_shingle_blocks, SHINGLE_BLOCK), "near-shingles")
    shards = exchange.shard_count(exchange.count_rows(blocks, "n"))
    asked = blocks.mapInPandas(_ask_shingles(shards), exchange.MESSAGE)
    answers = exchange.by_shard(asked, exchange.sums(np.uint32, 1), exchange.ANSWER)
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(
        _rare(least), "node bigint, size bigint, own bigint, few bigint, rare array<bigint>, held array<bigint>")
    found = stored(found, "near-rare")
    discard(blocks)
    return found


def _other_pairs(nodes: DataFrame, members: DataFrame, label: DataFrame, tested: DataFrame, texts: DataFrame,
                 least: float) -> DataFrame:
    """Pairs of texts in open buckets, of different classes and not tested yet, that could be links.

    Open are buckets of several classes. Two texts at ``least`` share one of their rarest shingles.
    If that is one of few texts, the pair is bounded by its shingles no other open text has, else by
    all its shingles of few texts. The rules are exact, and leave out texts around one common
    passage and copies edited in different places.
    """
    classed = members.join(label, "node", "left").select("node", "key", F.coalesce("component", "node").alias("class"))
    open_keys = (
        classed.groupBy("key").agg(F.min("class").alias("a"), F.max("class").alias("b")).filter("a <> b").select("key")
    )
    open_ = stored(classed.join(open_keys, "key", "left_semi").select("node", "class").distinct(), "near-open")
    named = nodes.join(open_, "node").select("node", "class", "_doc", "_sum")
    once = texts.join(named.select("_doc", "_sum"), ["_doc", "_sum"], "left_semi").dropDuplicates(["_doc", "_sum"])
    rare = rare_shingles(named.select("node", "_doc", "_sum").join(once, ["_doc", "_sum"]), least)
    able = open_.join(rare, "node").filter(F.col("size") - F.col("own") >= least * F.col("size"))
    rows = able.select("node", "class", "size", "own", "few", F.explode(F.arrays_zip("rare", "held")).alias("x"))
    rows = stored(rows.select("node", "class", "size", "own", "few", F.col("x.rare").alias("key"), F.col("x.held").alias("held")),
                  "near-keys")
    # a pair that meets at a common shingle only shares no rare one: all of these rank before it
    pairs = _crossing(rows.filter(F.col("held").between(2, FEW)), "own", least).unionByName(
        _crossing(rows.filter(F.col("held") > FEW), "few", least))
    return pairs.distinct().join(tested, ["u", "v"], "left_anti")


def _crossing(rows: DataFrame, lost: str, least: float) -> DataFrame:
    """Pairs at a key of different classes whose sizes less ``lost`` allow a link.

    Keys held by the same texts lead to the same pairs, so one of them is used. Every pair has a
    side outside the key's largest class, so only those rows meet all others.
    """
    marks = [F.count("*"), F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64(F.lit(1), "node"))]
    holders = rows.groupBy("key").agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)])
    one = holders.groupBy("m0", "m1", "m2").agg(F.min("key").alias("key")).select("key")
    rows = rows.join(one, "key", "left_semi")
    main = rows.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "class")).alias("main"), F.count("*").alias("classes")).filter("classes > 1")
    known = rows.join(main.select("key", F.col("main.class").alias("main")), "key")
    left = known.filter("class <> main").select("key", "node", "class", "size", F.col(lost).alias("lost"))
    right = known.select(F.col("key").alias("key_v"), *[F.col(c).alias(f"{c}_v") for c in ("node", "class", "size")],
                         F.col(lost).alias("lost_v"))
    shared = F.least(F.col("size") - F.col("lost"), F.col("size_v") - F.col("lost_v"))
    fits = (F.col("class") != F.col("class_v")) & (shared >= least * (F.col("size") + F.col("size_v") - shared))
    pairs = left.join(right, (F.col("key") == F.col("key_v")) & fits)
    return pairs.select(F.least("node", "node_v").alias("u"), F.greatest("node", "node_v").alias("v"))


def classes(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(_doc, _sum, class_id, class_rows, is_head): one row per row of ``docs``.

    ``class_id`` is the smallest id of the class; ``is_head`` marks the one document of a class to
    keep, the smallest (id, text hash).
    """
    rows = stored(describe(docs, text), "near-rows")
    alone = rows.filter("s1 is null").select(
        "_doc", "_sum", F.col("_doc").alias("class_id"), F.lit(1).cast("long").alias("class_rows"),
        F.lit(True).alias("is_head"))
    # the first row of the same words stands for all; its place in the table numbers it
    first = F.min(F.struct("_doc", "_sum"))
    heads = rows.filter("s1 is not null").groupBy("s1", "s2").agg(
        first.alias("h"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = stored(
        heads.select(F.monotonically_increasing_id().alias("node"), "s1", "s2", "h.*", "size", "bands"), "near-nodes")
    buckets = nodes.select("node", "_doc", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(buckets.join(shared, "key"), "near-members")
    texts = docs.select(*_row_key(text), F.col(text).alias("_text"))

    def checked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        named = nodes.join(wanted, "node", "left_semi").select("_doc", "_sum")
        # several rows may be the same document, one is enough to verify
        some = texts.join(named, ["_doc", "_sum"], "left_semi").dropDuplicates(["_doc", "_sum"])
        return stored(verified(pairs, nodes, some, least), "near-links")

    tested = stored(_leader_pairs(members), "near-pairs")
    links = checked(tested)
    label = stored(connected_components(links), "near-classes")
    rest = stored(_other_pairs(nodes, members, label, tested, texts, least), "near-pairs")
    if not rest.isEmpty():
        more = checked(rest)
        if not more.isEmpty():
            # classes found so far stand for their links
            stars = label.filter("node <> component").select(F.col("component").alias("u"), F.col("node").alias("v"))
            label = stored(connected_components(stars.unionByName(more)), "near-classes")
    discard(members)
    placed = nodes.join(label, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("class"))
    named = stored(rows.filter("s1 is not null").select("_doc", "_sum", "s1", "s2").join(placed, ["s1", "s2"]), "near-named")
    sums = named.groupBy("class").agg(first.alias("head"), F.count("*").alias("class_rows"))
    out = named.join(sums, "class").select(
        "_doc", "_sum", F.col("head._doc").alias("class_id"), "class_rows",
        ((F.col("_doc") == F.col("head._doc")) & (F.col("_sum") == F.col("head._sum"))).alias("is_head"),
    )
    return out.unionByName(alone)


def keep_one(docs: DataFrame, text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class left."""
    docs = carried(docs)
    doc, total = _row_key(text)
    heads = classes(docs, text, least).filter("is_head").select("_doc", "_sum").distinct()
    kept = docs.withColumns({"_doc": doc, "_sum": total}).join(heads, ["_doc", "_sum"], "left_semi")
    return kept.dropDuplicates(["_doc", "_sum"]).select(*docs.columns)
