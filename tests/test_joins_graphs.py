"""Similarity joins and graph rounds against brute force on small random inputs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from asset_atlas.operators import clusters as K
from asset_atlas.operators.graph import connected_components, greedy_star, medoid
from asset_atlas.operators.detail import near_duplicates
from asset_atlas.operators.match import exact_bucket, near_bucket
from asset_atlas.operators.semantic import semantic_bucket
from asset_atlas.operators.simjoin import (
    band_cost,
    band_plan,
    band_sides,
    best_bands,
    connecting_pairs,
    delta_e_pairs,
    hamming_join,
    hamming_links,
    hamming_query_join,
    hamming_self_join,
    jaccard_join,
    split_hot,
    tile_sides,
)
from asset_atlas.session import cut


def near_bits(rng, n, flips):
    """Random fingerprints in families, so that short distances occur."""
    base = [rng.getrandbits(64) for _ in range(max(1, n // 6))]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for p in rng.sample(range(64), rng.randint(0, flips)):
            x ^= 1 << p
        out.add(x - (1 << 64) if x >> 63 else x)
    return sorted(out)


def dist(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("d,bands", [(0, None), (1, None), (8, None), (12, None), (12, 3), (20, None), (20, 5)])
def test_hamming_self_join_is_exact(spark, d, bands):
    rng = random.Random(d)
    bits = near_bits(rng, 120, d + 3)
    df = spark.createDataFrame([(b % 2, b) for b in bits], "g bigint, bits bigint")
    got = hamming_self_join(df, d, ["g"], bands).collect()
    want = {
        (a, b): dist(a, b)
        for a in bits for b in bits
        if a < b and a % 2 == b % 2 and dist(a, b) <= d
    }
    assert len(got) == len(want)
    assert {(r["bits_a"], r["bits_b"]): r["hamming"] for r in got} == want


def test_hamming_query_join_is_exact(spark):
    rng = random.Random(5)
    bits = near_bits(rng, 150, 20)
    q, c = bits[:30], bits
    left = spark.createDataFrame([(1, b) for b in q], "g bigint, bits bigint")
    right = spark.createDataFrame([(1, b) for b in c], "g bigint, bits bigint")
    got = hamming_query_join(left, right, 20, ["g"]).collect()
    want = {(a, b) for a in q for b in c if dist(a, b) <= 20}
    assert len(got) == len(want) and {(r["bits_a"], r["bits_b"]) for r in got} == want


def test_band_radii_add_up():
    for d in range(25):
        for rows in (100, 100_000, 10**9):
            plan = band_plan(d, best_bands(d, rows))
            assert sum(r + 1 for _, r, _ in plan) >= d + 1
            masks = [m & ((1 << 64) - 1) for m, _, _ in plan]
            assert sum(masks) == (1 << 64) - 1


def test_larger_blocks_take_wider_bands():
    assert best_bands(20, 1000) > best_bands(20, 1_000_000)
    assert band_cost(20, best_bands(20, 1_000_000))[1] < 0.25


def test_candidates_of_a_large_block_are_a_quarter(spark):
    rng = random.Random(11)
    bits = [b - (1 << 63) for b in {rng.getrandbits(64) for _ in range(400)}]
    df = spark.createDataFrame([(1, b) for b in bits], "g bigint, bits bigint")
    left, right = band_sides(df.limit(40), df, band_plan(20, best_bands(20, 1_000_000)), ["g"])
    met = left.join(right, ["g", "band", "key"]).count()
    assert met < 0.25 * 40 * len(bits)


def test_hot_band_keys_are_split(spark):
    rng = random.Random(12)
    # all fingerprints agree on the bits of three bands
    bits = sorted({sum(rng.getrandbits(1) << p for p in range(0, 64, 4)) for _ in range(150)})
    df = spark.createDataFrame([(1, b) for b in bits], "g bigint, bits bigint")
    got = hamming_self_join(df, 6, ["g"], 4, hot=20).collect()
    want = {(a, b) for a in bits for b in bits if a < b and dist(a, b) <= 6}
    assert len(got) == len(want) and {(r["bits_a"], r["bits_b"]) for r in got} == want
    left, right = band_sides(df, df, band_plan(6, 4), ["g"])
    _, dealt = split_hot(left, right, ["g", "band", "key"], "bits_b", 20)
    assert dealt.groupBy("g", "band", "key", "part").count().agg(F.max("count")).first()[0] <= 45


def test_expanded_keys_are_not_broadcast(spark):
    df = spark.createDataFrame([(1, b) for b in near_bits(random.Random(13), 60, 9)], "g bigint, bits bigint")
    plan = hamming_join(df, df, 22, ["g"], 6)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_near_lists_broadcast_no_side_that_grows_with_the_assets(spark):
    bits = near_bits(random.Random(15), 40, 6)
    rows = [(1, i, "png", f"{b & ((1 << 64) - 1):016x}", f"h{i % 9}") for i, b in enumerate(bits)]
    assets = spark.createDataFrame(rows, "source_id bigint, asset_id bigint, ext string, phash string, content_hash string")
    # such a table is small enough to be broadcast by its size in files
    assets = cut(assets)
    queries = assets.withColumnRenamed("asset_id", "query_id")
    taken = exact_bucket(queries, assets)
    for found in (
        taken,
        near_bucket(queries, assets, taken, ceiling=18, k=2, bands=4, radii=[4, 18]),
        near_duplicates(assets, assets, raster=18, k=2, bands=4, radii=[4, 18]),
    ):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert found.count() > 0


def test_tiles_hold_each_pair_once(spark):
    bits = near_bits(random.Random(14), 130, 30)
    df = spark.createDataFrame([(b % 2, b) for b in bits], "g bigint, bits bigint")
    left, right = tile_sides(df.limit(70), df, ["g"], tile=20)
    met = left.join(right, ["g", "i", "j"])
    asked = df.limit(70).collect()
    assert met.count() == met.select("bits_a", "bits_b").distinct().count() == sum(
        a["g"] == b % 2 for a in asked for b in bits)
    assert met.groupBy("g", "i", "j").count().agg(F.max("count")).first()[0] <= 900


@pytest.mark.parametrize("seed", [1, 2])
def test_growing_radius_gives_the_closest(spark, seed):
    rng = random.Random(seed)
    bits = near_bits(rng, 200, 14)
    fmt = lambda b: f"{b & ((1 << 64) - 1):016x}"
    rows = [(1, i, "png", fmt(rng.choice(bits))) for i in range(300)]
    assets = spark.createDataFrame(rows, "source_id bigint, asset_id bigint, ext string, phash string")
    queries = assets.filter("asset_id % 7 = 0").withColumnRenamed("asset_id", "query_id")
    taken = queries.select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(40).cast("long"))).alias("asset_id"))
    once = near_bucket(queries, assets, taken, ceiling=18, k=6, radii=[18])
    grown = near_bucket(queries, assets, taken, ceiling=18, k=6, radii=[4, 8, 18])
    key = lambda df: sorted(map(tuple, df.select("query_id", "rank", "asset_id", "hamming").collect()))
    assert key(once) == key(grown)
    want = []
    for _, q, _, p in rows[::7]:
        hits = sorted((bin(int(p, 16) ^ int(x, 16)).count("1"), i) for _, i, _, x in rows if i > 40)
        want += [(q, r + 1, i, h) for r, (h, i) in enumerate([x for x in hits if x[0] <= 18][:6])]
    assert key(grown) == sorted(want)
    near = [key(near_duplicates(assets, assets, raster=18, k=6, radii=r).withColumnRenamed("subject_id", "query_id"))
            for r in ([18], [4, 8, 18])]
    assert near[0] == near[1]


def test_jaccard_join_is_exact(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    sets = {tuple(sorted(set(rng.choices(words, k=rng.randint(1, 5))))) for _ in range(80)}
    df = spark.createDataFrame([(list(s),) for s in sets], "tokens array<string>")
    for t in (0.2, 0.33, 0.5, 1.0):
        got = {
            (tuple(r["tokens_a"]), tuple(r["tokens_b"]))
            for r in jaccard_join(df, df, t).collect()
        }
        want = {
            (a, b) for a in sets for b in sets
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= t - 1e-12
        }
        assert got == want


def test_jaccard_join_with_a_split_hot_token(spark, monkeypatch):
    from asset_atlas.operators import simjoin

    monkeypatch.setattr(simjoin, "HOT_TOKEN_ROWS", 5)
    df = spark.createDataFrame([(["hot", f"t{i % 7}", f"u{i}"],) for i in range(40)], "tokens array<string>")
    df = df.select(F.sort_array("tokens").alias("tokens"))
    rows = jaccard_join(df, df, 0.5).collect()
    keys = [(tuple(r["tokens_a"]), tuple(r["tokens_b"])) for r in rows]
    assert len(keys) == len(set(keys)) == sum(
        1 for i in range(40) for j in range(40) if i == j or i % 7 == j % 7
    )


def test_delta_e_pairs_miss_nothing(spark):
    rng = random.Random(1)
    colors = sorted({"#%06x" % rng.randrange(1 << 24) for _ in range(60)} | {f"#{v:02x}{v:02x}{v:02x}" for v in range(0, 256, 9)})
    df = spark.createDataFrame([(1, c) for c in colors], "source_id bigint, color string")
    got = {(r["color_a"], r["color_b"]) for r in delta_e_pairs(df, ["source_id"]).collect()}
    from asset_atlas.functions.color import ciede2000

    pairs = df.select(F.col("color").alias("a")).join(df.select(F.col("color").alias("b")), F.col("a") < F.col("b"))
    want = {(r["a"], r["b"]) for r in pairs.withColumn("d", ciede2000("a", "b")).filter("d < 6").collect()}
    assert got == want and want


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    touched = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {n: find(n) for n in touched}


def greedy(nodes, edges):
    """Sequential reference: nodes in rank order claim what is still free."""
    claimed, out = {}, {}
    for n in nodes:
        if n in claimed:
            continue
        for m in nodes:
            if (n, m) in edges and m not in claimed and m not in out:
                claimed[m] = n
        out[n] = n
    return claimed


def test_greedy_star_keeps_an_anchor_that_loses_its_edges(spark):
    # ranks X 1, B 2, A 3, D 4, C 5: A is freed in the round in which D claims C
    edges = {(1, 2), (2, 3), (3, 5), (4, 5)}
    df = spark.createDataFrame([(1, a, b) for a, b in edges], "source_id bigint, hi bigint, lo bigint")
    df = df.withColumn("hi_rank", F.struct(F.col("hi").alias("r")))
    got = {r["variant"]: r["anchor"] for r in greedy_star(df, ["source_id"]).collect()}
    assert got == {2: 1, 5: 3} == greedy([1, 2, 3, 4, 5], edges)


@pytest.mark.parametrize("seed,size,density", [(1, 30, 0.12), (2, 30, 0.12), (3, 220, 0.01), (4, 220, 0.03), (5, 220, 0.15)])
def test_greedy_star(spark, seed, size, density):
    rng = random.Random(seed)
    nodes = list(range(size))
    edges = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < density}
    df = spark.createDataFrame([(1, a, b) for a, b in edges], "source_id bigint, hi bigint, lo bigint")
    df = df.withColumn("hi_rank", F.struct(F.col("hi").alias("r")))
    got = {r["variant"]: r["anchor"] for r in greedy_star(df, ["source_id"]).collect()}
    assert got == greedy(nodes, edges)


def test_medoid_matches_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for c in range(12):
        for i, b in enumerate(near_bits(rng, rng.randint(1, 9), 9)):
            rows.append((c, c * 100 + i, b, rng.randint(1, 3)))
    df = spark.createDataFrame(rows, "c bigint, node bigint, bits bigint, n bigint")
    for r in medoid(df, ["c"]).collect():
        own = [x for x in rows if x[0] == r["c"]]
        score = {x[1]: sum(y[3] * dist(x[2], y[2]) for y in own) for x in own}
        assert r["medoid"] == min(score, key=lambda k: (score[k], k))
        assert r["medoid_score"] == min(score.values()) and r["size"] == sum(x[3] for x in own)


def color_rows(spark, *pairs):
    return spark.createDataFrame([(1, c, n) for c, n in pairs], "source_id bigint, value string, n bigint")


def test_color_cluster_cases(spark):
    got = K.color_clusters(color_rows(spark, ("#402678", 100), ("#3f2678", 3), ("#ff0000", 40))).collect()
    assert {(r["value"], r["role"]) for r in got} == {("#402678", "canonical"), ("#3f2678", "variant")}
    assert got[0]["max_distance"] == pytest.approx(0.2068, abs=1e-3)
    star = K.color_clusters(color_rows(spark, ("#808080", 100), ("#909090", 50), ("#a0a0a0", 10))).collect()
    assert {r["value"] for r in star} == {"#808080", "#909090"}
    assert all(r["neutral"] and r["size"] == 2 for r in star)
    assert K.color_clusters(color_rows(spark, ("#808080", 5), ("#a0a0a0", 5))).count() == 0


def type_rows(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "source_id bigint, axis string, value string, n bigint")


def test_size_cluster_cases(spark):
    got = K.size_clusters(type_rows(spark, ("size", "13", 100), ("size", "13.5", 3))).collect()
    assert {(r["key"], r["value"], r["distance"]) for r in got} == {("size:13", "13", None), ("size:13", "13.5", 0.5)}
    assert K.size_clusters(type_rows(spark, ("size", "13", 100), ("size", "14", 3))).count() == 0
    assert K.size_clusters(type_rows(spark, ("size", "13", 50), ("size", "13.5", 50))).count() == 0
    assert K.typography_clusters(type_rows(spark, ("weight", "400", 9), ("weight", "401", 1))).count() == 0


def test_family_cluster_case(spark):
    rows = type_rows(
        spark, ("family", "inter, sans-serif", 100), ("family", "inter, arial, sans-serif", 3), ("family", "roboto", 9)
    )
    got = K.family_clusters(rows).collect()
    assert {(r["key"], r["value"], r["role"]) for r in got} == {
        ("family:inter", "inter, sans-serif", "canonical"),
        ("family:inter", "inter, arial, sans-serif", "variant"),
    }


def vectors(spark, scores, status=None):
    """Assets whose cosine with (1, 0) is exactly known."""
    rows = [
        (1, i, [float(s), float(np.sqrt(max(0.0, 1 - s * s)))], (status or {}).get(i))
        for i, s in enumerate(scores)
    ]
    return spark.createDataFrame(
        rows, "source_id bigint, asset_id bigint, embedding array<double>, embed_status string"
    )


def ask(spark, n=1):
    return spark.createDataFrame(
        [(1, q, [1.0, 0.0]) for q in range(n)], "source_id bigint, query_id bigint, embedding array<double>"
    )


def test_vectors_of_mixed_length(spark):
    rows = [(1, 0, [1.0, 0.0, 5.0], None), (1, 1, [3.0, 4.0], None), (1, 2, [0.0, 0.0], None), (1, 3, [], None)]
    assets = spark.createDataFrame(rows, "source_id bigint, asset_id bigint, embedding array<double>, embed_status string")
    got = {r["asset_id"]: r["score"] for r in semantic_bucket(ask(spark), assets, floor=-1.0).collect()}
    assert got == {0: pytest.approx(1.0), 1: pytest.approx(0.6), 2: 0.0, 3: 0.0}


def test_semantic_gate(spark, monkeypatch):
    from asset_atlas.operators import semantic

    monkeypatch.setattr(semantic, "PART_ROWS", 30)
    spread = [0.68 + 0.072 * i / 99 for i in range(100)]
    got = semantic_bucket(ask(spark, 2), vectors(spark, [*spread, 0.96])).collect()
    assert {(r["query_id"], r["asset_id"]) for r in got} == {(0, 100), (1, 100)}
    assert all(r["percentile"] == 99 for r in got)


def test_semantic_small_and_flat_sets(spark):
    few = semantic_bucket(ask(spark), vectors(spark, [0.81, 0.79, 0.9])).collect()
    assert {r["asset_id"] for r in few} == {0, 2} and few[0]["gate"] == 0.8
    flat = semantic_bucket(ask(spark), vectors(spark, [0.9] * 20)).collect()
    assert [r["rank"] for r in sorted(flat, key=lambda r: r["rank"])] == list(range(1, 11))
    assert all(r["gate"] == pytest.approx(0.9) and r["percentile"] == 0 for r in flat)
    skipped = semantic_bucket(ask(spark), vectors(spark, [0.9, 0.95], {1: "degenerate"})).collect()
    assert [r["asset_id"] for r in skipped] == [0]


def test_histograms_are_one_row_a_query_and_part():
    from asset_atlas.operators import semantic

    rng = np.random.default_rng(5)
    rows, ids = list(rng.normal(size=(50, 3))), np.array([*range(48), 7, 7])
    asked = [{"query_id": q, "embedding": rows[q], "excluded": e} for q, e in ((3, [7, 99]), (4, []), (5, [5, 7]))]
    [(queries, bins, counts)] = semantic._histogram(asked, ids, semantic.Vectors(rows))
    assert queries == [3, 4, 5] and [int(n.sum()) for n in counts] == [47, 50, 46]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    for r, held, n in zip(asked, bins, counts, strict=True):
        scores = np.clip(unit @ unit[r["query_id"]], -1, 1)[~np.isin(ids, r["excluded"])]
        want = np.bincount(semantic._bin_of(scores), minlength=semantic.BINS)
        assert np.abs(np.repeat(held, n) - np.repeat(np.arange(semantic.BINS), want)).max() <= 1


def test_semantic_batches_and_parts_do_not_change_results(spark, monkeypatch):
    from asset_atlas.operators import semantic

    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(90, 4))
    assets = spark.createDataFrame(
        [(1, i, v.tolist(), None) for i, v in enumerate(vecs)],
        "source_id bigint, asset_id bigint, embedding array<double>, embed_status string",
    )
    queries = assets.withColumnRenamed("asset_id", "query_id")
    excluded = queries.selectExpr("query_id", "explode(array(query_id, (query_id + 1) % 90)) as asset_id")
    for name, value in (("PART_ROWS", 40), ("SLOT_ROWS", 50), ("BATCH_QUERIES", 7)):
        monkeypatch.setattr(semantic, name, value)
    got = {q: [] for q in range(90)}
    for r in semantic_bucket(queries, assets, excluded, floor=-1.0, k=90).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["asset_id"], pytest.approx(r["gate"])))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for q in range(90):
        others = [i for i in range(90) if i not in (q, (q + 1) % 90)]
        scores = unit[others] @ unit[q]
        gate = np.median(scores) + 3 * np.median(np.abs(scores - np.median(scores)))
        assert got[q] == [(i, gate) for s, i in sorted(zip(-scores, others, strict=True)) if -s >= gate]


def test_semantic_writes_no_row_a_query_and_part(spark, monkeypatch):
    from asset_atlas.operators import semantic

    rng = np.random.default_rng(9)
    assets = spark.createDataFrame(
        [(1 + i % 2, i, v.tolist(), None) for i, v in enumerate(rng.normal(size=(120, 16)))],
        "source_id bigint, asset_id bigint, embedding array<double>, embed_status string",
    )
    counts = []

    def counted(df):
        counts.append(cut(df))
        counts[-1].n = counts[-1].count()
        return counts[-1]

    monkeypatch.setattr(semantic, "cut", counted)
    monkeypatch.setattr(semantic, "PART_ROWS", 10)
    monkeypatch.setattr(semantic, "SLOT_ROWS", 25)
    got = semantic_bucket(assets.withColumnRenamed("asset_id", "query_id"), assets, floor=-1.0, k=1).collect()
    assert len(got) > 100 and all(r["query_id"] == r["asset_id"] for r in got)
    # each query meets six parts of its source, and no table holds a row for each of them
    assert max(df.n for df in counts) <= 120


def test_copies_of_a_vector_have_one_score():
    from asset_atlas.operators import semantic

    rng = np.random.default_rng(11)
    for width in (16, 64, 100):
        for n in (1, 37, 514, 1999):
            rows = list(np.repeat(rng.normal(size=(1, width)), n, 0))
            for tile in (1, 5, 31, 64):
                asked = list(np.repeat(rng.normal(size=(1, width)), tile, 0))
                assert len(np.unique(semantic.Vectors(rows).scores(asked, n))) == 1


def test_semantic_slots_settle_batches_of_any_size(monkeypatch):
    from asset_atlas.operators import semantic

    rng = np.random.default_rng(10)
    vecs = rng.normal(size=(70, 5)).round(1)
    vecs[20:30] = vecs[19]
    ids = np.array([*range(60), *range(10)])
    asked = np.array([4, 9, 4, 7, 30, 31, 32, 33, 34, 20])
    taken = [np.array(x, np.int64) for x in ([1, 4], [9], [1, 4], [], [30], [31, 99], [], [5], [2, 3], list(range(70)))]
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)

    def parts():
        return ((ids[i : i + 16], semantic.Vectors(vecs[i : i + 16])) for i in range(0, 70, 16))

    for tile, queries, values in ((3, 1000, 1 << 21), (4, 2, 1 << 21), (32, 1000, 10)):
        monkeypatch.setattr(semantic, "TILE", tile)
        monkeypatch.setattr(semantic, "BATCH_QUERIES", queries)
        monkeypatch.setattr(semantic, "BATCH_VALUES", values)
        slot = semantic.Slot(asked, vecs[asked], taken)
        for p in parts():
            slot.count(*p)
        got = {}
        for q, found, scores, share, gate, rank in slot.settled(parts, 12, -0.5):
            for row in zip(q.tolist(), found.tolist(), scores.tolist(), share.tolist(), gate.tolist(), rank.tolist(), strict=True):
                got.setdefault(row[0], []).append(row[1:])
        want = {}
        for q in {*asked.tolist()} - {20}:
            rows = [unit @ unit[q] for r in asked if r == q]
            mine = ~np.isin(ids, taken[asked.tolist().index(q)])
            scores, own = np.concatenate([r[mine] for r in rows]), np.concatenate([ids[mine] for _ in rows])
            gate = max(np.median(scores) + 3 * np.median(np.abs(scores - np.median(scores))), -0.5)
            hits = sorted((-round(s, 9), i, s) for s, i in zip(scores.tolist(), own.tolist(), strict=True) if s >= gate - 1e-12)
            want[q] = [(i, pytest.approx(s), pytest.approx(int(np.floor((scores < s - 1e-9).sum() / len(scores) * 100 + 0.5)), abs=1),
                        pytest.approx(gate), n) for n, (_, i, s) in enumerate(hits[:12], 1)]
        # vectors that are alike may come in either order of their last digits
        assert {q: [r[1:] for r in v] for q, v in got.items()} == {q: [r[1:] for r in v] for q, v in want.items() if v}


def test_semantic_gate_is_the_exact_statistic(spark):
    rng = np.random.default_rng(3)
    scores = rng.normal(0.5, 0.12, 401).clip(-1, 1)
    for n in (401, 400):
        got = semantic_bucket(ask(spark), vectors(spark, scores[:n]), floor=0.1, k=400).collect()
        unit = np.array([r["score"] for r in semantic_bucket(ask(spark), vectors(spark, scores[:n]), floor=-1, k=1).collect()])
        m = np.median(scores[:n])
        gate = m + 3 * np.median(np.abs(scores[:n] - m))
        assert got[0]["gate"] == pytest.approx(gate, abs=1e-9)
        assert len(got) == int((scores[:n] >= gate).sum())
        assert len(unit) == 1


def test_results_do_not_depend_on_partitions(spark):
    rng = random.Random(8)
    bits = near_bits(rng, 60, 6)
    rows = [(1, i, "png", "%016x" % (b & ((1 << 64) - 1))) for i, b in enumerate(bits)] + [
        (1, 1000 + i, "png", "%016x" % (bits[0] & ((1 << 64) - 1))) for i in range(30)
    ]
    schema = "source_id bigint, asset_id bigint, ext string, phash string"

    def run(order, parts):
        df = spark.createDataFrame(order, schema).repartition(parts)
        return sorted(tuple(r) for r in K.phash_clusters(df).select("key", "asset_id", "role", "hamming").collect())

    assert run(rows, 1) == run(rows[::-1], 7)


def parts_of(nodes, pairs):
    """Least member of each node's part of the graph, by plain search."""
    part = {x: x for x in nodes}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        part[y] = x
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("d", [0, 6, 14, 22, 34, 64])
def test_connecting_pairs_are_a_forest(d):
    rng = random.Random(d)
    bits = near_bits(rng, 300, 18)
    a, b = bits[:180], bits[120:]
    x, y = connecting_pairs(np.array(a).view(np.uint64), np.array(b).view(np.uint64), d)
    got = list(zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), strict=True))
    assert all(dist(p, q) <= d for p, q in got)
    want = parts_of(bits, [(p, q) for p in a for q in b if p != q and dist(p, q) <= d])
    assert parts_of(bits, got) == want and len(got) == len(bits) - len(set(want.values()))
    assert [len(z) for z in connecting_pairs(np.array(a).view(np.uint64), np.empty(0, np.uint64), d)] == [0, 0]


def test_links_of_alike_fingerprints_grow_with_their_number(spark):
    rng = random.Random(21)
    base = rng.getrandbits(64)
    bits = set()
    while len(bits) < 400:
        x = base
        for p in rng.sample(range(64), 9):
            x ^= 1 << p
        bits.add(x - (1 << 64) if x >> 63 else x)
    rows = [(1, "png" if i % 2 else None, b, i) for i, b in enumerate(sorted(bits))]
    nodes = spark.createDataFrame(rows, "source_id bigint, ext string, bits bigint, node bigint")
    got = [(r["bits_a"], r["bits_b"]) for r in K.phash_edges(nodes, 22).collect()]
    # all 19,900 pairs of the one type are in reach
    assert len(got) == 199 and len(set(parts_of([b for _, e, b, _ in rows if e], got).values())) == 1
    links = hamming_links(nodes.select("source_id", "bits"), 16, ["source_id"], tile=90).collect()
    pairs = [(r["bits_a"], r["bits_b"]) for r in links]
    close = [(p, q) for p in bits for q in bits if p < q and dist(p, q) <= 16]
    assert parts_of(bits, pairs) == parts_of(bits, close)
    # five slices make fifteen tiles of at most as many links as rows
    assert len(pairs) < 15 * 180 < len(close)
