"""Matching at the limits: long exclusion lists, large like-named families, refused queries."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from asset_atlas.driver.match_queries import QUERIES
from asset_atlas.operators import detail as D
from asset_atlas.operators import match as M
from asset_atlas.operators import search as S
from asset_atlas.session import cut

ASSET = "source_id bigint, asset_id bigint, name string, stem string, ext string, size bigint, phash string, content_hash string, rel_path string, dir string, width int, height int"


def family(spark, n):
    """Assets of one token set; every third shares one name that is also a query's stem."""
    name = F.when(F.col("id") % 3 == 0, "big-icon").otherwise(F.concat(F.lit("icon_big_"), F.lit(".png")))
    return spark.range(n).select(
        F.lit(1).cast("long").alias("source_id"), F.col("id").alias("asset_id"), name.alias("name"),
        F.lit("icon-big").alias("stem"))


def test_like_named_assets_and_long_lists(spark):
    assets = family(spark, 100_000)
    queries = spark.createDataFrame([(1, q, "big-icon" if q % 2 else "icon-big") for q in range(40)],
                                    "source_id bigint, query_id bigint, stem string")
    taken = spark.range(40).select(
        F.col("id").alias("query_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(150).cast("long"))).alias("asset_id"))
    rows = assets.withColumn("tokens", F.array(F.lit("big"), F.lit("icon")))
    offered = M.offered_names(rows, taken, 10)
    assert offered.count() <= 2 * (10 + 151)
    got = {}
    for r in M.name_bucket(queries, assets, taken).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["asset_id"]))
    for q in range(40):
        free = [i for i in range(151, 400) if not (q % 2 and i % 3 == 0)][:10]
        assert sorted(got[q]) == list(enumerate(free, 1))


def test_names_are_ranked_once_for_a_token_set(spark):
    rng = random.Random(7)
    words = ["zebra", "tiger", "lion"]
    spec = []
    for i in range(600):
        stem = "-".join(rng.sample(words, rng.randint(1, 3)))
        # some assets bear the stem of a query as their name, some none
        name = None if i % 50 == 0 else "zebra-tiger" if rng.random() < 0.5 else f"{stem}.png"
        spec.append((1 + i % 2, i, name, stem))
    assets = spark.createDataFrame(spec, "source_id bigint, asset_id bigint, name string, stem string")
    asked = [(1 + q % 2, q, stem) for q, stem in enumerate(["zebra-tiger", "tiger-zebra", "lion", "zebra", "zebra-tiger-lion"] * 6)]
    queries = spark.createDataFrame(asked, "source_id bigint, query_id bigint, stem string")
    out = {(q, i) for _, q, _ in asked for i in rng.sample(range(600), 4 * (q % 5))}
    taken = spark.createDataFrame(sorted(out), "query_id bigint, asset_id bigint")
    got = [(r["query_id"], r["rank"], r["asset_id"]) for r in M.name_bucket(queries, assets, taken, k=5).collect()]
    want = []
    for source, q, stem in asked:
        hits = []
        for other, i, name, theirs in spec:
            a, b = set(stem.split("-")), set(theirs.split("-"))
            if source == other and name not in (None, stem) and (q, i) not in out and len(a & b) / len(a | b) >= 0.33:
                hits.append((-len(a & b) / len(a | b), i))
        want += [(q, rank, i) for rank, (_, i) in enumerate(sorted(hits)[:5], 1)]
    assert sorted(got) == sorted(want)
    pairs = spark.createDataFrame([(["red"], [w, "red"], 0.5) for w in "abcdefgh"],
                                  "tokens_a array<string>, tokens_b array<string>, score double")
    offered = pairs.select(F.lit(1).alias("source_id"), F.col("tokens_b").alias("tokens"),
                           F.explode(F.sequence(F.lit(1), F.lit(40))).alias("asset_id")).withColumn("name", F.uuid())
    # 320 assets of eight sets before: a query needs at most twice five and the three it leaves out
    assert M.ranked_names(pairs, offered, 3, 5).count() == 2 * (5 + 3)


def bits(rng):
    return f"{rng.getrandbits(64):016x}"


def rows(spark, spec):
    return spark.createDataFrame(
        [(1, i, f"{stem}.png", stem, "png", 10, p, h, f"d/{stem}-{i}.png", "d", 4, 4) for i, stem, p, h in spec], ASSET)


def test_lists_longer_than_the_listing(spark):
    p = bits(random.Random(1))
    assets = rows(spark, [(i, f"x{i}", p, f"h{i}") for i in range(120)])
    queries = assets.limit(1).withColumnRenamed("asset_id", "query_id")
    taken = spark.range(90).select(queries.first()["query_id"] * F.lit(1) + F.lit(0), F.col("id"))
    taken = taken.toDF("query_id", "asset_id")
    got = M.near_bucket(queries, assets, taken, k=5).collect()
    assert sorted(r["asset_id"] for r in got) == [90, 91, 92, 93, 94]


def test_limits_and_refusals(spark):
    p = bits(random.Random(2))
    assets = rows(spark, [(i, f"same-name-{i % 3}", p, "one") for i in range(30)])
    queries = assets.filter("asset_id < 2").withColumnRenamed("asset_id", "query_id").withColumn(
        "size", F.when(F.col("query_id") == 1, 99).otherwise(10).cast("long"))
    got = M.match(queries, assets, max_query_bytes=50, limits={"exact": 4, "near": 3, "name": 2}).collect()
    assert sorted((r["query_id"], r["bucket"]) for r in got) == (
        [(0, "exact")] * 4 + [(0, "name")] * 2 + [(0, "near")] * 3 + [(1, "refused")])
    named = [r for r in got if r["bucket"] == "name"]
    assert all(r["shared_tokens"] for r in named)
    seen = M.described(M.match(queries, assets), queries, assets)
    assert {r["near_degenerate"] for r in seen.collect()} == {False}
    assert {r["bytes"] for r in seen.collect()} == {10}


def test_siblings_of_a_large_family_by_steps(spark):
    rng = random.Random(4)
    base = rng.getrandbits(64)
    spec = []
    for i in range(160):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 16)):
            x ^= 1 << b
        spec.append((i, rng.choice(["zebra-tiger-lion", "zebra-tiger", "zebra-mouse"]), f"{x:016x}", f"h{i % 50}"))
    assets = rows(spark, spec)
    near = D.near_duplicates(assets, assets, raster=4, k=3)
    key = lambda df: sorted(map(tuple, df.select("subject_id", "rank", "asset_id", "hamming").collect()))
    once = key(D.name_siblings(assets, assets, near, raster=18, k=5, radii=[18]))
    assert once == key(D.name_siblings(assets, assets, near, raster=18, k=5, radii=[3, 8, 18]))
    taken = {(r["subject_id"], r["asset_id"]) for r in near.collect()}
    want = []
    for i, stem, p, h in spec:
        hits = []
        for j, other, x, g in spec:
            a, b = set(stem.split("-")), set(other.split("-"))
            d, score = bin(int(p, 16) ^ int(x, 16)).count("1"), len(a & b) / len(a | b)
            if i != j and h != g and d <= 18 and score >= 0.2 and (i, j) not in taken:
                hits.append((d, -score, j))
        want += [(i, r, j, d) for r, (d, _, j) in enumerate(sorted(hits)[:5], 1)]
    assert once == sorted(want)


def test_memberships_grow_with_the_members(spark):
    assets = rows(spark, [(i, "a", "", "h") for i in range(200)] + [(i, "b", "", "g") for i in range(200, 210)])
    members = assets.select("source_id", F.lit("hash").alias("kind"), F.col("content_hash").alias("key"), "asset_id",
                            F.lit("member").alias("role"))
    found = D.memberships(assets.filter("asset_id < 200"), members, assets)
    assert found.count() == 200 and found.filter("subject").count() == 200
    one = D.memberships(assets.filter("asset_id = 203"), members, assets)
    assert one.count() == 10 and one.filter("subject").count() == 1
    assert D.membership_listing(one, 203).count() == 10 and D.membership_listing(one, 204).count() == 0


def test_every_asset_is_a_subject_of_the_memberships(spark, tmp_path):
    # two copies of each type; only some clusters hold the first type
    kinds = ["SMALL", "LARGE", "MEDIUM", "PROMO", "ECONOMY"]
    part = [(i, f"part {i % 5}", "Brand#1", kinds[i % 5], 10 + i, float(i)) for i in range(10)]
    spark.createDataFrame(part, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
                          "p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = QUERIES["detail_memberships"](spark, str(tmp_path)).filter("kind = 'hash'").collect()
    assert sorted(r["asset_id"] for r in got) == list(range(10))
    assert all(r["subject"] and r["size"] == 2 for r in got)


def test_terms_are_counted_where_their_assets_are(spark):
    assets = rows(spark, [(i, "one-two-one" if i % 2 else "two", "", "h") for i in range(40)])
    index = S.inverted_index(assets)
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan
    tf = {(r["asset_id"], r["term"]): r["tf"] for r in index.collect()}
    assert tf[1, "one"] == 6 and tf[0, "two"] == 3 and tf[0, "png"] == 2


def test_siblings_write_no_row_a_like_named_pair(spark, monkeypatch):
    rng = random.Random(21)
    # sixty sets of tokens that all share one word
    assets = rows(spark, [(i, f"zebra-{chr(97 + i // 8) * 3}-{chr(97 + i % 8) * 4}", bits(rng), f"h{i}") for i in range(60)])
    counts = []

    def counted(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(D, "cut", counted)
    near = assets.limit(0).selectExpr("asset_id as subject_id", "asset_id")
    assert D.name_siblings(assets, assets, near, raster=64, k=5).count() == 300
    assert max(counts) <= 60


def test_near_lists_write_no_pairs_where_all_are_compared(spark, monkeypatch):
    def joined(*_):
        raise AssertionError("pairs in reach as rows")

    rng = random.Random(22)
    base = rng.getrandbits(64)
    assets = rows(spark, [(i, f"x{i}", f"{base ^ (1 << i % 60):016x}", f"h{i}") for i in range(70)])
    monkeypatch.setattr(M, "hamming_query_join", joined)
    monkeypatch.setattr(D, "hamming_query_join", joined)
    queries = assets.withColumnRenamed("asset_id", "query_id")
    assert M.near_bucket(queries, assets, k=3).count() == 210
    assert D.near_duplicates(assets, assets, k=3).count() == 210


def test_nearest_by_parts_and_slots_equals_brute_force(spark, monkeypatch):
    from asset_atlas.operators import nearest as N

    monkeypatch.setattr(N, "PART_ROWS", 12)
    monkeypatch.setattr(N, "SLOT_ROWS", 7)
    rng = random.Random(23)
    spec = []
    for i in range(90):
        x = rng.choice([0, (1 << 64) - 1])
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        spec.append((i // 2 if i < 10 else i, x - (1 << 64) if x >= 1 << 63 else x, rng.randint(1, 3), rng.randint(1, 5),
                     sorted(rng.sample(range(6), rng.randint(1, 4))), rng.choice([3, 9])))
    assets = spark.createDataFrame(
        spec, "asset_id bigint, bits bigint, group bigint, content bigint, words array<bigint>, reach int")
    taken = sorted({(rng.randrange(90), rng.randrange(90)) for _ in range(400)})
    listed = cut(spark.createDataFrame(taken, "subject_id bigint, asset_id bigint"))
    # a group of token sets is one set
    sets = cut(assets.withColumn("group", F.xxhash64("words")))
    assets = cut(assets)
    for rows_, least in ((assets, None), (sets, 0.4)):
        subjects = rows_.withColumnRenamed("asset_id", "subject_id")
        got = N.nearest(subjects, rows_, 6, listed, least, others=True, own_content=least is not None)
        # five ids have two rows, which may lie in two groups
        got = M.first_per(got, ["subject_id"], 6, "hamming", F.desc("score"), "asset_id")
        want = []
        for s in {r[0] for r in spec}:
            hits = []
            for i, x, g, c, w, reach in spec:
                for j, y, h, e, v, _ in spec:
                    d, score = bin((x ^ y) & ((1 << 64) - 1)).count("1"), len({*w} & {*v}) / len({*w} | {*v})
                    alike = g == h if least is None else score >= least and c != e
                    if i == s and i != j and alike and d <= reach and (i, j) not in taken:
                        hits.append((s, d, -score if least else 0.0, j))
            want += sorted(hits)[:6]
        assert sorted((r["subject_id"], r["hamming"], -r["score"], r["asset_id"]) for r in got.collect()) == sorted(want)
