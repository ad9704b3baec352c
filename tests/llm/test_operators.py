"""The corpus operators against brute force, labels and their SQL twins."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from asset_atlas.llm import decontam, lines, lm, mixing, near, pii, queries, rows, rules, substrings
from tests.oracle import compare, connect

from .small import SF, cut_repeats, near_classes, words


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in rows.documents(spark, SF).select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    result = compare(spark, SF, connect(SF), queries.QUERIES[name], queries.ORACLES[name])
    assert result["ok"], result


def test_katz_matches_brute_force(spark, texts):
    tokens = {i: [*words(t), None] for i, t in texts}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    one, two, context = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            one.update(w)
            two.update(zip(["<s>", *w[:-1]], w, strict=True))
            context.update(["<s>", *w[:-1]])
    n, v = sum(one.values()), len(one)
    d1, d2 = (lm.discounts([sum(c == r for c in x.values()) for r in range(1, 7)]) for x in (one, two))

    def taken(r, d):
        return r * (d[r] if r < len(d) else 1)

    rest = n - sum(taken(r, d1) for r in one.values())

    def p1(w):
        return taken(one[w], d1) / n if one[w] else rest / n

    disc, low = Counter(), Counter()
    for (u, w), r in two.items():
        disc[u] += taken(r, d2)
        low[u] += p1(w)

    def p2(u, w):
        if not context[u]:
            return p1(w)
        left = context[u] - disc[u]
        full = left <= 1e-9 * context[u]
        whole = context[u] + full
        return taken(two[u, w], d2) / whole if two[u, w] else (1 if full else left) / whole / (1 - low[u]) * p1(w)

    # exact normalisation: seen words, unseen known words and the unseen class sum to one
    for u in list(disc)[:20]:
        assert math.isclose(sum(p2(u, w) for w in one) + p2(u, "\0never"), 1, rel_tol=1e-9)
    got = queries.op1_lm(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        w = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (
            len(w), sum(one[x] > 0 for x in w), n, held[r["doc_id"]])
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(
            r["score"], sum(math.log10(p2(u, x)) for u, x in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-9)


def test_discounts_fall_back():
    assert list(lm.discounts([0] * 6))[1:] == [1 - 0.5 / r for r in range(1, 6)]
    assert all(0 < x <= 1 for x in lm.discounts([10, 3, 1, 1, 1, 0])[1:])


def test_classifier_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = [r for r in queries.op4_quality(spark, SF).collect() if r["doc_id"] in labels and r["held_out"]]
    assert len(got) > 10
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in got]) > 0.8


def test_languages_on_held_out_rows(spark):
    known = {r["doc_id"]: r["lang"] for r in rows.documents(spark, SF).collect()}
    got = [r for r in queries.op8_langid(spark, SF).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == known[r["doc_id"]] for r in got]) > 0.95


def test_near_classes_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [[rng.choice(vocabulary) for _ in range(120)] for _ in range(8)]
    docs = []
    for i in range(70):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append((i, " ".join(w)))
    want = near_classes(docs)
    got = near.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["_doc"]: r["class_id"] for r in got} == want
    assert sum(r["is_head"] for r in got) == len(set(want.values()))


def test_near_copies_with_repeats_inside_them(spark):
    rng = random.Random(9)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs = []
    for i in range(24):
        body, passage, other = prose(200), prose(60), prose(40)
        docs.append((2 * i, " ".join(body + passage + other * (i % 2))))
        docs.append((2 * i + 1, " ".join(body + passage * (40 + 40 * (i % 3)) + other * (60 * (i % 2)))))
    # repeats of all words leave the set as it is; different passages do not make a link
    docs += [(100, " ".join(base := prose(90))), (101, " ".join(base * 30)), (102, " ".join(base[:60] + prose(30)))]
    want = near_classes(docs)
    assert sum(i != c for i, c in want.items()) == 25
    got = near.classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["_doc"]: r["class_id"] for r in got} == want


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(5)
    h = rows.mix(np.arange(1, 301, dtype=np.uint64))
    x, y = rng.integers(0, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
    doc = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    who = near.signatures(doc, np.concatenate([h[x > 0], h[y > 0]]), np.concatenate([x[x > 0], y[y > 0]]), 2, 2048)
    both = (x > 0) & (y > 0)
    want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in np.flatnonzero(both))
    assert abs((who[0] == who[1]).mean() - want) < 0.05


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, " ".join(f"t{rng.randrange(900)}" for _ in range(rng.randint(12, 50)))) for i in range(40)]
    items += [(40, "two words"), (41, ""), (42, None)]
    noise = lambda n: " ".join(f"n{rng.randrange(900)}" for _ in range(n))
    docs, want = [], set()
    for i in range(60):
        text = noise(rng.randint(0, 200))
        if i % 3 == 0:
            key, item = items[rng.randrange(40)]
            text = f"{text} {item.upper() if i % 2 else item}  {noise(30)}"
            want.add((i, key))
        docs.append((i, text))
    docs.append((60, "a Two\nWORDS b"))
    want.add((60, 40))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(d, q).collect()} == want
    blocks = decontam.matches(d, q, block=7).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == want
    for r in blocks:
        raw = dict(docs)[r["doc_id"]].encode()
        assert words(raw[r["first_byte"] : r["end_byte"]].decode()) == words(dict(items)[r["item_id"]])
    left = {r["doc_id"] for r in decontam.clean(d, q).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_edited_copies_of_items_are_found(spark):
    """Recall on near copies, against the similarity of all item-sized windows."""
    rng = random.Random(14)
    items = [(i, " ".join(f"t{rng.randrange(5000)}" for _ in range(rng.randint(70, 130)))) for i in range(60)]
    docs = []
    for i in range(180):
        w = items[i % 60][1].split()
        for _ in range(i % 3):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [f"x{i}"], [w[k], f"y{i}"]])
        noise = [f"n{rng.randrange(5000)}" for _ in range(rng.randint(0, 80))]
        at = rng.randint(0, len(noise))
        docs.append((i, " ".join(noise[:at] + w + noise[at:])))

    def grams(w):
        return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))

    want = set()
    for i, text in docs:
        own = grams(items[i % 60][1].split())
        w, size = text.split(), len(items[i % 60][1].split())
        best = max((own & g).total() / (own | g).total() for g in (grams(w[k : k + size]) for k in range(max(1, len(w) - size + 1))))
        if best >= decontam.SIMILARITY:
            want.add((i, i % 60))
    rows_ = decontam.matches(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string")).collect()
    # a window may have the size of any item; each one reported is similar enough
    for r in rows_:
        x = grams(docs[r["doc_id"]][1].encode()[r["first_byte"] : r["end_byte"]].decode().split())
        y = grams(items[r["item_id"]][1].split())
        assert (x & y).total() / (x | y).total() >= decontam.SIMILARITY
    got = {(r["doc_id"], r["item_id"]) for r in rows_}
    assert len(want) > 100 and all(i % 60 == k for i, k in got)
    # the radius holds a window at the similarity with 99.9 %
    assert len(got & want) >= 0.99 * len(want)


def test_hamming_tables_miss_nothing():
    rng = random.Random(6)
    index = decontam.build_index([(i, " ".join(f"t{rng.randrange(300)}" for _ in range(20))) for i in range(30)])
    prints = []
    for p in index.prints:
        for flips in range(decontam.RADIUS + 3):
            x = int(p)
            for b in rng.sample(range(64), flips):
                x ^= 1 << b
            prints.append(x)
    prints = np.array(prints, dtype=np.uint64)
    got = set(zip(*[a.tolist() for a in decontam._near(prints, index, decontam.RADIUS)], strict=True))
    want = {(w, i) for w, x in enumerate(prints) for i, p in enumerate(index.prints)
            if bin(int(x) ^ int(p)).count("1") <= decontam.RADIUS}
    assert got == want


def test_repeated_bytes_match_brute_force(spark):
    rng = random.Random(8)
    blob = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [blob(n) for n in (300, 420, 700, 1500)]
    docs = []
    for i in range(40):
        parts = [blob(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 200)
            parts += [s[a : a + rng.randint(250, 1500)], blob(rng.randint(0, 80))]
        docs.append((i, "".join(parts)))
    docs += [(100, docs[3][1]), (101, docs[3][1]), (102, "z" * 2000), (103, None), (104, "")]
    want = cut_repeats(docs)
    got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id bigint, text string"), keep=["doc_id"])
    got = {r["doc_id"]: (r["_n_bytes"], r["_n_removed"], r["_n_spans"], bytes(r["_kept"])) for r in got.collect()}
    assert got == want
    assert any(w[1] for w in want.values())


def test_repeated_bytes_on_the_documents(spark, texts):
    want = {i: (*w[:3], hashlib.sha256(w[3]).hexdigest()) for i, w in cut_repeats(texts).items()}
    got = queries.op10_substrings(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_spans_in_awkward_places(spark):
    cases = {
        "a@b.com_x@c.org": "email:0:7,email:7:15",
        "é+1 (212) 555-0100": "phone:1:18",
        "4111 1111 1111 1111": "card:0:19",
        "4111 1111 1111 1112": "",
        "10.0.0.255 1.2.3.4.5.6.7.8 10.0.0.256": "ip:0:10,ip:11:18,ip:19:26",
        "iban GB82 WEST 1234 5698 7654 32.": "iban:5:32",
        "GB82 WEST 1234 5698 7654 33": "",
        "a" * 30_000: "",
        "1" * 30_000: "",
        "a@b" + ".c" * 20_000: f"email:0:{3 + 40_000}",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.redact_counts(pii.find_spans(docs)).collect()}
    assert got == dict(enumerate(cases.values()))


def test_accounts_end_where_their_country_says(spark):
    cases = {
        "ES91 2100 0418 4502 0005 1332 BIC ABCD": "iban:0:29",
        "AT61 1904 3002 3457 3201 BIC": "iban:0:24",
        "BE68 5390 0754 7034 X1": "iban:0:19",
        "SE45 5000 0000 0583 9825 7466 ES91 2100 0418 4502 0005 1332 OK": "iban:0:29,iban:30:59",
        "ES9121000418450200051332 DE89370400440532013000 AB": "iban:0:24,iban:25:47",
        "ES91 2100 0418 4502 0005 1333 BIC": "",
    }
    docs = spark.createDataFrame(list(enumerate(cases)), "doc_id bigint, text string")
    iban = [k for k in pii.KINDS if k.name == "iban"]
    got = {r["doc_id"]: r["found"] for r in pii.find_spans(docs, kinds=iban).select("doc_id", pii.digest(F.col("found"), iban).alias("found")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_targets_are_met(spark):
    docs = rows.documents(spark, SF)
    goal = spark.createDataFrame([("en", 0.4), ("de", 0.3), ("fr", 0.2), ("es", 0.1)], "lang string, _target double")
    mixed = mixing.mix_sources(docs, margins=["lang"], targets={"lang": goal}, share=1.0).toPandas()
    drawn = (mixed["_rate"] * mixed["_n_words"]).groupby(mixed["lang"]).sum()
    shares = drawn / drawn.sum()
    assert all(abs(shares[k] - x) < 1e-6 for k, x in {"en": 0.4, "de": 0.3, "fr": 0.2, "es": 0.1}.items())


def test_three_margins_are_met_together(spark):
    # source c alone holds language z: after eight sweeps a share is still a tenth off
    words_in = {("a", "x"): 4000, ("a", "y"): 100, ("b", "x"): 100, ("b", "y"): 3000, ("c", "z"): 500, ("c", "x"): 800}
    docs = [(i, "w " * n + tail, source, lang) for i, ((source, lang), n, tail) in enumerate(
        (k, n, tail) for k, n in words_in.items() for tail in ("", "| a | b | c | d"))]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    # "none" holds no words: the others are rescaled
    want = {"source": {"a": 0.2, "b": 0.2, "c": 0.4, "none": 0.2}, "lang": {"x": 0.35, "y": 0.35, "z": 0.3},
            "topic": {"prose": 0.6, "table": 0.4}}
    goals = {m: spark.createDataFrame(list(t.items()), f"{m} string, _target double") for m, t in want.items()}
    mixed = mixing.mix_sources(docs, targets=goals, share=1.0).toPandas()
    mixed["drawn"] = mixed["_rate"] * mixed["_n_words"]
    assert abs(mixed["drawn"].sum() / mixed["_n_words"].sum() - 1) < 1e-4
    want["source"] = {"a": 0.25, "b": 0.25, "c": 0.5}
    for m, t in want.items():
        got = mixed["drawn"].groupby(mixed["_topic" if m == "topic" else m]).sum() / mixed["_n_words"].sum()
        assert all(abs(got[v] / x - 1) < 0.0101 for v, x in t.items()), (m, got)


def test_contradicting_targets_are_reported(spark):
    docs = spark.createDataFrame([(1, "w w w", "a", "x"), (2, "w w", "b", "y")],
                                 "doc_id bigint, text string, source string, lang string")
    goals = {m: spark.createDataFrame([(v, 0.9), (w, 0.1)], f"{m} string, _target double")
             for m, v, w in (("source", "a", "b"), ("lang", "y", "x"))}
    with pytest.warns(UserWarning, match="off its target"):
        mixing.mix_sources(docs, margins=["source", "lang"], targets=goals)


def test_run_family_levels(spark):
    family = lines.RunFamily(fan_in=2)
    for b in range(5):
        keys = [(k, 0, 1, b) for k in range(b, b + 3)]
        batch = spark.createDataFrame(keys, "h1 bigint, h2 bigint, n_docs bigint, max_doc bigint")
        assert {r["h1"] for r in family.unseen(batch).collect()} == ({b + 2} if b else {0, 1, 2})
        family.add(batch)
    assert [len(level) for level in family.levels] == [1, 0, 1]
    assert {r["h1"]: (r["n_docs"], r["max_doc"]) for r in family.totals().collect()} == {
        k: (sum(b <= k < b + 3 for b in range(5)), min(k, 4)) for k in range(7)}


def test_rules_name_what_failed(spark):
    docs = spark.createDataFrame([(1, "### " * 60), (2, "the cat " * 60)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["broken"]) for r in rules.judge(docs).collect()}
    assert got[1][:2] == (True, False) and "symbols" in got[1][2]
    assert got[2] == (True, False, "repeats")
