"""Joins, mixtures and searches against brute force on small tables."""

import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lattice.llm import graph, mixing, ngram_join, topk
from lattice.llm.common import lookup, ranked

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return {d: (len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows)}


def _near_texts(seed, families, copies):
    rnd = random.Random(seed)
    out = []
    for _ in range(families):
        base = [rnd.choice("abcdefghij") * rnd.randint(1, 3) + str(rnd.randint(0, 40)) for _ in range(rnd.choice((3, 4, 5, 6, 8, 9, 12, 20, 40, 90)))]
        for _ in range(rnd.randint(1, copies)):
            w = list(base)
            for _ in range(rnd.choice((0, 0, 1, 1, 2))):
                w[rnd.randrange(len(w))] = rnd.choice(("X", "Y9", str(rnd.random())))
            out.append(rnd.choice((" ", "\n", "\t ")).join(w).upper() if rnd.random() < 0.3 else " ".join(w))
    return out


@pytest.mark.parametrize("seed", [1])
def test_near_components_equal_brute_force(spark, seed):
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "a b c d e f", *_near_texts(seed, 40, 7)]
    ids = random.Random(seed).sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n long, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark, df).collect()}
    assert got == brute_components(rows)


def test_every_boundary_gives_the_same_groups(spark, monkeypatch):
    rows = list(enumerate(_near_texts(5, 25, 6)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (0, 10**6):
        monkeypatch.setattr(ngram_join, "_boundary", lambda *_, b=bound: b)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark, df).collect()}
        assert got == brute_components(rows)


def test_frequent_hashes_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_FREQUENT", 10**6)  # 64 sets with a hash make it frequent
    common = "these six words are in all"
    rows = [(i, f"{common} {i} {i + 1} {i + 2} " + " ".join(f"w{i}x{k}" for k in range(i % 7))) for i in range(150)] + [(200 + i, f"{common} q r s t u v w x {i % 3}") for i in range(9)] + [(5, common)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components([(i, t) for i, t in rows if i != 5])
    got = {r.doc_id: r.component_id for r in ngram_join.near_components(spark, df).where("doc_id <> 5").collect()}
    assert got == {i: c for i, (_, c) in expected.items()}
    assert ngram_join.near_components(spark, df).count() == len(rows)


def test_near_components_of_nothing(spark):
    assert ngram_join.near_components(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (3, 2)]
    got = {r.node: r.root for r in graph.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}


def test_lookup_and_ranks(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(60)], "i long, key string")
    right = left.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("v"))
    got = {r.i: r.v for r in lookup(left, right, "key", "n", at_most=8).collect()}
    assert got == {i: 0 if i % 3 == 0 else None if i % 3 == 1 else i for i in range(60)}
    assert sorted((r["rank"], r.i) for r in ranked(spark, left, F.col("i").desc()).collect()) == [(r, 59 - r) for r in range(60)]


def _expected_mix(rows, weights=(5, 2, 1)):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return sizes, target | share
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return sizes, target


def test_mix_meets_targets(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 30)) or None, rnd.choice(["a", "a", "a", "b", "é", None, ""])) for i in range(300)]
    rows += [(1, "w w", rows[1][2])] * 3
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size long, key string")
    sizes, target = _expected_mix(rows)
    got = mixing.mix(spark, df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(spark, df).collect()))
    by_source, names = defaultdict(int), {r[0]: r[2] for r in rows}
    for r in got:
        s = names[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 2 * r.size
        by_source[s] += r.taken
    assert all(by_source[s] == math.floor(target[s] + 1e-9) for s in sizes)
    assert mixing.mix(spark, df.limit(0)).count() == 0


def _brute_top(rows, k=10):
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in ok:
        if q % 20 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [16 << 20, 64])
def test_top_k_with_many_ties(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_BYTES", block)
    monkeypatch.setattr(topk, "_BINS", 8)
    rnd = random.Random(6)
    rows = [(i, [rnd.choice((0.5, 0.25, -0.125, 0.001))] * 2 + [0.1]) for i in range(0, 120)]
    rows += [(200, None), (201, [None, 1.0, 2.0]), (220, [float("nan"), 0.0, 0.0]), (240, [1.0, 2.0]), (241, [0.5, 0.5]), (260, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, rank string")
    got = topk.top_k(spark, topk.quantized(df), F.col("vec_id") % 20 == 0, 10).collect()
    assert sorted(map(tuple, got)) == _brute_top(rows)
    assert topk.top_k(spark, topk.quantized(df.limit(0)), F.col("vec_id") % 20 == 0).count() == 0


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**20, 2.0**-10]), (2, [2.0**20, 0.0]), (3, [2.0**20 - 2**-10, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(spark, topk.quantized(df), F.col("vec_id") == 0, 10).collect()
    assert sorted(map(tuple, got)) == [r for r in _brute_top(rows) if r[0] == 0]


def test_lookup_spreads_rows_by_what_they_hold(spark):
    from lattice.llm.common import lookup

    left = spark.createDataFrame([(i, [None, "hot", "hot", f"k{i}"][i % 4]) for i in range(200)], "id long, key string")
    right = left.where("key is not null").groupBy("key").count().selectExpr("key", "count as n", "upper(key) as v")
    out = lookup(left, right, "key", "n", at_most=1)
    assert "monotonically_increasing_id" not in out._jdf.queryExecution().toString()  # it depends on the order of a task's rows
    assert sorted((r.id, r.v) for r in out.collect()) == [(i, [None, "HOT", "HOT", f"K{i}"][i % 4]) for i in range(200)]


def test_top_k_with_ids_of_all_64_bits(spark):
    rnd = random.Random(2)
    ids = [-(2**63), 2**63 - 1, 7 * 10**18, -7 * 10**18, 0, -1, *(rnd.randrange(-(2**63), 2**63) for _ in range(60))]
    rows = [(i, [rnd.choice((0.5, 0.25)), 0.5]) for i in ids]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(spark, topk.quantized(df), F.col("vec_id").isin(ids[:6]), 5).collect()
    v = {i: [math.floor(1024 * x) for x in e] for i, e in rows}
    expected = [(q, n + 1, i, -s) for q in ids[:6] for n, (s, i) in enumerate(sorted((-sum(a * b for a, b in zip(v[q], v[i], strict=True)), i) for i in v if i != q)[:5])]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_what_passes_64_bits_is_refused(spark):
    for x in (1e17, 1e12):
        df = spark.createDataFrame([(0, [x]), (1, [x])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match="64 bits"):
            topk.top_k(spark, topk.quantized(df), F.col("vec_id") == 0).collect()


def test_wide_lookup_and_parts_of_a_range(spark, monkeypatch):
    from lattice.llm.common import lookup_wide

    left = spark.createDataFrame([(i, [None, "hot", "hot", f"k{i}"][i % 4]) for i in range(200)], "id long, key string")
    right = left.where("key is not null").groupBy("key").count().selectExpr("key", "count as n", "upper(key) as v")
    assert sorted((r.id, r.v) for r in lookup_wide(left, right, "key", "n").collect()) == [(i, [None, "HOT", "HOT", f"K{i}"][i % 4]) for i in range(200)]
    assert lookup_wide(left.limit(0), right.limit(0), "key", "n").count() == 0
    monkeypatch.setattr(ngram_join, "_AT_ONCE", 50)
    rows = list(enumerate(_near_texts(11, 20, 5)))
    rows.append((999, " ".join(f"long{i}" for i in range(60_000))))  # a very long text
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_components(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)
