"""Fingerprints, components and repeated bytes against brute force."""

import collections
import hashlib

import numpy as np
import pytest
import xxhash

from unimass.llm import graph, simhash, suffixes

SCHEMA = "doc_id long, text string, fp long, component_id long, key long, spans string, row_key long"


def table(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 1, 2, 3, "x", 4) for i, t in zip(ids, texts)], SCHEMA)


def words(n, seed, pool=400):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, pool, n)]


def edited(base, places):
    out = list(base)
    for p in places:
        out[p] = f"new{p}"
    return " ".join(out)


@pytest.fixture(scope="module")
def texts():
    base = words(300, 1)
    out = [" ".join(base), edited(base, [5]), edited(base, [5, 200]), " ".join(base).upper()]
    out += [" ".join(words(200, s)) for s in range(10, 30)]
    return out + ["", None, " \t\n", "one", "One two", "ÉÀ words é", " ".join(base)]


def brute_print(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots_of(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_fingerprints(spark, texts):
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"])
           for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    root = roots_of(len(texts), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    assert got == {i: (p, r) for i, (p, r) in enumerate(zip(prints, root))}


def test_null_and_repeated_ids(spark):
    same = "a b c d e f"
    got = simhash.near_duplicates(table(spark, [same, same, same, "z y x"], [7, 7, None, None])).collect()
    assert sorted(str((r["doc_id"], r["component_id"])) for r in got) == sorted(
        map(str, [(7, 7), (7, 7), (None, 7), (None, None)]))
    assert simhash.near_duplicates(table(spark, ["a"]).limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 2, 4, 7])
def test_tree_finds_all_pairs(radius):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = np.unique(np.concatenate([
        np.array([c ^ np.uint64(sum(1 << int(b) for b in set(rng.integers(0, 64, rng.integers(0, 7)))))
                  for _ in range(20)], np.uint64) for c in centres]))
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points))
            if int(points[i] ^ points[j]).bit_count() <= radius}
    pairs = [(min(a, b), max(a, b)) for x, y in simhash.close_pairs(points, radius, leaf=8)
             for a, b in zip(x.tolist(), y.tolist())]
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_large_shards_are_split(spark):
    rng = np.random.default_rng(6)
    near = [int(rng.integers(0, 1 << 40)) for _ in range(300)]  # all agree on the upper blocks
    near += [x ^ 3 for x in near[:100]]
    nodes = spark.createDataFrame([(x,) for x in sorted(set(near))], "fp long")
    split = simhash.shards(nodes, 4, limit=50)
    assert split.select("shard").distinct().count() > 5 + 64 // 13
    links = simhash.links(nodes, 4, limit=50)
    got = {r["node"]: r["root"] for r in graph.components(links).collect()}
    ordered = sorted(set(near))
    root = roots_of(len(ordered), lambda i, j: (ordered[i] ^ ordered[j]).bit_count() <= 4)
    for i, x in enumerate(ordered):
        assert got.get(x, x) == ordered[root[i]]


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(
        spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark, texts):
    docs = table(spark, texts)
    kept = simhash.one_of_each(docs.union(docs.limit(1)))
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids))
    assert {0, 24, 27, 28} <= set(ids) and not {1, 2, 3, 25, 26, 30} & set(ids)
    assert set(range(4, 24)) <= set(ids)  # unrelated texts stay
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[i:i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_of_high_similarity_are_found(spark):
    rng = np.random.default_rng(8)
    texts, similar = [], 0
    for s in range(60):
        base = words(250, 100 + s, pool=3000)
        texts += [" ".join(base), edited(base, rng.choice(250, 4, replace=False))]
        similar += jaccard(*texts[-2:]) >= 0.8
    kept = {r["doc_id"] for r in simhash.one_of_each(table(spark, texts)).collect()}
    assert similar > 50 and set(range(0, 120, 2)) <= kept
    assert len(kept) - 60 <= 0.05 * 60


def test_texts_below_the_similarity_stay(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HELD", 3000)  # shards are compared in pairs of blocks
    texts = []
    for s in range(12):  # each base with edits of growing number
        base = words(250, 300 + s, pool=3000)
        rng = np.random.default_rng(s)
        texts += [" ".join(base)] + [edited(base, rng.choice(250, k, replace=False)) for k in (1, 3, 9, 9, 12, 15)]

    def close(i, j):
        prints = [[int(simhash.majority([simhash.shingle_hashes(texts[x], 2, seed, True)])[0])
                   for seed in simhash.PAIR_SEEDS] for x in (i, j)]
        return jaccard(texts[i], texts[j]) >= 0.8 and min(
            (a ^ b).bit_count() for a, b in zip(*prints)) <= simhash.PAIR_RADIUS

    root = roots_of(len(texts), lambda i, j: i // 7 == j // 7 and close(i, j))
    kept = {r["doc_id"] for r in simhash.one_of_each(table(spark, texts)).collect()}
    assert kept == set(root) and 12 < len(kept) < len(texts)


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f g", 5, 6, 7, 8), (2, "a b c d e f g", 5, 6, 9, 8), (3, "x", 1, 2, 3, 4), (3, "x", 1, 2, 3, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long, KEPT_KEY long, Row_Key long, fp_42 long")
    assert sorted(map(tuple, simhash.one_of_each(docs).collect())) == [rows[0], rows[2]]


def test_a_large_loose_group(spark):
    """Texts near one base, few of them alike: the components of all alike pairs, one row for each node."""
    rng = np.random.default_rng(12)
    base = words(150, 900, pool=3000)
    texts = [edited(base, rng.choice(150, int(rng.integers(0, 14)), replace=False)) for _ in range(300)]
    texts = [t.replace("new", f"n{i}-") for i, t in enumerate(texts)]
    prints = [[int(simhash.majority([simhash.shingle_hashes(t, 2, seed, True)])[0]) for seed in simhash.PAIR_SEEDS]
              for t in texts]
    root = roots_of(len(texts), lambda i, j: jaccard(texts[i], texts[j]) >= 0.8 and min(
        (a ^ b).bit_count() for a, b in zip(prints[i], prints[j])) <= simhash.PAIR_RADIUS)
    kept = {r["doc_id"] for r in simhash.one_of_each(table(spark, texts)).collect()}
    assert kept == set(root) and 20 < len(kept) < 250
    names = [f"fp_{s}" for s in simhash.PAIR_SEEDS]
    sharded = spark.createDataFrame([("0:0:0", i, *[x - (x >> 63 << 64) for x in p]) for i, p in enumerate(prints)],
                                    "shard string, node long, " + ", ".join(f"{n} long" for n in names))
    found = simhash.with_partners(sharded).collect()
    assert len(found) == len({r["node"] for r in found}) <= len(texts)


def test_dense_shards_are_dealt_to_pairs_of_blocks(spark):
    rows = spark.createDataFrame([("d", i) for i in range(500)] + [("s", i) for i in range(20)], "shard string, fp long")
    met, sizes = set(), []
    dealt = {}
    for r in simhash.in_blocks(rows, ["fp"], 100).collect():
        dealt.setdefault(r["shard"], []).append(r["fp"])
    for name, own in dealt.items():
        if name != "s":
            sizes.append(len(own))
            met |= {(a, b) for a in own for b in own}
    assert len(met) == 500 * 500 and max(sizes) < 160 and sorted(dealt["s"]) == list(range(20))
    ball = [0] + [1 << i for i in range(64)] + [3 << i for i in range(63)]
    ball = [x - (x >> 63 << 64) for x in ball]
    nodes = spark.createDataFrame([(x,) for x in ball], "fp long")
    got = graph.components(simhash.links(nodes, 4, limit=10)).collect()
    assert len(got) == len(ball) and {r["root"] for r in got} == {min(ball)}


def brute_removed(texts, limit):
    seen = collections.Counter()
    data = [(t or "").encode() for t in texts]
    for b in data:
        seen.update(b[i:i + limit] for i in range(len(b) - limit + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - limit + 1):
            if seen[b[i:i + limit]] > 1:
                gone[i:i + limit] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [2, 9, 30, 120])
def test_repeated_bytes(spark, limit):
    rng = np.random.default_rng(limit)
    shared = ["".join(rng.choice(list("abc é"), 3 * limit)) for _ in range(4)]
    texts = []
    for i in range(40):
        parts = ["".join(rng.choice(list("abcdefgh é"), rng.integers(0, 3 * limit))) for _ in range(3)]
        cut = sorted(rng.integers(0, 3 * limit, 2))
        texts.append(parts[0] + shared[i % 4][cut[0]:cut[1]] + parts[1] + shared[(i + 1) % 4] * (i % 3 == 0) + parts[2])
    texts += ["", None, "a" * (3 * limit), "ab" * (2 * limit), texts[0], texts[1][: limit - 1], "z" * limit]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
           for r in suffixes.removed(table(spark, texts), limit).collect()}
    assert got == dict(enumerate(brute_removed(texts, limit)))


def test_repeated_rows_are_other_texts(spark):
    text = "".join(np.random.default_rng(2).choice(list("abcdef"), 500))
    got = suffixes.removed(table(spark, [text, text, text[:399]], [5, 5, None])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("5", 500), ("5", 500), ("None", 0)]
    assert suffixes.removed(table(spark, [text]).limit(0)).count() == 0
