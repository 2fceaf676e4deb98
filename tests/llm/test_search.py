"""Top-k search and benchmark leaks against brute force."""

import math

import numpy as np
import pyarrow as pa
import pytest

from unimass.llm import impact, latent


def brute_top(rows, queries, k):
    out = {}
    for q, x in queries:
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), v) for v, y in rows if v != q))
        out[q] = [(v, -s) for s, v in scores[:k]]
    return out


def whole(rows):
    return [(i, [math.floor(256 * x) for x in e]) for i, e in rows
            if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]


@pytest.mark.parametrize("kind", ["normal", "ties", "skewed"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        e = {"normal": rng.normal(size=16), "ties": rng.integers(-1, 2, 16) / 4,
             "skewed": np.append(rng.normal(), np.zeros(15)) * 10.0 ** rng.integers(-3, 2)}[kind]
        rows.append((i, [float(np.float32(x)) for x in e]))
    rows += [(1000, None), (1001, [1.0, None] + [0.0] * 14), (1050, [float("nan")] * 16),
             (1100, [float("inf")] * 16), (None, [1.0] * 16), (1150, [0.0] * 16), (1200, [])]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows],
                               "vec_id long, embedding array<float>, query string, rank int")
    got = {}
    for r in impact.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=100, group_queries=4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    data = whole(rows)
    want = brute_top(data, [(i, e) for i, e in data if i % 50 == 0], 5)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want


@pytest.mark.parametrize("size", [3e5, 1e6, 2.0 ** 40])
def test_top_k_of_large_components(spark, size):
    """Sums that doubles do not hold exactly: ties and near ties are told apart by whole numbers."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in np.round(rng.normal(size=6) * size)]) for i in range(150)]
    rows += [(200 + i, [rows[i][1][0] + 1 / 256, *rows[i][1][1:]]) for i in range(40)]
    if size > 1e10:  # keep scores within 64 bits, components far beyond
        rows = [(i, [e[0], *[0.0] * 5]) if i % 50 else (i, [2.0 ** -8, *[0.0] * 5]) for i, e in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in impact.top_k(df, df.where("vec_id % 50 = 0"), 5, shard_rows=40).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    data = whole(rows)
    want = brute_top(data, [(i, e) for i, e in data if i % 50 == 0], 5)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == {
        q: pairs for q, pairs in want.items()}


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in impact.top_k(df, df, 5).orderBy("query_id").collect()]
    assert got == [(0, 1, 50, 256 * 128 + 512 * 128), (50, 1, 0, 256 * 128 + 512 * 128)]
    assert impact.top_k(df.limit(0), df, 5).count() == 0
    assert impact.top_k(df, df.limit(0), 5).count() == 0


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = ([bytes([x]) for x in rng.integers(97, 101, rng.integers(0, 70))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert latent.common_length(latent.bit_rows(a), len(a), b) == table[-1, -1]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    pool = [f"t{i}" for i in range(3000)]
    draw = lambda n: list(rng.choice(pool, n, p=zipf))
    zipf = 1 / np.arange(1, 3001)
    zipf /= zipf.sum()
    items = [draw(int(n)) for n in rng.integers(12, 60, 40)]
    docs, want = [], set()
    for d in range(300):
        words = draw(int(rng.integers(5, 300)))
        if d % 6 == 0:
            item = items[d // 6 % 40]
            passage = list(item)
            if d % 12 == 0:  # a paraphrase: every eighth word replaced
                passage[3::8] = draw(len(passage[3::8]))
            at = int(rng.integers(0, len(words)))
            words = words[:at] + passage + words[at:]
            want.add((d, d // 6 % 40))
        docs.append((d, " ".join(words).title(), "en", 0.0))
    docs += [(900, None, "en", 0.0), (901, "", "en", 0.0), (None, " ".join(items[0]), None, None)]
    docs.append(docs[0])
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, lcs double")
    bench = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate(items)] + [(98, None), (99, ""), (97, "t0 t1")],
        "item_id long, text string")
    return frame, bench, want


def test_leaks_and_nothing_else(corpus):
    docs, bench, want = corpus
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).where("item_id < 97").collect()}
    assert want - got == set()
    assert got - want == {(None, 0)}


def test_filter_keeps_clean_documents(corpus):
    docs, bench, want = corpus
    bench = bench.where("item_id < 97")
    kept = latent.without_leaks(docs, bench)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns
    assert set(range(300)) - set(ids) == {d for d, _ in want} and None not in ids
    assert {900, 901} <= set(ids)


def test_without_items_or_documents(corpus):
    docs, bench, _ = corpus
    assert latent.leaks(docs, bench.limit(0)).count() == 0
    assert latent.leaks(docs.limit(0), bench).count() == 0
    assert latent.without_leaks(docs, bench.limit(0)).count() == docs.count()


def test_singular_vectors_of_a_small_matrix(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice([f"a{i}" for i in range(12)], 16)) for _ in range(50)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    items = [" ".join(f"a{i}" for i in range(12))]
    model = latent.decompose(docs, items, rank=3, extra=12)
    p = latent.Passages(texts, model["terms"], model["weight"], model["other"])
    own = latent.Passages(items, model["terms"], model["weight"], model["other"])
    a = p.times(np.eye(12))
    b = own.times(np.eye(12))
    assert np.allclose(p.transposed_times(a, 12), a.T @ a)
    values, vectors = np.linalg.eigh(a.T @ a + len(texts) * b.T @ b)
    for i in range(3):
        assert abs(model["basis"][:, i] @ vectors[:, -1 - i]) == pytest.approx(1, abs=1e-6)


def every_place(docs, items):
    """(document, item) pairs that the deciding rule accepts at some block."""
    out = set()
    for d, text in docs:
        words = latent.words_of(text or "")
        for i, item in items:
            own = latent.words_of(item)
            if own and any(latent.verdict(words, own, at)[2] for at in range(0, len(words), latent.BLOCK)):
                out.add((d, i))
    return out


def test_all_paraphrases_that_the_rule_accepts(spark):
    rng = np.random.default_rng(9)
    pool = [f"p{i}" for i in range(4000)]
    zipf = 1 / np.arange(1, 4001)
    draw = lambda n: list(rng.choice(pool, n, p=zipf / zipf.sum()))
    items = [(i, " ".join(draw(int(n)))) for i, n in enumerate(rng.integers(12, 60, 30))]
    docs = []
    for d in range(240):
        passage = items[d % 30][1].split()
        n = len(passage)
        gone = (range(0, n, 4), rng.permutation(n - 8)[:n // 2], range(0, n - 8, 2), range(0, n, 2))[d // 60]
        for j in gone:
            passage[j] = f"x{rng.integers(10**6)}"
        around = [f"y{x}" for x in rng.integers(0, 10**6, 90)] if d % 2 else draw(90)
        at = int(rng.integers(0, 90))
        docs.append((d, " ".join(around[:at] + passage + around[at:])))
    want = every_place(docs, items)
    got = latent.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string"))
    assert len(want) > 150 and {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_a_leak_that_fills_a_third_of_the_rows(spark):
    rng = np.random.default_rng(10)
    item = [f"q{i}" for i in range(15)]
    other = [f"r{i}" for i in range(40)]
    fill = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
    hot = " ".join(fill(40) + item + fill(40))
    docs = [(i, hot if i % 3 == 0 else " ".join(fill(95))) for i in range(300)]
    got = latent.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(
        [(0, " ".join(item)), (1, " ".join(other))], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, 0) for i in range(0, 300, 3)}


def test_short_items_inside_longer_texts(spark):
    rng = np.random.default_rng(11)
    fill = lambda n: [f"z{x}" for x in rng.integers(0, 10**6, n)]
    items = [(n, " ".join(f"s{n}_{i}" for i in range(n))) for n in range(1, 8)]
    items.append((8, items[6][1]))
    docs = [(d, " ".join(fill(50) + items[d % 7][1].split() + fill(int(rng.integers(0, 60)))))
            for d in range(70)]
    docs += [(100, " ".join(fill(20) + items[6][1].split()[::-1] + fill(20))),
             (101, items[6][1].rsplit(" ", 1)[0]), (102, items[6][1].rsplit(" ", 1)[1])]
    got = latent.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                       spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, d % 7 + 1) for d in range(70)} | {(d, 8) for d in range(6, 70, 7)}
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want


def test_all_terms_are_indexed(spark, monkeypatch):
    monkeypatch.setattr(latent, "TERMS", 64)
    items = [(i, " ".join(["the", "of", *(f"u{i}_{j}" for j in range(20))])) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert len(latent.item_blocks(bench)) > 4
    docs = spark.createDataFrame([(i, f"a b c {text} d e f") for i, text in items], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent.leaks(docs, bench).collect()}
    assert got == {(i, i) for i in range(20)}


def test_words_by_arrow_are_those_of_python():
    odd = ["A b", "", "  C\td ", "\x0b\x0c\x1c\x1d\u0085 x", "ÄB cÉ d E", "\x00 a\x00B", "\n", "A\r\nb A", " "]
    terms = {w: i for i, w in enumerate(sorted({w for text in odd for w in latent.words_of(text)} - {b"x"}))}
    column = pa.array(odd * 3)
    for first, n in ((0, 27), (4, 11), (1, 1), (26, 1), (5, 0)):
        words = [latent.words_of(text) for text in column.slice(first, n).to_pylist()]
        ids, counts = latent.numbered(column.slice(first, n), terms)
        assert ids.tolist() == [terms.get(w, -1) for own in words for w in own]
        assert counts.tolist() == [len(own) for own in words]


def test_rule_by_numbers_is_the_verdict(monkeypatch):
    rng = np.random.default_rng(12)
    calls, whole = [], latent.common_rows
    monkeypatch.setattr(latent, "common_rows", lambda rows, n: calls.append(n) or whole(rows, n))
    found = parts = 0
    for n in (1, 3, 7, 8, 9, 15, 30, 61):
        item = rng.integers(0, 40, n)
        own = [b"%d" % w for w in item]
        mask = np.zeros(41, bool)
        for kind in range(8):
            ids = rng.integers(-1, 40, 400) if kind % 2 else np.where(rng.random(400) < 0.9, -1, rng.integers(0, 40, 400))
            for at in (20, 200, 380):
                planted = np.where(rng.random(n) < kind / 20, -1, item)[:400 - at]
                ids[at:at + len(planted)] = planted
            words = [b"%d" % w if w >= 0 else b"?" for w in ids]
            blocks = np.flatnonzero(rng.random(25) < 0.8)
            want = [(b, *latent.verdict(words, own, b * latent.BLOCK)) for b in blocks.tolist()]
            calls.clear()
            got = latent.Rule(item).leaks(ids, blocks, mask)
            assert got == [(b, share, answer) for b, share, answer, leak in want if leak]
            assert not mask.any()
            found += len(got)
            parts += len(calls)
    assert found > 300
    calls.clear()
    item = np.arange(30)
    ids = np.full(4000, -1)
    ids[100:130] = item
    got = latent.Rule(item).leaks(ids, np.arange(250), np.zeros(41, bool))
    assert [b for b, *_ in got] == [4, 5, 6, 7, 8, 9]
    assert 0 < len(calls) < 40  # of 2,005 parts, those with different words of the item are compared
