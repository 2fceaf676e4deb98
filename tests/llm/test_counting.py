"""Lengths, packing and language-model scores against plain Python on small tables."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from unimass.llm import langid, lattice, lengths, packing

SCHEMA = "doc_id long, text string, lang string, score double, key string, n long"
TEXTS = [
    "The cat sat on the mat.", "the cat sat", None, "", "   \n\t ", "naïve café 👍🏽 日本語",
    "x" * 5000, "word " * 3000, "The cat sat on the mat.", "<|endoftext|> and I'll  go\n\n",
    "tab\tand\x0bvertical\x0cfeed\rreturn", "İstanbul ß É",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", 0.5, "k", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id here", None, None, None, None)], SCHEMA)


def all_texts(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def reference_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda t: tokenizer.encode(t, add_special_tokens=False).ids


def test_histogram_and_suffix_sums(docs, reference_ids):
    sizes = [len(reference_ids(t)) for _, t in all_texts(docs)]
    got = lengths.suffix_sums(lengths.length_histogram(docs), block=16).collect()
    assert {r["n_tokens"]: r["n_docs"] for r in got} == collections.Counter(sizes)
    for r in got:
        n = r["n_tokens"]
        assert r["docs_from"] == sum(s >= n for s in sizes)
        assert r["tokens_from"] == sum(s for s in sizes if s >= n)
        assert r["docs_to"] == sum(s <= n for s in sizes)
        assert r["tokens_to"] == sum(s for s in sizes if s <= n)
        assert r["kept_tokens"] == sum(min(s, n) for s in sizes)


def test_limits_and_quantiles_between_lengths(docs, reference_ids):
    sizes = sorted(len(reference_ids(t)) for _, t in all_texts(docs))
    sums = lengths.suffix_sums(lengths.length_histogram(docs))
    for r in lengths.at_limits(sums, [0, 4, 100, 10**6]).collect():
        c = r["context"]
        assert r["kept_tokens"] == sum(min(s, c) for s in sizes)
        assert r["lost_tokens"] == sum(max(s - c, 0) for s in sizes)
        assert r["docs_cut"] == sum(s > c for s in sizes)
    for r in lengths.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        need = max(1, math.ceil(r["probability"] * len(sizes)))
        assert r["n_tokens"] == sizes[need - 1]


def test_empty_tables(docs):
    none = docs.limit(0)
    assert lengths.suffix_sums(lengths.length_histogram(none)).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert lattice.scores(none, F.lit(False)).count() == 0


def test_every_id_is_packed_once(docs, reference_ids):
    pieces = [r.asDict() for r in packing.pack_documents(docs, window=64, block_docs=5).collect()]
    want = collections.Counter()
    for doc_id, text in all_texts(docs):
        want[(doc_id, len(reference_ids(text)) + 1)] += 1
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[(p["doc_id"], p["doc_tokens"])].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(want)
    ids = {(d, len(reference_ids(t)) + 1): reference_ids(t) + [1] for d, t in all_texts(docs)}
    for key, n in want.items():
        assert sum(p["length"] for p in by_doc[key]) == n * key[1]
        for p in by_doc[key]:
            own = np.array(ids[key][p["start"]:p["start"] + p["length"]], "<u4")
            assert p["ids_crc32"] == zlib.crc32(own.tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
        assert sum(p["length"] for p in own) <= 64


def test_differencing_balances_and_raises_the_count():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 200, 400)
    loads = np.bincount(packing.difference(sizes, 12), sizes, 12)
    assert loads.max() - loads.min() <= 3
    assert packing.difference(np.array([8, 7, 6, 5, 4]), 2).tolist().count(0) in (2, 3)
    part = packing.balanced(np.array([60, 60, 60]), 100)  # two windows could not hold them
    assert len(set(part.tolist())) == 3
    assert packing.balanced(np.zeros(0, int), 10).tolist() == []


def test_little_padding():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 6000, 800)
    pieces = packing.pack(sizes, 2048)
    assert sum(p[2] for p in pieces) == sizes.sum()
    windows = len({p[3] for p in pieces})
    assert windows * 2048 - sizes.sum() < 2048


def brute_lattice(word, logp):
    """Sum over all segmentations, by recursion."""
    data = b" " + word
    best = [0.0] + [None] * len(data)
    total = [1.0] + [0.0] * len(data)
    for j in range(1, len(data) + 1):
        for i in range(j):
            if data[i:j] in logp:
                total[j] += total[i] * math.exp(logp[data[i:j]])
    return math.log10(total[-1]), best


def test_lattice_is_the_sum_over_segmentations(spark):
    pieces, logp = lattice.vocabulary_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    words = [b"the", b"cat", "naïve".encode(), b"a", b"internationalisation", "日本".encode(), b"x" * 60]
    df = spark.createDataFrame([(bytearray(w), 1) for w in words], "word binary, c long")
    table = dict(zip(pieces, logp))
    for r in lattice.marginals(df, pieces, logp).collect():
        assert r["logp10"] == pytest.approx(brute_lattice(bytes(r["word"]), table)[0], abs=1e-9)


def test_expected_uses_sum_to_whole_words():
    pieces = sorted({b" ", b"a", b"b", b" a", b"ab", b" ab", b"ba"})
    logp = np.log(np.full(len(pieces), 1 / len(pieces)))
    table = lattice.Pieces(pieces)
    words = [b"ab", b"aba", b"abab"]
    uses = sum(lattice.expected(data, np.ones(len(at)), table, logp) for at, data in lattice.by_length(words))
    covered = sum(u * len(p) for u, p in zip(uses, pieces))
    assert covered == pytest.approx(sum(len(w) + 1 for w in words))


def test_base_scores(docs):
    held = langid.fold_of("doc_id", 7) == 2
    got = lattice.scores(docs, held, chunk_bytes=4096).collect()
    rows = all_texts(docs)
    assert len(got) == len(rows)
    counts = collections.Counter()
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(text.encode().lower().split())
            counts[None] += 1
    under = sum(counts.values()) + len(counts) + 1
    want = collections.Counter()
    for doc_id, text in rows:
        words = [*text.encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 1) / under) for w in words)
        want[(doc_id, len(words), sum(counts[w] > 0 for w in words), round(base, 6))] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 6))
                               for r in got) == want
    assert {r["train_tokens"] for r in got} == {sum(counts.values())}
    assert all(np.isfinite(r["score"]) and r["score"] < 0 and r["lattice_score"] < 0 for r in got)


def test_scores_without_training(docs):
    got = lattice.scores(docs, F.lit(True)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in got)
    assert all(np.isfinite(r["score"]) for r in got)
