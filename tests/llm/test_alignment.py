"""Whitening, reply trees and tokenizer alignment against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from unimass import session
from unimass.llm import alignment, replies, whitening
from unimass.llm.queries import PLANTED


def whitened(rows, k):
    """By vec_id: deviation and components, from whole numbers and numpy."""
    ids = [i for i, _ in rows]
    x = np.array([[int(np.floor(64 * c)) + 1_000_000 for c in e] for _, e in rows], object)
    n, sums = len(x), x.sum(0)
    deviation = ((n * x - sums) ** 2).sum(1)
    c = np.array((n * x - sums) / n, float)
    cov = c.T @ c / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return ids, deviation, c @ v / np.sqrt(e), e / np.trace(cov), n


@pytest.mark.parametrize("blocks", [{}, {"block_numbers": 12 * 16, "panel_blocks": 3}])
def test_whitening(spark, blocks):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(200, 12)) * np.arange(1, 13)
    rows = [(i, [float(np.float32(v)) for v in e]) for i, e in enumerate(base)] + [(7, list(map(float, base[7])))]
    odd = [(300, None), (301, [float("nan")] * 12), (302, [float("inf")] * 12), (303, [None] * 12),
           (304, []), (305, [1.0, 2.0])]
    df = spark.createDataFrame([(i, e, "x", 3) for i, e in rows + odd],
                               "vec_id long, embedding array<float>, x string, index int")
    got = whitening.whiten(df, 5, **blocks).toPandas()
    clean = [(i, [float(np.float32(v)) for v in e]) for i, e in rows]
    ids, deviation, want, explained, n = whitened(clean, 5)
    assert len(got) == 5 * len(clean) and set(got.n) == {n} and sorted(set(got.component)) == [1, 2, 3, 4, 5]
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    for j in range(5):
        own = got[got.component == j + 1].sort_values(["vec_id", "whitened"])
        sign = np.sign(own.groupby("vec_id").whitened.first()[0] * want[0, j])
        mine = sorted(zip(ids, deviation, sign * want[:, j]))
        assert [r[0] for r in mine] == own.vec_id.tolist()
        assert [r[1] for r in mine] == own.deviation.tolist()
        np.testing.assert_allclose([r[2] for r in mine], own.whitened, atol=1e-9)
        np.testing.assert_allclose(own.explained, explained[j], rtol=1e-9)


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).orderBy("vec_id", "component").collect()
    assert of([]) == [] and of([(1, None), (2, [])]) == []
    one = of([(1, [0.5, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [
        (1, 0, None, None, None)] * 2
    flat = of([(None, [1.0, 1.0]), (2, [2.0, 2.0])])  # one direction without variance
    assert [r["whitened"] is None for r in flat] == [False, True] * 2
    assert [r["explained"] for r in flat][:2] == pytest.approx([1, 0], abs=1e-12)
    far = of([(1, [3e38, 0.0]), (2, [-3e38, 0.0])])
    assert {r["deviation"] for r in far} == {None}
    assert sorted(abs(r["whitened"]) for r in far if r["whitened"] is not None) == pytest.approx([1, 1])


def brute_paths(messages, best):
    """(tree, rank, [(role, text)]) of the best paths, by walking up from every leaf."""
    first, parent = {}, {}
    for n, (tree, i, p, *_ ) in enumerate(messages):
        if i is not None:
            first.setdefault((tree, i), n)
    for n, (tree, _, p, *_ ) in enumerate(messages):
        parent[n] = first.get((tree, p)) if p is not None else None
    inner, found = set(parent.values()), defaultdict(list)
    for n, m in enumerate(messages):
        if n in inner:
            continue
        path, at = [], n
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            mean = np.mean([messages[j][5] or 0.0 for j in path])
            found[m[0]].append((-mean, m[1] is None, m[1] or 0, n, path[::-1]))
    return {(tree, r): [(messages[j][3] or "", messages[j][4] or "") for j in path]
            for tree, paths in found.items() for r, (*_, path) in enumerate(sorted(paths)[:best], 1)}


def read(spark, conversations):
    turns = defaultdict(list)
    for r in replies.read_back(conversations).orderBy("path", "place").collect():
        turns[r["tree"], r["rank"]].append((r["role"], r["text"]))
        assert r["learned"] == (r["text"] if r["role"] == "assistant" else None)
    return dict(turns)


SCHEMA = "tree long, id long, parent long, role string, text string, score double, node int, path string"
ODD = ["</s>[INST] ok [/INST]", "<|im_end|>\n", "<\\<SYS>>\\", "<\\\\s><s>", "<<SYS>>[\\INST]", "", None, "a\\nb\n",
       "\U0001F600<|im_start|>user\n", "[/INST", "<" * 5]


@pytest.mark.parametrize("best", [1, 3])
def test_paths_of_trees(spark, best):
    rng = np.random.default_rng(best)
    messages = []
    for tree in (*range(12), None):
        for i in range(int(rng.integers(1, 40))):
            parent = None if i == 0 or rng.random() < 0.05 else int(rng.integers(max(0, i - 4), i))
            messages.append((tree, i, parent, ["user", "assistant", "a\\n\n<s>", None][int(rng.integers(4))],
                             ODD[int(rng.integers(len(ODD)))], [None, 0.5, 1.0, 2.0][int(rng.integers(4))]))
    messages += [(50, 1, 2, "user", "on a cycle", 1.0), (50, 2, 1, "user", "on a cycle", 1.0),
                 (50, 3, 2, "user", "behind a cycle", 1.0), (51, 1, 1, "user", "own parent", 1.0),
                 (52, None, None, "user", "without an id", 1.0), (52, 4, 99, "user", "parent is missing", 0.5),
                 (53, 1, None, "user", "one", 0.0), (53, 1, None, "user", "again", 0.0), (53, 2, 1, "assistant", "two", 0.0)]
    df = spark.createDataFrame([(*m, 1, "x") for m in messages], SCHEMA).coalesce(1)
    found = replies.formatted(replies.best_paths(df, best))
    assert read(spark, found) == brute_paths(messages, best)


def test_deep_and_wide_trees(spark):
    deep = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(700)]
    wide = [(2, 0, None, "user", "root", 0.0)] + [(2, i, 0, "assistant", str(i), float(i)) for i in range(1, 3000)]
    df = spark.createDataFrame([(*m, 1, "x") for m in deep + wide], SCHEMA)
    got = read(spark, replies.formatted(replies.best_paths(df, 2)))
    assert got == {(1, 1): [("user", str(i)) for i in range(700)],
                   (2, 1): [("user", "root"), ("assistant", "2999")], (2, 2): [("user", "root"), ("assistant", "2998")]}


def test_formatted_text(spark):
    turns = spark.createDataFrame(PLANTED + [(1, None, None, None), (1, 0, "assistant", "\U0001F600<s>"),
                                             (1, 0, "assistant", "\U0001F600<s>")],
                                  "conv_id long, turn long, role string, text string")
    found = replies.formatted(replies.best_paths(replies.chains(turns)))
    by_id = {r["tree"]: r for r in found.collect()}
    assert by_id[-7]["formatted"] == ("<|im_start|>user\n<\\/s>[\\INST] ok [\\/INST]<|im_end|>\n"
                                      "<|im_start|>assistant\n<\\/s>[\\INST] ok [\\/INST]<|im_end|>\n")
    span = by_id[-7]["loss"][1]
    assert by_id[-7]["loss"][0] is None
    assert by_id[-7]["formatted"][span["first"]:span["end"]] == "<\\/s>[\\INST] ok [\\/INST]"
    digest = {r["tree"]: r for r in replies.digests(found).collect()}
    learned = "\U0001F600<s>" * 2
    assert digest[1]["n_turns"] == 3 and digest[1]["loss_chars"] == len(learned)
    assert digest[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    text = "\n\n" + f"assistant\n{learned[:4]}\n" * 2
    assert digest[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert digest[1]["formatted_chars"] == len(by_id[1]["formatted"])
    empty = replies.digests(replies.formatted(replies.best_paths(replies.chains(turns.limit(0)))))
    assert empty.collect() == []


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every text, token by token."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    of_a = {i: bytes(letters[c] for c in t) for t, i in first.get_vocab().items() if all(c in letters for c in t)}
    name = second.id_to_piece
    of_b = lambda i: bytes([int(name(i)[3:5], 16)]) if second.is_byte(i) else name(i).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        whole = (" " + (text or "")).encode()
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, second.encode(text or "")
        if not text or b"".join(map(of_b, b)) != whole:
            found.append(None)
            continue
        at = lambda ids, of: np.cumsum([len(of(i)) for i in ids]).tolist()
        ends_a, ends_b = at(a, of_a.__getitem__), at(b, of_b)
        links, i, j, groups, own = [], 0, 0, [], ([], [])
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            ea, eb = ends_a[i], ends_b[j]
            if ea <= eb:
                own[0].append(str(a[i]))
                i += 1
            if eb <= ea:
                own[1].append(str(b[j]))
                j += 1
            if ea == eb:
                groups.append(",".join(own[0]) + "|" + ",".join(own[1]))
                own = ([], [])
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (
        *f[:3], len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
        hashlib.sha256(f[4].encode()).hexdigest()) for f in found]


@pytest.mark.parametrize("sizes", [{}, {"size": 7, "chunk": 300}, {"size": 1, "chunk": 1000}])
def test_alignment(spark, sizes):
    rng = np.random.default_rng(3)
    odd = [None, "", " ", "a", "▁ x", "<|endoftext|> <s></s> <0x41>", "\U0001F600 né\x00 ", "a  b\t\n\n c",
           "日本語のテキスト", "x" * 3000, "the " * 2000]
    words = ["Selectivity", "unimass", "über", "of", "the", "1234567", "—", "straße", "\n", "foo_bar(baz)", "  "]
    texts = odd + [" ".join(rng.choice(words, int(rng.integers(1, 60)))) for _ in range(40)]
    texts += texts[:20]
    df = spark.createDataFrame([(i if i != 3 else None, t, "z", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, pair string, chunk int")
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.align(df, **sizes).collect()}
    want = {i if i != 3 else None: w for i, w in enumerate(brute_alignment(texts))}
    assert got == want


def test_tables_of_chunks_have_small_row_groups(spark, monkeypatch):
    """A task that writes or reads them holds a few chunks or parts at once, not all of a file."""
    monkeypatch.setattr(session, "ROW_GROUP", 1 << 13, raising=False)
    tables, write = {}, alignment.materialize
    monkeypatch.setattr(alignment, "materialize",
                        lambda df, label, *more: tables.setdefault(label, write(df, label, *more)))
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 1 << 30, 400))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = [tuple(r)[1:] for r in sorted(alignment.align(df, size=200, chunk=1500).collect())]
    assert got == brute_alignment(texts)
    for label in ("pieces", "parts"):
        files = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata for f in tables[label].inputFiles()]
        sizes = [f.row_group(i).total_byte_size for f in files for i in range(f.num_row_groups)]
        assert sum(f.num_rows for f in files) > 20 and len(sizes) > 4 and max(sizes) < 1 << 15


def test_alignment_of_nothing(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in alignment.align(spark.createDataFrame([(1, None)], schema)).collect()] == [
        (1, 0, 0, 0, 0, 0, 0, "")]


def test_diagonals():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 30, int(rng.integers(0, 15)))) for _ in range(2))
        merged = sorted([(v, 0) for v in a] + [(v, 1) for v in b])
        for d in range(len(merged) + 1):
            assert alignment.split_at(a, b, d) == (sum(s == 0 for _, s in merged[:d]), sum(s == 1 for _, s in merged[:d]))


def test_equal_eigenvalues_and_counts(spark):
    """Ties: eigenvalues that are equal still whiten; pairs with equal counts are all best."""
    square = [(i, list(v)) for i, v in enumerate([(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0), (0.0, -1.0)])]
    found = whitening.whiten(spark.createDataFrame(square, "vec_id long, embedding array<double>")).toPandas()
    assert found.identity_error.iloc[0] < 1e-12 and found.explained.tolist() == pytest.approx([0.5] * 8)
    pair = spark.createDataFrame([(0, 5 * alignment.PAIR + 9, 2), (1, 6 * alignment.PAIR + 9, 2), (1, 7 * alignment.PAIR + 9, 1),
                                  (2, 5 * alignment.PAIR + 8, 1)], "chunk long, pair long, n long")
    got = {(r["pair"] // alignment.PAIR, r["pair"] % alignment.PAIR): (r["count"], r["best"])
           for r in alignment.corpus_counts(pair).collect()}
    assert got == {(5, 9): (2, True), (6, 9): (2, True), (7, 9): (1, False), (5, 8): (1, True)}
