"""Benchmark decontamination by latent semantic retrieval.

Passages are overlapping pairs of word blocks. Their TF-IDF matrix over the benchmark's terms gets
a randomised singular value decomposition: tasks multiply their passages with thin matrices, sums
of terms x rank are all that is gathered. Passages close to a benchmark passage in the latent space
are candidates, and so is every place with as many of an item's words as the deciding rule needs at
least: what the latent space loses is found by count, whatever the words' weights. A longest common
subsequence with the item, and a check of its closing words, decides.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import keep_rows, map_slices, slices, text_bytes, texts_of

BLOCK = 16          # words; a passage is two blocks
RANK, EXTRA = 40, 8
OFTEN, RAREST = 0.03, 4  # terms in a larger share of blocks are left out, but for each item's rarest
SHARE, CLOSE = 0.3, 0.65  # least share of benchmark terms in a passage's weight; least cosine
COMMON, LOOSE, ANSWER_WORDS, ANSWER = 0.75, 0.5, 8, 0.75
SHORT = 8           # items of fewer words must occur word for word
SELDOM = 0.002      # share of blocks up to which a term may add to the hits that a place must have
ITEM_BLOCK = 20_000  # items searched in one pass over the documents
TERMS = 1 << 18      # words of one such block, about; a longer item is a block of its own
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
CHUNK = 512          # blocks multiplied at once, so that products stay in a core's cache


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, in ASCII lower case."""
    return text.encode().lower().split()


def numbered(texts, terms: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The term number of every word of some texts in a row, -1 for none, and the words of each text.

    Words are those of words_of(). The bytes are copied: Arrow's string functions err on slices.
    """
    data, bounds = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    lowered = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(LOWER[data]))
    trimmed = pc.ascii_trim_whitespace(lowered)
    words = pc.ascii_split_whitespace(trimmed)
    counts = pc.list_value_length(words).to_numpy().astype(np.int64)
    ids = pc.index_in(words.flatten().cast(pa.large_binary()), pa.array(list(terms), pa.large_binary()))
    empty = pc.equal(trimmed, "").to_numpy(zero_copy_only=False)  # split into one empty word
    return np.delete(pc.fill_null(ids, -1).to_numpy(), np.cumsum(counts)[empty] - 1), counts - empty


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(sizes.sum())) + np.repeat(starts - ends + sizes, sizes)


def laid_out(ids: np.ndarray, counts: np.ndarray):
    """Term numbers of the known words, the block of each, the words and the document of each block."""
    blocks = -(-counts // BLOCK)
    at = np.flatnonzero(ids >= 0)
    starts, first = np.cumsum(counts) - counts, np.cumsum(blocks) - blocks
    doc = np.searchsorted(starts, at, side="right") - 1  # a text without words starts where the next does
    block = first[doc] + (at - starts[doc]) // BLOCK
    of_block = np.repeat(np.arange(len(counts)), blocks)
    size = np.full(len(of_block), BLOCK)
    held = blocks > 0
    size[(first + blocks - 1)[held]] = (counts - (blocks - 1) * BLOCK)[held]
    return ids[at].astype(np.int64), block, size, of_block


def paired(values: np.ndarray, of_block: np.ndarray) -> np.ndarray:
    """Each block's value plus that of the next block of the same document."""
    out = values.copy()
    same = of_block[:-1] == of_block[1:]
    out[:-1][same] += values[1:][same]
    return out


class Passages:
    """The passages of some texts as a sparse matrix over terms."""

    def __init__(self, texts, terms: Collection[bytes], weight: np.ndarray, other: float):
        self.ids, self.counts = numbered(texts, terms)
        self.term, self.block, size, self.of_block = laid_out(self.ids, self.counts)
        n = len(self.of_block)
        rest = paired((size - np.bincount(self.block, minlength=n)) * other, self.of_block)
        indexed = weight[self.term] > 0
        self.term, self.block = self.term[indexed], self.block[indexed]
        self.weight = weight
        mass = paired(np.bincount(self.block, (weight**2)[self.term], n), self.of_block)
        self.share = mass / np.maximum(mass + rest, 1e-12)
        self.scale = 1 / np.sqrt(np.maximum(mass + rest, 1e-12))

    def times(self, thin: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """passages x columns, or only the wanted passages."""
        n = len(self.of_block)
        need = np.ones(n, bool) if wanted is None else np.zeros(n, bool)
        if wanted is not None:
            need[wanted] = True
            need[1:] |= need[:-1].copy()  # a passage reads the next block too
        use = need[self.block]
        term, block = self.term[use], self.block[use]
        out, weighted = np.zeros((n, thin.shape[1])), thin * self.weight[:, None]
        starts = np.flatnonzero(np.diff(block, prepend=-1))
        for i in range(0, len(starts), CHUNK):
            own = starts[i:i + CHUNK]
            end = starts[i + CHUNK] if i + CHUNK < len(starts) else len(term)
            out[block[own]] = np.add.reduceat(weighted[term[own[0]:end]], own - own[0])
        out = paired(out, self.of_block) * self.scale[:, None]
        return out if wanted is None else out[wanted]

    def transposed_times(self, tall: np.ndarray, terms: int) -> np.ndarray:
        """terms x columns"""
        out = np.zeros((terms, tall.shape[1]))
        if len(self.term):
            scaled = tall * self.scale[:, None]
            both = scaled.copy()
            same = self.of_block[:-1] == self.of_block[1:]
            both[1:][same] += scaled[:-1][same]
            small = terms <= 1 << 16  # numbers of two bytes are sorted by their digits
            order = np.argsort(self.term.astype(np.uint16) if small else self.term, kind="stable")
            term, block = self.term[order], self.block[order]
            for i in range(0, len(term), CHUNK * BLOCK):
                own = term[i:i + CHUNK * BLOCK]
                starts = np.flatnonzero(np.diff(own, prepend=-1))
                out[own[starts]] += np.add.reduceat(both[block[i:i + CHUNK * BLOCK]], starts)
        return out * self.weight[:, None]


def summed(docs: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]], rows: int,
           columns: int) -> np.ndarray:
    """The sum over all texts of a rows x columns matrix, summed by row on the way to the driver."""

    def run(batches):
        fn, total = make(), np.zeros((rows, columns))
        for batch in slices(batches):
            total += fn(batch.column("text"))
        at = np.flatnonzero(total.any(1))
        values = pa.FixedSizeListArray.from_arrays(total[at].ravel(), columns).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_pydict({"row": pa.array(at, pa.int64()), "v": values})

    parts = texts_of(docs).mapInArrow(run, "row long, v array<double>")
    sums = parts.groupBy("row").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(columns)]).alias("v"))
    out = np.zeros((rows, columns))
    for batch in sums.toArrow().to_batches():
        if batch.num_rows:
            out[batch.column("row").to_numpy()] = np.asarray(
                batch.column("v").flatten()).reshape(-1, columns)
    return out


def decompose(docs: DataFrame, items: list[str], rank: int = RANK, extra: int = EXTRA, seed: int = 5) -> dict:
    """Terms, their weights and the leading right singular vectors of the passages' TF-IDF matrix.

    Columns are the terms of the items: no other can bring a passage closer to an item, all others
    count in a passage's length. The items are rows as well, with as much energy as all passages,
    so that their own terms are not lost among those of the corpus.
    """
    terms = {w: i for i, w in enumerate(sorted({w for item in items for w in words_of(item)}))}
    m = len(terms)

    def frequency():
        def run(texts):
            ids, block, _, of_block = laid_out(*numbered(texts, terms))
            pairs = np.sort(block * (m + 1) + ids)
            seen = np.bincount(pairs[np.diff(pairs, prepend=-1) > 0] % (m + 1), minlength=m + 1)
            seen[m] = len(of_block)
            return seen[:, None]
        return run

    seen = summed(docs, frequency, m + 1, 1)[:, 0]
    blocks = max(seen[m], 1)
    weight = np.log((blocks + 1) / (seen[:m] + 1)) + 0.1
    kept = seen[:m] <= OFTEN * blocks
    for item in items:
        own_terms = sorted({terms[w] for w in words_of(item) if w in terms}, key=lambda t: (-weight[t], t))
        kept[own_terms[:RAREST]] = True
    weight = np.where(kept, weight, 0.0)
    other = float(np.median(weight[kept]) ** 2) if m else 1.0
    width = min(rank + extra, m)
    own = Passages(items, terms, weight, other)
    boost = blocks / max(len(own.of_block), 1)

    def applied(thin):
        def make():
            def run(texts):
                p = Passages(texts, terms, weight, other)
                return p.transposed_times(p.times(thin), m)
            return run
        return summed(docs, make, m, thin.shape[1]) + boost * own.transposed_times(own.times(thin), m)

    model = {"terms": terms, "weight": weight, "other": other, "basis": np.zeros((m, 0)),
             "often": seen[:m] / blocks}
    if width:
        # one pass: A'A is approximated from its image of a random start (Nystroem)
        start, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((m, width)))
        image = applied(start)
        shift = 1e-12 * max(np.linalg.norm(image), 1e-300)
        image += shift * start
        inner = start.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        root = turn / np.sqrt(np.maximum(values, shift))
        left, _, _ = np.linalg.svd(image @ root, full_matrices=False)
        model["basis"] = left[:, :rank]
    return model


def common_length(positions: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit rows; positions has a bit row for each word."""
    return common_rows([positions[w] for w in words if w in positions], length)


def common_rows(rows: list[int], length: int) -> int:
    """The same, of the bit rows of the words that have one."""
    ones = (1 << length) - 1
    state = ones
    for hit in rows:
        kept = state & hit
        state = ((state + kept) | (state - kept)) & ones
    return length - state.bit_count()


def bit_rows(words: list) -> dict:
    out: dict = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def verdict(words: list[bytes], item: list[bytes], first: int) -> tuple[float, bool, bool]:
    """Share of the item in order around word `first`, whether its close is there, and a leak or not."""
    n = len(item)
    near = words[max(0, first - n):first + 2 * BLOCK + n]
    if n < SHORT:
        held = b" %b " % b" ".join(item) in b" %b " % b" ".join(near)
        return float(held), held, held
    rows, close = bit_rows(item), item[-ANSWER_WORDS:]
    close_rows, span, best = bit_rows(close), n + n // 2, (0.0, False)
    for start in range(0, max(1, len(near) - span + n // 4), n // 4):  # long gaps are no paraphrase
        part = near[start:start + span]
        share = common_length(rows, n, part) / n
        if share >= LOOSE:
            answer = common_length(close_rows, len(close), part) >= ANSWER * len(close)
            best = max(best, (share, answer))
    share, answer = best
    return share, answer, share >= COMMON or (share >= LOOSE and answer)


class Rule:
    """verdict() of an item by term numbers, for many places of a document at once."""

    def __init__(self, item: np.ndarray):
        self.item, self.n = item, len(item)
        self.need = -int(-LOOSE * self.n // 1)
        words = item.tolist()
        self.rows, self.close, self.close_rows = bit_rows(words), words[-ANSWER_WORDS:], bit_rows(words[-ANSWER_WORDS:])

    def leaks(self, ids: np.ndarray, blocks: np.ndarray, mask: np.ndarray) -> list[tuple[int, float, bool]]:
        """(block, share, answer) of the blocks, in rising order, around which the item leaks.

        `mask` is false for all terms, and left so. A part with fewer words of the item than a leak
        needs is none; parts with the same of its words are compared once.
        """
        n = self.n
        low = np.maximum(0, blocks * BLOCK - n)
        high = np.minimum(len(ids), (blocks + 2) * BLOCK + n)
        if n < SHORT:
            return [(b, 1.0, True) for b, x, y in zip(blocks.tolist(), low.tolist(), high.tolist())
                    if n and any((ids[at:at + n] == self.item).all() for at in range(x, y - n + 1))]
        span, step = n + n // 2, n // 4
        mask[self.item] = True
        at = np.flatnonzero(mask[ids[low[0]:high[-1]]]) + low[0]
        mask[self.item] = False
        parts = -(-np.maximum(1, high - low - span + step) // step)
        of = np.repeat(np.arange(len(blocks)), parts)
        start = low[of] + ranges(np.zeros(len(parts), np.int64), parts) * step
        first, last = np.searchsorted(at, start), np.searchsorted(at, np.minimum(start + span, high[of]))
        held = np.flatnonzero(last - first >= self.need)
        words = ids[at].tolist() if len(held) else []
        known: dict[tuple[int, int], tuple[float, bool]] = {}
        best: dict[int, tuple[float, bool]] = {}
        for b, x, y in zip(blocks[of[held]].tolist(), first[held].tolist(), last[held].tolist()):
            if (x, y) not in known:
                part = words[x:y]
                share = common_rows([self.rows[w] for w in part], n) / n
                known[x, y] = share, share >= LOOSE and common_length(
                    self.close_rows, len(self.close), part) >= ANSWER * len(self.close)
            if known[x, y][0] >= LOOSE:
                best[b] = max(best.get(b, (0.0, False)), known[x, y])
        return [(b, share, answer) for b, (share, answer) in best.items() if share >= COMMON or answer]


class Counts:
    """All places that the deciding rule could accept, by the number of an item's words there.

    A leak has LOOSE of the item's n words in a part of n + n // 2 words. Of the item's words all
    but the most common may be watched: where `need` words have to be there and `left` are not
    watched, need - left of the watched ones are. How often a term occurs decides which words are
    watched, not what is found.
    """

    def __init__(self, items: list[list[bytes]], terms: dict[bytes, int], often: np.ndarray):
        self.items, self.own = items, [np.array([terms[w] for w in words], np.int64) for words in items]
        self.need = [-int(-LOOSE * len(words) // 1) for words in items]
        self.span = np.array([len(words) + len(words) // 2 for words in items], np.int64)
        self.least = np.ones(len(items), np.int64)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by length: sorted keys, their items
        short: dict[int, list[tuple[int, int]]] = {}
        watched: list[tuple[int, int]] = []
        for i, words in enumerate(items):
            n = len(words)
            if n < SHORT:
                if n:
                    short.setdefault(n, []).append((int(self.gram_keys(self.own[i], n)[0]), i))
                continue
            rare = sorted((often[terms[w]], terms[w]) for w in words)
            least = 1
            while least < self.need[i] and rare[n - self.need[i] + least][0] <= SELDOM:
                least += 1
            self.least[i] = least
            watched += [(t, i) for t in {t for _, t in rare[:n - self.need[i] + least]}]
        watched.sort()
        self.of = np.array([i for _, i in watched], np.int64)
        self.bounds = np.searchsorted(np.array([t for t, _ in watched], np.int64), np.arange(len(terms) + 1))

        for n, rows in short.items():
            rows.sort()
            self.grams[n] = np.array([k for k, _ in rows], np.uint64), np.array([i for _, i in rows], np.int64)

    @staticmethod
    def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash of every n words in a row; equal words have equal hashes."""
        out = np.zeros(max(len(ids) - n + 1, 0), np.uint64)
        for i in range(n):
            out = (out + ids[i:i + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def short_items(self, ids: np.ndarray, counts: np.ndarray):
        """(document, item, word) where an item of under SHORT words may stand word for word."""
        ends = np.cumsum(counts)
        for n, (keys, of) in self.grams.items():
            own = self.gram_keys(ids, n)
            first, last = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            at = np.flatnonzero(last > first)
            doc = np.searchsorted(ends, at, side="right")
            inside = at + n <= ends[doc]
            for d, a in zip(doc[inside].tolist(), at[inside].tolist()):
                for i in of[first[a]:last[a]].tolist():
                    yield d, i, a - int(ends[d] - counts[d])

    def hits(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, word) where the first of enough watched words of an item stands."""
        at = np.flatnonzero(ids >= 0)
        first = self.bounds[ids[at]]
        many = self.bounds[ids[at] + 1] - first
        at, first, many = at[many > 0], first[many > 0], many[many > 0]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        item, at = self.of[np.repeat(first, many) + step], np.repeat(at, many)
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        starts = np.cumsum(counts) - counts
        doc = np.searchsorted(starts, at, side="right") - 1
        last = np.arange(len(at)) + self.least[item] - 1
        held = last < len(at)
        last = np.where(held, last, 0)
        held &= (item[last] == item) & (doc[last] == doc) & (at[last] - at < self.span[item])
        return doc[held], item[held], (at - starts[doc])[held]

    def places(self, ids: np.ndarray, counts: np.ndarray, mask: np.ndarray):
        """(document, item, block) of the blocks around which a part may be accepted, some more than once.

        `mask` is false for all terms, and left so.
        """
        doc, item, at = self.hits(ids, counts)
        ends = np.cumsum(counts)
        starts = ends - counts
        found = [np.zeros((3, 0), np.int64)]
        bounds = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            i, d = int(item[x]), doc[x:y]
            span, need, n = int(self.span[i]), self.need[i], len(self.items[i])
            low = np.maximum(starts[d], starts[d] + at[x:y] - span + 1)
            high = np.minimum(ends[d], starts[d] + at[x:y] + span)
            low[1:] = np.maximum(low[1:], high[:-1])  # each word once
            size = np.maximum(high - low, 0)
            near, d = ranges(low, size), np.repeat(d, size)
            mask[self.own[i]] = True
            here = mask[ids[near]]
            mask[self.own[i]] = False
            near, d = near[here] - starts[d[here]], d[here]
            first, last = near[:max(0, len(near) - need + 1)], near[need - 1:]
            held = np.flatnonzero((last - first < span) & (d[need - 1:] == d[:len(first)]))
            first, last, d = first[held], last[held], d[held]
            # the blocks of which verdict() reads both ends
            left = np.maximum(0, -(-(last + 1 - 2 * BLOCK - n) // BLOCK))
            right = np.minimum((counts[d] - 1) // BLOCK, (first + n) // BLOCK)
            size = np.maximum(right - left + 1, 0)
            d = np.repeat(d, size)
            found.append(np.stack([d, np.full(len(d), i), ranges(left, size)]))
        once = {}
        for d, i, a in self.short_items(ids, counts):
            once.setdefault((d, i), a // BLOCK)  # one place is enough
        found += [np.array([[d], [i], [block]]) for (d, i), block in once.items()]
        return np.concatenate(found, axis=1)


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, lcs, answer, cosine, first_word): items found in documents.

    One row for each document and item with a leak, at its best place. Null or empty texts on
    either side hold nothing and match nothing, repeated rows of documents are one document, null
    ids are kept as null, and without items or documents the result is empty. Items are taken in
    blocks of ITEM_BLOCK, one pass over the documents each, so that what tasks receive is bounded.
    """
    found = None
    for items in item_blocks(benchmark):
        some = searched(docs, items, rank)
        found = some if found is None else found.union(some)
    best = F.max(F.struct("lcs", "answer", "cosine", (-F.col("first_word")).alias("back"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.lcs", "b.answer", "b.cosine", (-F.col("b.back")).alias("first_word"))


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The items by a hash of their text, in blocks of about ITEM_BLOCK and TERMS words; one at least.

    A passage's own terms are never left out: more text means more blocks and more passes.
    """
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = F.size(F.split(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " ")), " "))
    count, words = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    n = max(1, -(-count // ITEM_BLOCK), -(-words // TERMS))
    return [sorted((tuple(r) for r in rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i).collect()),
                   key=lambda r: (r[0] is None, r)) for i in range(n)]


def searcher(docs: DataFrame, items: list[tuple[int, str]], rank: int):
    """A function from texts to leaks (text number, item_id, lcs, answer, cosine, first_word)."""
    model = decompose(docs, [text for _, text in items], rank)
    terms, weight, other, basis = (model[k] for k in ("terms", "weight", "other", "basis"))
    own = Passages([text for _, text in items], terms, weight, other)
    targets = unit(own.times(basis))
    counted = Counts([words_of(text) for _, text in items], terms, model["often"])
    rules: dict[int, Rule] = {}

    def search(texts):
        if not terms:
            return []
        p = Passages(texts, terms, weight, other)
        ends = np.cumsum(p.counts)
        first = np.searchsorted(p.of_block, np.arange(len(p.counts)))  # a document's first block
        held = np.flatnonzero(p.share >= SHARE)
        thin = unit(p.times(basis, held))
        near = [np.zeros((3, 0), np.int64)]
        for i in range(0, len(held), 4096):
            at, target = np.nonzero(thin[i:i + 4096] @ targets.T >= CLOSE)
            block = held[i + at]
            doc = p.of_block[block]
            near.append(np.stack([doc, own.of_block[target], block - first[doc]]))
        mask = np.zeros(len(terms) + 1, bool)  # -1, no term, is its last place
        near.append(counted.places(p.ids, p.counts, mask))
        doc, item, block = np.concatenate(near, axis=1)
        order = np.lexsort((block, item, doc))
        doc, item, block = doc[order], item[order], block[order]
        bounds = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(item, prepend=-1) != 0)).tolist()
        found = []
        for x, y in zip(bounds, [*bounds[1:], len(doc)]):
            d, i = int(doc[x]), int(item[x])
            if i not in rules:
                rules[i] = Rule(counted.own[i])
            ids = p.ids[ends[d] - p.counts[d]:ends[d]]
            found += [(d, i, *leak) for leak in rules[i].leaks(ids, np.unique(block[x:y]), mask)]
        thin = unit(p.times(basis, np.array([first[d] + b for d, _, b, *_ in found], np.int64)))
        return [(d, items[i][0], share, answer, float((targets[own.of_block == i] @ row).max()), b * BLOCK)
                for (d, i, b, share, answer), row in zip(found, thin)]

    return search


def searched(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> DataFrame:
    """Leaks of one block of items, several for a document and item where they are found twice."""
    search = searcher(docs, items, rank)

    def make():
        def run(batch):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[d], *rest) for d, *rest in search(batch.column("text"))]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.float64(), pa.int64())
            names = ("doc_id", "item_id", "lcs", "answer", "cosine", "first_word")
            return {n: pa.array(v, k) for n, v, k in zip(names, columns, kinds)}
        return run

    return map_slices(texts_of(docs, "doc_id"), make, "doc_id long, item_id long, lcs double, "
                      "answer boolean, cosine double, first_word long")


def without_leaks(docs: DataFrame, benchmark: DataFrame, rank: int = RANK) -> DataFrame:
    """docs without the rows that hold an item; all columns stay."""
    kept = docs
    for items in item_blocks(benchmark):
        search = searcher(docs, items, rank)

        def make(search=search):
            def clean(texts):
                mask = np.ones(len(texts), bool)
                mask[[d for d, *_ in search(texts)]] = False
                return mask
            return clean

        kept = keep_rows(kept, make)
    return kept
