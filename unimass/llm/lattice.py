"""Language-model scores: the marginal probability of a text over all its subword segmentations.

The pieces and their order come from an existing vocabulary; piece probabilities are fitted to the
training texts by expectation maximisation, starting from the vocabulary's scores. Pieces do not
cross words, so the lattice is run once for each distinct word of the corpus.

Documents are read in chunks of text. A chunk names its distinct words once, whatever the number
of its documents; counts and word scores are joined to these names and go back to the chunk. No
word table is ever broadcast, as vocabularies of words grow with the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import slices
from unimass.session import materialize

CHUNK_BYTES = 8 << 20
STEPS, PRIOR = 2, 1e-4  # rounds of expectation maximisation; share of the starting scores kept
DISCOUNT = 0.75  # taken from each word's count for the segmentations into pieces
LONGEST, BASE, SPREAD = 32, np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

CHUNKS = ("chunk long, doc_ids array<long>, held array<boolean>, ends array<long>, tokens binary, "
          "words array<binary>, counts array<long>")


class Numbering(dict):
    """Numbers for keys in the order they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def chunked(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the columns doc_id, held (null: neither held out nor learned from) and text.

    Words are runs of anything but ASCII white space, in ASCII lower case. A chunk numbers its
    words and holds each document as word numbers; counts are those of its training documents.
    """

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        numbers, doc_ids, held, ends, parts, learned, read = Numbering(), [], [], [], [], [], 0

        def chunk():
            seen = np.concatenate([p for p, use in zip(parts, learned) if use] or [np.zeros(0, np.uint32)])
            counts = np.bincount(seen.astype(np.int64), minlength=len(numbers))
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()),
                "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                "held": pa.array([held], pa.list_(pa.bool_())),
                "ends": pa.array([ends], pa.list_(pa.int64())),
                "tokens": pa.array([np.concatenate(parts).tobytes()], pa.binary()),
                "words": pa.array([list(numbers)], pa.list_(pa.binary())),
                "counts": pa.array([counts], pa.list_(pa.int64()))})

        for batch in slices(batches):
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                data = text.encode()
                ids = np.array(list(map(numbers.__getitem__, data.lower().split())), np.uint32)
                doc_ids.append(doc_id), held.append(bool(out)), ends.append(len(ids))
                parts.append(ids), learned.append(out is False)
                read += len(data)
            if read >= size:
                yield chunk()
                number, read = number + 1, 0
                numbers, doc_ids, held, ends, parts, learned = Numbering(), [], [], [], [], []
        if doc_ids:
            yield chunk()

    return docs.mapInArrow(run, CHUNKS)


def vocabulary_pieces(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes, a word's start as a blank, with log probabilities from the file's scores.

    The file's scores are the negative ranks of the pieces, read as a Zipf law. Every single byte
    is a piece, so that every word has a segmentation.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        piece = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:] and len(piece) <= LONGEST:
            weight[piece] = weight.get(piece, 0) + 1 / (2 - model.get_score(i))
    pieces = sorted(weight)
    p = np.array([weight[x] for x in pieces])
    return pieces, np.log(p / p.sum())


def fingerprint(data: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of the rows of a byte matrix, one column more than it has."""
    out = np.zeros((data.shape[0], data.shape[1] + 1), np.uint64)
    for i in range(data.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + data[:, i] + np.uint64(1)
    return out


class Pieces:
    """Look-up of many byte strings at once, by their hash, in open tables of numpy arrays."""

    def __init__(self, pieces: list[bytes]):
        self.longest = max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for i, piece in enumerate(pieces):
            keys[i] = fingerprint(np.frombuffer(piece, np.uint8)[None, :])[0, -1]
        self.tables, left, shift = [], np.arange(len(pieces)), 44
        while len(left):
            slots = np.full(1 << 20, -1, np.int32)
            at = ((keys[left] * SPREAD) >> np.uint64(shift)) & np.uint64((1 << 20) - 1)
            slots[at] = left
            self.tables.append((np.uint64(shift), slots))
            left, shift = left[slots[at] != left], shift - 7
        self.keys = keys

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        mixed = hashes * SPREAD
        for shift, slots in self.tables:
            at = slots[(mixed >> shift) & np.uint64((1 << 20) - 1)]
            out = np.where((at >= 0) & (self.keys[at] == hashes), at, out)
        return out


def by_length(words: list[bytes]):
    """(places, byte matrix) for the words of each length, a blank before each word."""
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        length = int(sizes[places[0]])
        for some in np.split(places, range(max(1, (1 << 20) // (length + 1)), len(places),
                                           max(1, (1 << 20) // (length + 1)))):
            data = np.frombuffer(b"".join([words[i] for i in some]), np.uint8).reshape(len(some), length)
            yield some, np.hstack([np.full((len(some), 1), 32, np.uint8), data])


def edges(data: np.ndarray, table: Pieces):
    """(start, end, rows, pieces) of all pieces in the words, by end and start."""
    prefix = fingerprint(data)
    power = [np.uint64(pow(int(BASE), i, 1 << 64)) for i in range(LONGEST + 1)]
    for end in range(1, data.shape[1] + 1):
        for start in range(max(0, end - table.longest), end):
            piece = table.find(prefix[:, end] - prefix[:, start] * power[end - start])
            rows = np.flatnonzero(piece >= 0)
            if len(rows):
                yield start, end, rows, piece[rows]


def forward(data: np.ndarray, table: Pieces, logp: np.ndarray, kept: list | None = None) -> np.ndarray:
    """Log-space forward recursion: the log sum over segmentations of each prefix of each word."""
    alpha = np.full((data.shape[0], data.shape[1] + 1), -np.inf)
    alpha[:, 0] = 0
    for start, end, rows, piece in edges(data, table):
        alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, start] + logp[piece])
        if kept is not None:
            kept.append((start, end, rows, piece))
    return alpha


def expected(data: np.ndarray, weight: np.ndarray, table: Pieces, logp: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words, each counted `weight` times."""
    found: list = []
    alpha = forward(data, table, logp, found)
    beta = np.full_like(alpha, -np.inf)
    beta[:, -1] = 0
    uses = np.zeros(len(logp))
    whole = alpha[:, -1]
    for start, end, rows, piece in sorted(found, key=lambda e: -e[1]):
        inside = logp[piece] + beta[rows, end]
        beta[rows, start] = np.logaddexp(beta[rows, start], inside)
        share = np.exp(alpha[rows, start] + inside - whole[rows])
        uses += np.bincount(piece, share * weight[rows], len(logp))
    return uses


def fit(words: DataFrame, path: str, steps: int = STEPS) -> tuple[list[bytes], np.ndarray]:
    """Pieces and their log probabilities, from words (word, c).

    Every step runs over all distinct training words; only sums per piece reach the driver. With
    no training text the vocabulary's own scores stay.
    """
    pieces, logp = vocabulary_pieces(path)
    prior = np.exp(logp)
    for _ in range(steps):
        def run(batches, logp=logp):
            table, uses = Pieces(pieces), np.zeros(len(pieces))
            for batch in batches:
                n = batch.column("c").to_numpy().astype(float)
                for places, data in by_length(batch.column("word").to_pylist()):
                    uses += expected(data, n[places], table, logp)
            at = np.flatnonzero(uses)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int64()), "uses": uses[at]})

        sums = words.where("c > 0").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(
            F.sum("uses").alias("uses")).toPandas()
        total = sums["uses"].sum()
        if total <= 0:
            break
        share = np.zeros(len(pieces))
        share[sums["piece"].to_numpy()] = sums["uses"].to_numpy() / total
        logp = np.log((1 - PRIOR) * share + PRIOR * prior)
    return pieces, logp


def marginals(words: DataFrame, pieces: list[bytes], logp: np.ndarray) -> DataFrame:
    """words with logp10, the log10 of each word's probability over all segmentations.

    Only a word's first piece starts with a blank, so that these sum to one over all words.
    """

    def run(batches):
        table = Pieces(pieces)
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for places, data in by_length(batch.column("word").to_pylist()):
                out[places] = forward(data, table, logp)[:, -1] / np.log(10)
            yield pa.RecordBatch.from_pydict({
                "word": batch.column("word"), "c": batch.column("c"), "logp10": out})

    return words.mapInArrow(run, "word binary, c long, logp10 double")


def scores(docs: DataFrame, held_out, path: str | None = None, steps: int = STEPS,
           chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score).

    `held_out` is a condition on docs; rows for which it is false are learned from, and where it is
    null a row is scored but teaches nothing. All scores are log10 and count one end for each text.
    base_score is an add-one word model. lattice_score sums over the segmentations into pieces
    alone. In score the lattice of a word has one more edge, the whole word, by its discounted
    count; what the discount takes goes to the pieces. A null text is an empty one, repeated rows
    count each time, and an empty table gives none.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    chunks = materialize(chunked(docs.select("doc_id", held_out.alias("held"), text), chunk_bytes), "chunks")
    named = chunks.select("chunk", "counts", F.posexplode("words").alias("place", "word"))
    words = materialize(named.select("word", F.col("counts")[F.col("place")].alias("n")).groupBy(
        "word").agg(F.sum("n").alias("c")), "words")
    size = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n_docs = docs.where(~held_out).count()
    tokens, distinct = size[0] + n_docs, size[1] + (n_docs > 0)
    pieces, logp = fit(words, path, steps)
    valued = named.select("chunk", "place", "word").join(marginals(words, pieces, logp), "word").select(
        "chunk", "place", "c", "logp10")
    under = tokens + distinct + 1
    end = n_docs / tokens if tokens > n_docs > 0 else 0.5
    base_end, end10, word10 = np.log10((n_docs + 1) / under), np.log10(end), np.log10(1 - end)
    seen = max(size[0], 1)
    to_pieces = np.log10(DISCOUNT * size[1] / seen) if size[1] else 0.0

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        at = right["place"].to_numpy()
        count, value = np.zeros(len(at), np.int64), np.zeros(len(at))
        count[at], value[at] = right["c"].to_numpy(), right["logp10"].to_numpy()
        base = np.log10((count + 1) / under)
        mixed = np.logaddexp(np.log(np.maximum(count - DISCOUNT, 1e-300) / seen),
                             (value + to_pieces) * np.log(10)) / np.log(10)
        for row in left.to_pylist():
            ids = np.frombuffer(row["tokens"], np.uint32)
            ends = np.array(row["ends"], np.int64)
            doc = np.repeat(np.arange(len(ends)), ends)
            summed = lambda v: np.bincount(doc, v[ids], len(ends))
            parts.append(pa.table({
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(row["held"], pa.bool_()),
                "n_tokens": ends + 1,
                "n_known": summed((count > 0).astype(float)).astype(np.int64) + int(n_docs > 0),
                "train_tokens": pa.array([tokens] * len(ends), pa.int64()),
                "base_score": summed(base) + base_end, "score": summed(mixed + word10) + end10,
                "lattice_score": summed(value + word10) + end10}))
        return pa.concat_tables(parts)

    documents = chunks.select(F.col("chunk").alias("own"), "doc_ids", "held", "ends", "tokens")
    return documents.groupBy("own").cogroup(valued.groupBy("chunk")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
             "base_score double, score double, lattice_score double")
