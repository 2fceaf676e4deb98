"""Alignment of two tokenizers by merge-path partitioning of their token ends.

The ends of A's and B's tokens in a document are two rising lists over the same bytes. Diagonals of
their merge grid, each found by a binary search, cut the merge into pieces of equal work that need
nothing of each other: a piece knows the offsets it starts from and the tokens it starts in. Pieces
are kept in chunks of bounded size, the rows of a written table, so that any task can take any piece
of a document, however long. A piece emits the pairs of tokens that overlap and the groups that it
sees; groups that cross from piece to piece are stitched in a document's order.

A chunk names its distinct pairs of ids once; their counts over the corpus are joined to these
names, and go back to the chunk's pieces. No table of pairs is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import slices, texts_of
from unimass.llm.tokens import byte_encoding, vocabulary_path
from unimass.session import large_rows, materialize

PIECE, CHUNK = 1 << 16, 1 << 21  # merged ends of a piece; of a chunk, but for its last piece
PAIR = 1 << 20  # a pair of ids as one number: A's id times this plus B's

PIECES = ("row long, doc_id long, piece int, pieces int, n_a long, n_b long, a binary, b binary, "
          "own_a int, own_b int, from_a long, from_b long, last long")
CHUNKS = "chunk long, held binary"
PARTS = ("row long, doc_id long, piece int, pieces int, n_a long, n_b long, n_groups long, n_links long, "
         "n_best long, count_sum long, groups_sha256 string, ids binary, sides binary, cuts binary")


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def columns(rows: list[tuple], schema: pa.Schema) -> list[pa.Array]:
    return [pa.array([row[i] for row in rows], field.type) for i, field in enumerate(schema)]


def id_type(sizes) -> type:
    """Two bytes an id, where both vocabularies allow it."""
    return np.uint16 if max(map(len, sizes)) <= 1 << 16 else np.uint32


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.first = byte_encoding(path_a)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [self.first.decode_single_token_bytes(i) for i in range(self.first.n_vocab)]
        name = self.second.id_to_piece
        self.bytes_b = [bytes([int(name(i)[3:-1], 16)]) if self.second.is_byte(i) else name(i).replace(
            "▁", " ").encode() for i in range(self.second.get_piece_size())]

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each token of A and of B: a few 100 KB."""
        return np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids by A and by B of each text; none where the text is empty or its bytes do not come back."""
        kind = id_type((self.bytes_a, self.bytes_b))
        out, none = [], np.zeros(0, kind)
        for text, b in zip(texts, self.second.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            a = self.first.encode_to_numpy(" " + text, disallowed_special=())
            same = len(whole) > 1 and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole \
                and b"".join(map(self.bytes_b.__getitem__, b)) == whole
            out.append((a.astype(kind) if same else none, np.array(b, kind) if same else none))
        return out


def split_at(a: np.ndarray, b: np.ndarray, diagonal: int) -> tuple[int, int]:
    """How many of `a` and of `b` are among the first `diagonal` of their merge, a before equal b."""
    low, high = max(0, diagonal - len(b)), min(diagonal, len(a))
    while low < high:
        i = (low + high) // 2
        if a[i] <= b[diagonal - i - 1]:
            low = i + 1
        else:
            high = i
    return low, diagonal - low


def cut(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, size: int):
    """The pieces of a document: ids with the one beyond them, own counts, offsets, the end before."""
    total = len(a) + len(b)
    i = j = 0
    for diagonal in range(size, total + size, size):
        i1, j1 = split_at(ends_a, ends_b, min(diagonal, total))
        from_a, from_b = int(ends_a[i - 1]) if i else 0, int(ends_b[j - 1]) if j else 0
        yield a[i:i1 + 1], b[j:j1 + 1], i1 - i, j1 - j, from_a, from_b, max(from_a, from_b)
        i, j = i1, j1


def packed(rows: list[tuple], schema: pa.Schema) -> bytes:
    """Piece rows as one compressed Arrow stream: ids of many documents shrink better than those of one."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns(rows, schema), schema=schema))
    return sink.getvalue().to_pybytes()


def unpacked(held: pa.Scalar):
    """The piece rows of a chunk, a few at a time."""
    for batch in pa.ipc.open_stream(held.as_buffer()):
        for at in range(0, batch.num_rows, 64):
            yield from batch.slice(at, 64).to_pylist()


def chunks(docs: DataFrame, path_a: str, path_b: str, size: int = PIECE, chunk: int = CHUNK) -> DataFrame:
    """(chunk, held): the pieces of the merge of each document's ends; a document without tokens has one.

    A chunk is full at `chunk` merged ends, in the middle of a document if need be.
    """
    schema = arrow_schema(PIECES)

    def run(batches):
        known = Vocabularies(path_a, path_b)
        sizes_a, sizes_b = known.sizes()
        row = number = TaskContext.get().partitionId() << 32
        out, ends = [], 0

        def filled():
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()),
                                               "held": pa.array([packed(out, schema)], pa.binary())})

        for batch in slices(batches, 128, 1 << 20):
            for doc_id, (a, b) in zip(batch.column("doc_id").to_pylist(),
                                      known.encode(batch.column("text").to_pylist())):
                own = list(cut(a, b, sizes_a[a].cumsum(), sizes_b[b].cumsum(), size)) or [(a, b, 0, 0, 0, 0, 0)]
                for n, (ids_a, ids_b, n_a, n_b, *offsets) in enumerate(own):
                    out.append((row, doc_id, n, len(own), len(a), len(b), ids_a.tobytes(),
                                ids_b.tobytes(), n_a, n_b, *offsets))
                    ends += n_a + n_b + 1
                    if ends >= chunk:
                        yield filled()
                        number, out, ends = number + 1, [], 0
                row += 1
        if out:
            yield filled()

    return texts_of(docs, "doc_id").mapInArrow(run, CHUNKS)


class Merge:
    """What one piece sees: links (a, b), and its ends in merged order with the cuts after them."""

    def __init__(self, row: dict, sizes_a: np.ndarray, sizes_b: np.ndarray):
        kind = id_type((sizes_a, sizes_b))
        a, b = np.frombuffer(row["a"], kind), np.frombuffer(row["b"], kind)
        n_a, n_b = row["own_a"], row["own_b"]
        ends = np.concatenate([row["from_a"] + sizes_a[a[:n_a]].cumsum(), row["from_b"] + sizes_b[b[:n_b]].cumsum()])
        order = np.argsort(ends, kind="stable")  # two rising runs: one merge, A's end before an equal one of B
        ends = ends[order]
        of_b = order >= n_a
        self.ids, self.sides = np.concatenate([a[:n_a], b[:n_b]])[order], of_b.astype(np.uint8)
        fresh = np.diff(ends, prepend=row["last"]) > 0
        # an end equal to the one before it is B's after A's: both tokens end there
        self.cuts = ~fresh
        ended_b = np.cumsum(of_b) - of_b
        self.a, self.b = a[(np.arange(len(ends)) - ended_b)[fresh]], b[ended_b[fresh]]


class GroupText:
    """Groups as text: ids in order, A's before B's; see the bytes of `of`."""

    def __init__(self, largest: int):
        digits = [str(i).encode() for i in range(largest + 1)]
        self.width = max(map(len, digits)) + 1  # a place for what follows the id
        self.table = np.frombuffer(b"".join([d.ljust(self.width) for d in digits]), np.uint8).reshape(-1, self.width)
        self.length = np.array([len(d) for d in digits])

    def of(self, ids: np.ndarray, sides: np.ndarray, cuts: np.ndarray) -> bytes:
        """a1,a2|b1;a3|b2,b3 for merged ends of a whole document."""
        if not len(ids):
            return b""
        group = np.cumsum(cuts) - cuts  # the end that makes the cut closes its group
        order = np.argsort(2 * group + sides, kind="stable")
        ids, sides, group = ids[order], sides[order], group[order]
        mark = np.where(np.diff(group, append=-1) != 0, ord(";"),
                        np.where(np.diff(sides.astype(int), append=0) != 0, ord("|"), ord(",")))
        cells = self.table[ids]
        length = self.length[ids]
        cells[np.arange(len(ids)), length] = mark
        return cells[np.arange(self.width) <= length[:, None]][:-1].tobytes()


def pair_counts(found: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(chunk, pair, n): the links of each pair of ids in a chunk."""

    def run(batches):
        for batch in batches:
            for chunk, held in zip(batch.column("chunk"), batch.column("held")):
                links = [np.zeros(0, np.int64)]
                for row in unpacked(held):
                    merge = Merge(row, *sizes)
                    links.append(merge.a.astype(np.int64) * PAIR + merge.b)
                pairs, counts = np.unique(np.concatenate(links), return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([chunk.as_py()] * len(pairs), pa.int64()), "pair": pairs, "n": counts})

    return found.mapInArrow(run, "chunk long, pair long, n long")


def corpus_counts(counted: DataFrame) -> DataFrame:
    """(pair, count, best): links of each pair over the corpus; best: no other A id has more with its B id."""
    whole = materialize(counted.groupBy("pair").agg(F.sum("n").alias("count")), "pairs")
    b = F.col("pair") % PAIR
    most = whole.groupBy(b.alias("b")).agg(F.max("count").alias("most"))
    return whole.withColumn("b", b).join(most, "b").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best"))


def judged(found: DataFrame, named: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """PARTS of pieces: counts, sums over links, and the groups' text or, of a part, what makes it."""
    schema, text = arrow_schema(PARTS), GroupText(max(map(len, sizes)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy(), kind="stable")
        pairs, count, best = (right[c].to_numpy()[order] for c in ("pair", "count", "best"))
        out = []
        for held in left["held"]:
            for row in unpacked(held):
                merge = Merge(row, *sizes)
                at = np.searchsorted(pairs, merge.a.astype(np.int64) * PAIR + merge.b)
                whole = row["pieces"] == 1
                line = text.of(merge.ids, merge.sides, merge.cuts) if whole else b""
                out.append((row["row"], row["doc_id"], row["piece"], row["pieces"], row["n_a"], row["n_b"],
                            int(merge.cuts.sum()), len(merge.a), int(best[at].sum()), int(count[at].sum()),
                            hashlib.sha256(line).hexdigest() if line else "",
                            *[None if whole else v.tobytes() for v in (merge.ids, merge.sides, merge.cuts)]))
        return pa.Table.from_arrays(columns(out, schema), schema=schema)

    return found.groupBy("chunk").cogroup(named.groupBy("of")).applyInArrow(run, PARTS)


def stitched(parts: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """One row for each document: sums over its pieces, and its groups across them."""
    text, kind = GroupText(max(map(len, sizes))), id_type(sizes)

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["piece", "ids", "sides", "cuts"]).to_pylist(), key=lambda r: r["piece"])
        ids, sides, cuts = (np.frombuffer(b"".join([r[c] for r in rows]), kind) for c, kind in (
            ("ids", kind), ("sides", np.uint8), ("cuts", bool)))
        line = text.of(ids, sides, cuts)
        return pa.table({"row": table["row"][:1], "groups_sha256": [hashlib.sha256(line).hexdigest()]})

    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    many = parts.where("pieces > 1")
    sums = many.groupBy("row").agg(*[F.first(c).alias(c) for c in out[:3]],
                                   *[F.sum(c).alias(c) for c in out[3:7]])
    groups = many.select("row", "piece", "ids", "sides", "cuts").groupBy("row").applyInArrow(
        run, "row long, groups_sha256 string")
    return parts.where("pieces = 1").select(*out).union(sums.join(groups, "row").select(*out))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, size: int = PIECE,
          chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    A encodes a blank and the text, B the text, without special tokens. Where both have a token's
    end at one offset, a group closes. A link is a token of A and one of B that share a byte. n_best
    counts the links whose pair of ids is linked at least as often over the corpus as any other of
    the same B id; count_sum adds up these counts of the links' pairs. Texts that are null or empty,
    or do not come back from the bytes of their tokens, have zeros and an empty string. Repeated
    rows and null ids count each time; other columns are ignored; an empty table gives no rows. A
    very long text is tokenized in one task, as merges may reach anywhere, and is many pieces from
    then on; its groups are stitched in one task.
    """
    import public_tokenizers

    path_a = path_a or vocabulary_path()
    path_b = path_b or public_tokenizers.path("piece_bpe_32k.model")
    sizes = Vocabularies(path_a, path_b).sizes()
    # chunks are compressed as they are; a long document's pieces are some 100 KB each
    found = materialize(chunks(docs, path_a, path_b, size, chunk), "pieces",
                        large_rows() | {"compression": "uncompressed", "parquet.enable.dictionary": "false"})
    counted = materialize(pair_counts(found, sizes), "counted")
    named = counted.select(F.col("chunk").alias("of"), "pair").join(corpus_counts(counted), "pair")
    return stitched(materialize(judged(found, named, sizes), "parts", large_rows(16)), sizes)
