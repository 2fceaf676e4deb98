"""Packing of documents into training windows by Karmarkar-Karp multiway differencing.

Documents are tokenised and packed where they are read: a block of documents never leaves its
task, so nothing is shuffled and a lost executor repeats only its own blocks.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from unimass.llm.arrow import slices, texts_of
from unimass.llm.tokens import encoder, vocabulary_path

WINDOW, END = 2048, 1
BLOCK_DOCS, BLOCK_TOKENS = 1024, 1 << 21  # a block is packed as soon as it has either

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The part (0 to k-1) of each size, by multiway differencing.

    Every size starts as a partition of its own with k-1 empty parts. The two partitions with the
    largest imbalance are merged, the largest part of one with the smallest of the other, until
    one is left. Ties go to the partition made first.
    """
    m = len(sizes)
    if k == 1 or m == 0:
        return np.zeros(m, np.int64)
    follows = np.full(m, -1, np.int64)  # items of a part are linked lists
    empty = np.full(k - 1, -1, np.int64)
    heap = []
    for item, size in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = size
        ends = np.concatenate([[item], empty])
        heap.append((-int(size), item, loads, ends, ends))
    heapq.heapify(heap)
    made = m
    while len(heap) > 1:
        _, _, loads, first, last = heapq.heappop(heap)
        _, _, other, other_first, other_last = heapq.heappop(heap)
        loads = loads + other[::-1]
        other_first, other_last = other_first[::-1], other_last[::-1]
        both = (first >= 0) & (other_first >= 0)
        follows[last[both]] = other_first[both]
        first = np.where(first >= 0, first, other_first)
        last = np.where(other_last >= 0, other_last, last)
        order = np.argsort(-loads, kind="stable")
        loads, first, last = loads[order], first[order], last[order]
        heapq.heappush(heap, (int(loads[-1] - loads[0]), made, loads, first, last))
        made += 1
    part = np.zeros(m, np.int64)
    for p, item in enumerate(heap[0][3]):
        while item >= 0:
            part[item] = p
            item = follows[item]
    return part


def balanced(sizes: np.ndarray, window: int) -> np.ndarray:
    """Parts of at most `window` without cutting: one more part whenever one is over capacity."""
    k = max(1, -(-int(sizes.sum()) // window))
    while True:
        part = difference(sizes, k)
        if np.bincount(part, sizes, minlength=1).max(initial=0) <= window:
            return part
        k += 1


def pack(sizes: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, window number, offset) that cover every item once.

    Whole windows of a long item stand alone. The rests are dealt to the least number of windows
    by differencing; where a window exceeds its capacity the excess is cut off, closes the gaps of
    short windows, and opens a new window once there is no gap left.
    """
    pieces, number = [], 0
    rests = []
    for item, size in enumerate(sizes.tolist()):
        full = size // window
        for i in range(full):
            pieces.append((item, i * window, window, number, 0))
            number += 1
        if size > full * window:
            rests.append((item, full * window, size - full * window))
    if not rests:
        return pieces
    loads = np.array([r[2] for r in rests], np.int64)
    k = -(-int(loads.sum()) // window)
    part = difference(loads, k)
    filled, spare = [0] * k, []
    for (item, start, length), p in zip(rests, part.tolist()):
        fits = min(length, window - filled[p])
        if fits:
            pieces.append((item, start, fits, number + p, filled[p]))
            filled[p] += fits
        if length > fits:
            spare.append((item, start + fits, length - fits))
    gaps = sorted((p for p in range(k) if filled[p] < window), key=lambda p: filled[p])
    for item, start, length in sorted(spare, key=lambda s: -s[2]):
        while length:
            if not gaps:
                gaps.append(len(filled))
                filled.append(0)
            p = gaps[0]
            fits = min(length, window - filled[p])
            pieces.append((item, start, fits, number + p, filled[p]))
            filled[p] += fits
            start, length = start + fits, length - fits
            if filled[p] == window:
                gaps.pop(0)
    return pieces


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW,
                   end_id: int = END, block_docs: int = BLOCK_DOCS,
                   block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Pieces of documents in windows of at most `window` ids; see PIECES for the columns.

    A document is its ids followed by `end_id`; a null or empty text is that one id. Each row is
    packed on its own, also where a doc_id repeats or is null. Documents of one block share
    windows, so that at most one window in a block is short. An empty table gives no pieces.
    """
    path = vocabulary or vocabulary_path()

    def run(batches):
        encode = encoder(path)
        block, held, number = [], 0, TaskContext.get().partitionId() << 40

        def packed():
            nonlocal number
            sizes = np.array([len(ids) for _, ids in block], np.int64)
            rows = pack(sizes, window)
            out = {
                "doc_id": pa.array([block[i][0] for i, *_ in rows], pa.int64()),
                "start": pa.array([s for _, s, *_ in rows], pa.int64()),
                "length": pa.array([n for _, _, n, *_ in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(block[i][1][s:s + n]) for i, s, n, *_ in rows],
                                      pa.int64()),
                "doc_tokens": pa.array(sizes[[r[0] for r in rows]], pa.int64()),
                "sequence_id": pa.array([number + r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
            number += max(r[3] for r in rows) + 1
            block.clear()
            return pa.RecordBatch.from_pydict(out)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(),
                                    batch.column("text").to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                block.append((doc_id, ids))
                held += len(ids)
                if len(block) >= block_docs or held >= block_tokens:
                    yield packed()
                    held = 0
        if block:
            yield packed()

    return texts_of(docs, "doc_id").mapInArrow(run, PIECES)
