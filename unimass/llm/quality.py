"""Quality scores: histogram gradient-boosted trees over statistics of whole documents.

The trees are complete and flattened into arrays, so that a slice of documents walks all of them
with a few numpy gathers per level.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import map_slices, text_bytes, texts_of

SAMPLE = 20_000  # labelled documents to fit on, at most about so many
ROUNDS, DEPTH, RATE, BINS, LEAST, RIDGE = 120, 4, 0.1, 64, 20, 1.0
CUT = 0.7

SYMBOLS = "|#%&$*!?.,;:=<>{}[]()/\\_@\"'-+~^`"
GROUPS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58),
    "blank": (32, 9), "line": (10,), "control": (*range(0, 9), *range(11, 32), 127),
    "high": range(128, 256), "symbol": [ord(c) for c in SYMBOLS],
}
WORD_STATS = ("log_words", "word_length", "longest", "distinct", "top_word", "twice_running",
              "capitals", "no_letter", "log_lines", "line_words", "distinct_lines", "top_line",
              "last_ends", "distinct_starts")
NAMES = ("log_bytes", *GROUPS, *(f"has_{ord(c)}" for c in SYMBOLS), *WORD_STATS)


def word_stats(text: str) -> list[float]:
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, m = max(len(words), 1), max(len(lines), 1)
    counted, starts = Counter(words), Counter(w[:3] for w in words)
    sizes = [len(w) for w in words]
    return [
        np.log1p(len(words)), sum(sizes) / n, np.log1p(max(sizes, default=0)),
        len(counted) / n, max(counted.values(), default=0) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        sum(map(str.isupper, words)) / n,
        sum(not any(map(str.isalpha, w)) for w in counted) / max(len(counted), 1),
        np.log1p(len(lines)), len(words) / m, len(set(lines)) / m,
        max(Counter(lines).values(), default=0) / m,
        float(text.rstrip().endswith((".", "!", "?", '"', "'"))), len(starts) / n,
    ]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; an empty text has zeros."""
    data, at = text_bytes(column)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(column), dtype=np.int64) * 256, sizes)
    bytes_seen = np.bincount(owner + data, minlength=256 * len(column)).reshape(-1, 256)
    share = bytes_seen / np.maximum(sizes, 1)[:, None]
    groups = np.stack([share[:, list(g)].sum(1) for g in GROUPS.values()], 1)
    symbols = share[:, [ord(c) for c in SYMBOLS]]
    words = np.array([word_stats(t) for t in column.to_pylist()]).reshape(-1, len(WORD_STATS))
    return np.hstack([np.log1p(sizes)[:, None], groups, symbols, words]).astype(np.float32)


def profiles(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row; a null text counts as an empty one."""

    def make():
        def run(batch):
            x = statistics(batch.column("text"))
            rows = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            return {"doc_id": batch.column("doc_id"), "x": rows}
        return run

    return map_slices(texts_of(docs, "doc_id"), make, "doc_id long, x array<float>")


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, depth: int = DEPTH) -> dict:
    """Boosted trees for 0/1 labels, from histograms of quantile bins.

    Nodes of a tree are 0 at the root and 2i+1, 2i+2 below i; a node that is not worth a split
    sends everything to the left. Ties go to the first feature and bin.
    """
    inner, n_features = 2**depth - 1, x.shape[1]
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = {"start": float(np.log(mean / (1 - mean))), "depth": depth,
             "feature": np.zeros((0, inner), np.int32), "cut": np.zeros((0, inner), np.float32),
             "leaf": np.zeros((0, inner + 1))}
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])).astype(np.float32) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)
    offset = binned + np.arange(n_features) * BINS
    margin = np.full(len(y), model["start"])
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int32), np.full(inner, np.inf, np.float32)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * n_features * BINS + offset).ravel()
            shape = (width, n_features, BINS)
            sums = [np.bincount(cell, np.repeat(v, n_features), width * n_features * BINS).reshape(shape)
                    for v in (slope, curve, np.ones(len(y)))]
            left = [s.cumsum(2) for s in sums]
            total = [s[:, :, -1:] for s in left]
            right = [t - s for t, s in zip(total, left)]
            gain = (left[0] ** 2 / (left[1] + RIDGE) + right[0] ** 2 / (right[1] + RIDGE)
                    - total[0] ** 2 / (total[1] + RIDGE))
            gain[(left[2] < LEAST) | (right[2] < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, b in enumerate(best):
                f, at = divmod(int(b), BINS)
                if gain[i, f, at] > 1e-6:
                    feature[first + i], cut[first + i] = f, edges[f][at]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - inner
        step = RATE * np.bincount(at, slope, inner + 1) / (np.bincount(at, curve, inner + 1) + RIDGE)
        margin += step[at]
        features.append(feature), cuts.append(cut), leaves.append(step)
    return model | {"feature": np.array(features), "cut": np.array(cuts), "leaf": np.array(leaves)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """All trees at once: one gather of feature, cut and value for each level."""
    trees = len(model["feature"])
    node = np.zeros((len(x), trees), np.int64)
    every, row = np.arange(trees), np.arange(len(x))[:, None]
    for _ in range(model["depth"]):
        node = 2 * node + 1 + (x[row, model["feature"][every, node]] > model["cut"][every, node])
    margin = model["start"] + model["leaf"][every, node - (2 ** model["depth"] - 1)].sum(1)
    return 1 / (1 + np.exp(-margin))


def fit(found: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Trees from profiles and labels (doc_id, quality 0 or 1).

    Rows without a label or profile teach nothing, a document with several labels takes their
    largest. At most `sample` documents are used, those of the smallest hashes of their id; of rows
    of one id one teaches.
    """
    marked = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = F.xxhash64("doc_id")
    share = min(1.0, 2 * sample / max(marked.count(), 1))
    chosen = marked.where(F.pmod(drawn, F.lit(1 << 20)) < int(share * (1 << 20))).orderBy(
        F.pmod(drawn, F.lit(1 << 20)), drawn, "doc_id").limit(sample)
    one = found.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("quality").alias("quality"))
    rows = one.select("x", "quality").toArrow().combine_chunks()
    x = np.asarray(rows["x"].combine_chunks().flatten(), np.float32).reshape(-1, len(NAMES))
    y = rows["quality"].to_numpy().astype(float)
    order = np.lexsort([*x.T[::-1], y])  # the same trees in any order of rows
    return grow(x[order], y[order])


def scored(found: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score): the probability of label 1 for each row of profiles."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float32).reshape(-1, len(NAMES))
            parts = [probability(model, x[i:i + 2048]) for i in range(0, len(x), 2048)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "score": np.concatenate([*parts, np.zeros(0)])})

    return found.mapInArrow(run, "doc_id long, score double")
