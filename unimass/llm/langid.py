"""Language identification by error-correcting output codes over byte n-grams.

Every language has a codeword; one binary classifier over hashed byte bigrams and trigrams
predicts each bit. A text takes the language whose codeword has the least weighted loss, and is
flagged where the runner-up is nearly as close.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unimass.llm.arrow import keep_rows, map_slices, text_bytes, texts_of

UNKNOWN = "und"
DIM = 2048
SAMPLE = 4000     # labelled texts to fit on, shared evenly by the languages
RIDGE, SHARPNESS, CLOSE = 1e-3, 8.0, 0.15
MOST_LANGUAGES = 256


def folded() -> np.ndarray:
    """Byte to byte: ASCII letters in lower case, bytes of other letters as they are, else a blank."""
    table = np.full(256, 32, np.uint32)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def ngram_profiles(column: pa.Array, dim: int = DIM) -> np.ndarray:
    """One row for each text: square roots of the shares of its hashed bigrams and trigrams."""
    data, at = text_bytes(column)
    out = np.zeros((len(column), dim), np.float32)
    if not len(data):
        return out
    fold = folded()[data]
    owner = np.repeat(np.arange(len(column), dtype=np.int64), np.diff(at))
    for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
        if len(fold) < n:
            continue
        last = len(fold) - n + 1
        gram = fold[:last]
        for i in range(1, n):
            gram = gram * np.uint32(257) + fold[i:last + i]
        whole = owner[:last] == owner[n - 1:]
        cell = owner[:last] * dim + ((gram * np.uint32(salt)) >> np.uint32(16)) % np.uint32(dim)
        out += np.bincount(cell[whole], minlength=out.size).reshape(out.shape)
    return np.sqrt(out / np.maximum(out.sum(1, keepdims=True), 1))


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """classes x bits in -1, 1: exhaustive for up to seven classes, else the best of random codes."""
    if classes < 2:
        return np.zeros((classes, 0))
    if classes <= 7:
        bits = [[1] + [1 if i >> (classes - 2 - c) & 1 else -1 for c in range(classes - 1)]
                for i in range(2 ** (classes - 1) - 1)]
        return np.array(bits, float).T
    rng, best, gap = np.random.default_rng(seed), None, -1
    length = int(np.ceil(10 * np.log2(classes)))
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], (classes, length))
        apart = length - np.abs(code @ code.T)  # also far from a complement
        np.fill_diagonal(apart, length)
        if apart.min() > gap and (np.abs(code.sum(0)) < classes).all():
            best, gap = code, apart.min()
    return best


def fit(docs: DataFrame, sample: int = SAMPLE, dim: int = DIM) -> dict:
    """A model from the rows of docs with text and lang; others teach nothing.

    At most `sample` texts are used, whole and each text once: of every language those of the
    smallest hashes of their text. Of over MOST_LANGUAGES languages the commonest are learned.
    """
    rows = docs.where("lang is not null and text is not null")
    found = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    counts = {r["lang"]: r["count"] for r in found}
    names = sorted(counts)
    if not names:
        return {"names": [], "code": np.zeros((0, 0)), "weights": np.zeros((dim + 1, 0)), "trust": np.zeros(0)}
    most = max(1, sample // len(names))
    share = F.lit(0)
    for name in names:  # twice what is wanted: repeated texts are one
        part = min(1.0, 2 * most / counts[name])
        share = F.when(F.col("lang") == name, F.lit(int(part * (1 << 20)))).otherwise(share)
    drawn = F.xxhash64("text")
    some = rows.select("lang", "text").where(F.pmod(drawn, F.lit(1 << 20)) < share).dropDuplicates(["lang", "text"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(drawn, F.lit(1 << 20)), drawn, "text"))
    chosen = some.withColumn("place", place).where(F.col("place") <= most)

    def make():
        def run(batch):
            profiles = ngram_profiles(batch.column("text"), dim).astype(np.float16)
            return {"lang": batch.column("lang"),
                    "x": pa.array([p.tobytes() for p in profiles], pa.binary())}
        return run

    found = map_slices(texts_of(chosen, "lang"), make, "lang string, x binary").collect()
    found.sort(key=lambda r: (r["lang"], bytes(r["x"])))  # the same model in any order of rows
    x = np.array([np.frombuffer(r["x"], np.float16) for r in found], np.float64).reshape(-1, dim)
    x = np.hstack([x, np.ones((len(x), 1))])
    code = codewords(len(names))
    place = {name: i for i, name in enumerate(names)}
    y = code[[place[r["lang"]] for r in found]]
    penalty = RIDGE * len(x) * np.diag(np.append(np.ones(dim), 0.0)) / 10 + 1e-9 * np.eye(dim + 1)
    weights = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    right = np.mean(np.sign(x @ weights) == y, axis=0) if len(x) else np.zeros(code.shape[1])
    trust = np.maximum(right - 0.5, 0.05)
    return {"names": names, "code": code, "weights": weights, "trust": trust / max(trust.sum(), 1e-9)}


def decode(model: dict, profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best and second class, and the share of belief in the best, by weighted hinge losses."""
    margin = profiles @ model["weights"][:-1] + model["weights"][-1]
    loss = np.stack([np.maximum(0, 1 - margin * word) @ model["trust"] for word in model["code"]], 1)
    belief = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
    belief /= belief.sum(1, keepdims=True)
    order = np.argsort(loss, 1, kind="stable")
    second = order[:, 1] if loss.shape[1] > 1 else order[:, 0]
    gap = np.take_along_axis(loss, second[:, None], 1)[:, 0] - loss.min(1)
    return order[:, 0], belief[np.arange(len(loss)), order[:, 0]], gap


def predicted(column: pa.Array, model: dict, close: float = CLOSE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    names = model["names"]
    named = np.array([any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
    pred = np.full(len(named), UNKNOWN, object)
    score, unsure = np.zeros(len(named)), np.zeros(len(named), bool)
    if names and named.any():
        best, belief, gap = decode(model, ngram_profiles(column, len(model["weights"]) - 1))
        pred[named] = np.array(names, object)[best[named]]
        score[named] = belief[named]
        unsure = named & (gap < close) & (len(names) > 1)
    return pred, score, unsure


def identify(docs: DataFrame, model: dict, *keys: str, close: float = CLOSE) -> DataFrame:
    """The key columns with lang_pred, score (0 to 1) and ambiguous, one row for each row.

    A null text, or one without a letter, is `und` with score 0. Ties go to the first name. Without
    any learned language everything is `und`. Only the text is looked at.
    """
    def make():
        def run(batch):
            pred, score, unsure = predicted(batch.column("text"), model, close)
            return {**{k: batch.column(k) for k in keys}, "lang_pred": pa.array(pred, pa.string()),
                    "score": score, "ambiguous": unsure}
        return run

    kinds = dict(docs.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys],
                        "lang_pred string, score double, ambiguous boolean"])
    return map_slices(texts_of(docs, *keys), make, schema)


def in_a_language(docs: DataFrame, model: dict) -> DataFrame:
    """docs without the rows that get no language; an ambiguous one is still a language.

    Where no language could be learned, rows with a letter stay.
    """
    def kept(texts):
        if not model["names"]:
            return [any(map(str.isalpha, t)) for t in texts.to_pylist()]
        return predicted(texts, model)[0] != UNKNOWN

    return keep_rows(docs, lambda: kept)


def fold_of(column: str, folds: int):
    """crc32 of an id as text, modulo the folds; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % folds
