"""Exact removal of repeated byte strings by distributed prefix doubling over sampled suffixes.

A suffix array of every byte is out of proportion: the classes of suffixes that agree on `limit`
bytes are all that is needed. Each window of `limit` bytes names one anchor, the position of the
least hash among its first `reach` positions, so that equal windows name it at the same place and
neighbouring windows share it. Anchors are ranked by their first bytes, then by pairs of ranks at
a doubled length; suffixes whose rank is unique leave after every round. The windows of an anchor
that is left are either the same run of bytes as elsewhere, then all of them repeat, or they are
ranked one by one past the threshold.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import map_slices, slices, texts_of
from unimass.session import materialize

LIMIT, REACH, GRAM = 400, 128, 8
BLOOM_BITS = 1 << 24


def shape(limit: int) -> tuple[int, int]:
    """How many positions a window looks for its anchor in, and the bytes hashed at each."""
    reach = max(1, min(REACH, limit // 3))
    return reach, max(1, min(GRAM, limit - reach + 1, limit // 4 or 1))


def runs(data: bytes, limit: int) -> tuple[list[int], list[int], list[int]]:
    """(anchor, first window, last window) of each run of neighbouring windows with one anchor."""
    reach, gram = shape(limit)
    n = len(data)
    if n < limit:
        return [], [], []
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    key = np.zeros(n - gram + 1, np.uint64)
    for i in range(gram):
        key |= raw[i:len(key) + i] << np.uint64(8 * i)
    key *= np.uint64(0x9E3779B97F4A7C15)
    key ^= key >> np.uint64(32)
    key *= np.uint64(0xD6E8FEB86659FD93)
    # hash above, position below: the least of them is the leftmost least hash
    low = (key & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(key), dtype=np.uint64)
    span = 1
    while span < reach:
        step = min(span, reach - span)
        low = np.minimum(low[:len(low) - step], low[step:])
        span += step
    anchor = (low[:n - limit + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cut = np.flatnonzero(np.diff(anchor)) + 1
    first = np.concatenate([[0], cut])
    last = np.concatenate([cut - 1, [len(anchor) - 1]])
    return anchor[first].tolist(), first.tolist(), last.tolist()


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def anchors(docs: DataFrame, limit: int) -> DataFrame:
    """(key, first, last, near, far, run) of every run of windows in every text.

    near and far name the two halves of what all windows of the anchor share behind it; run names
    all bytes of its windows together with the anchor's place among them. Only whether a run occurs
    twice matters, so that a task passes on two copies of a text at most.
    """
    reach, _ = shape(limit)
    shared = limit - reach + 1
    half = shared // 2

    def make():
        name, copies = xxhash.xxh3_64_intdigest, {}

        def run(batch):
            out = {c: [] for c in ("key", "first", "last", "near", "far", "run")}
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                copies[key] = copies.get(key, 0) + 1
                if copies[key] > 2:
                    continue
                data = text.encode()
                anchor, first, last = runs(data, limit)
                out["key"] += [key] * len(anchor)
                out["first"] += first
                out["last"] += last
                out["near"] += [name(data[a:a + half]) for a in anchor]
                out["far"] += [name(data[a + half:a + shared]) for a in anchor]
                out["run"] += [name(data[i:j + limit], a - i) for a, i, j in zip(anchor, first, last)]
            return {"key": pa.array(out["key"], pa.int64()), "first": pa.array(out["first"], pa.int32()),
                    "last": pa.array(out["last"], pa.int32()),
                    **{c: signed(out[c]) for c in ("near", "far", "run")}}
        return run

    return map_slices(keyed(docs), make, "key long, first int, last int, near long, far long, run long")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Texts with the 64-bit key that stands for their content."""
    rows = texts_of(docs, *columns)
    return rows.withColumn("key", F.xxhash64("text"))


def repeated(suffixes: DataFrame, *rank: str) -> DataFrame:
    """One round: suffixes whose rank is not unique."""
    twice = suffixes.groupBy(*rank).agg(F.count("*").alias("n")).where("n > 1").select(*rank)
    return suffixes.join(twice, list(rank))


def texts_by_key(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, text) of the texts whose key is wanted, each at least once.

    A bit field of fixed size goes to the tasks and keeps out nearly all other texts before the
    shuffle; within a task each text is passed on once, so that many copies are few rows.
    """
    spark = docs.sparkSession
    words = wanted.select(F.expr(f"pmod(key, {BLOOM_BITS}) div 64").alias("word"),
                          F.expr("shiftleft(1L, cast(pmod(key, 64) as int))").alias("bit")).groupBy(
        "word").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(BLOOM_BITS // 64, np.int64)
    field[words["word"].to_numpy()] = words["bits"].to_numpy()
    shared = spark.sparkContext.broadcast(field)

    def run(batches):
        bits, passed = shared.value.view(np.uint64), set()
        for batch in slices(batches):
            keys = batch.column("key").to_numpy()
            at = np.mod(keys, BLOOM_BITS)
            hit = (bits[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            fresh = []
            for i in np.flatnonzero(hit).tolist():
                if keys[i] not in passed:
                    passed.add(keys[i])
                    fresh.append(i)
            if fresh:
                yield batch.take(pa.array(fresh)).select(["key", "text"])

    found = keyed(docs).select("key", "text").mapInArrow(run, "key long, text string")
    return found.join(wanted.select("key").distinct(), "key")


def ranked_windows(texts: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """(run, offset, window): the name of every window of the asked runs (key, first, last, rank, run)."""
    per_text = asked.groupBy("key").agg(F.collect_list(F.struct("first", "last", "rank", "run")).alias("asked"))

    def run(batches):
        name = xxhash.xxh3_64_intdigest
        for batch in slices(batches):
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
                data = text.encode()
                size = [r["last"] - r["first"] + 1 for r in rows]
                seed = [r["rank"] & (1 << 64) - 1 for r in rows]
                yield pa.RecordBatch.from_pydict({
                    "run": pa.array(np.repeat([r["run"] for r in rows], size), pa.int64()),
                    "offset": pa.array(np.concatenate([np.arange(n) for n in size]), pa.int32()),
                    "window": signed([name(data[p:p + limit], s) for r, s in zip(rows, seed)
                                      for p in range(r["first"], r["last"] + 1)])})

    return texts.join(per_text, "key").select("text", "asked").mapInArrow(
        run, "run long, offset int, window long")


def spans(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(key, first, end): bytes covered by windows of `limit` bytes that start twice or more.

    Spans of one text may overlap. Nothing is cut at a partition or capped in number.
    """
    found = materialize(anchors(docs, limit), "anchors")
    left = repeated(found, "near")
    left = repeated(left, "near", "far").withColumn("rank", F.xxhash64("near", "far")).drop("near", "far")
    left = materialize(left, "suffixes")
    classes = materialize(left.groupBy("rank", "run").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("one")), "classes")
    whole = left.join(classes.where("n > 1").select("rank", "run"), ["rank", "run"]).select(
        "key", "first", (F.col("last") + limit).alias("end"))
    mixed = classes.groupBy("rank").agg(F.count("*").alias("m"), F.min("n").alias("least")).where(
        "m > 1 and least = 1").select("rank")
    asked = materialize(classes.join(mixed, "rank").select("rank", "run", "n", "one.*"), "asked")
    windows = materialize(ranked_windows(texts_by_key(docs, asked), asked, limit), "windows")
    twice = windows.groupBy("window").agg(F.min("run").alias("a"), F.max("run").alias("b")).where(
        "a <> b").select("window")
    single = asked.where("n = 1").select("key", "run", F.col("first").alias("from"))
    hits = windows.join(twice, "window").join(single, "run").select(
        "key", (F.col("from") + F.col("offset")).alias("first"))
    # neighbouring windows of a run are one span
    parts = hits.groupBy("key").agg(F.sort_array(F.collect_set("first")).alias("p"))
    return whole.distinct().union(
        parts.select("key", F.explode("p").alias("first")).select(
            "key", "first", (F.col("first") + limit).alias("end")))


def removed(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), one row for each row of docs.

    A byte goes if a string of `limit` bytes over it also starts anywhere else, in the same text or
    another one; a repeated row is another text. All is judged on the input. Texts are UTF-8, a
    null one is empty; null ids are kept.
    """
    covered = materialize(spans(docs, limit), "covered")
    per_text = covered.groupBy("key").agg(F.collect_list(F.struct("first", "end")).alias("spans"))

    def run(batches):
        for batch in slices(batches):
            out = {"of": batch.column("key"), "n_removed": [], "n_spans": [], "kept": []}
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                data = text.encode()
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [r["first"] for r in rows], 1)
                np.add.at(edge, [r["end"] for r in rows], -1)
                gone = np.cumsum(edge)[:-1] > 0
                out["n_removed"].append(int(gone.sum()))
                out["n_spans"].append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                kept = np.frombuffer(data, np.uint8)[~gone]
                out["kept"].append(hashlib.sha256(kept.tobytes()).hexdigest())
            yield pa.RecordBatch.from_pydict(out)

    cut = texts_by_key(docs, covered).join(per_text, "key").mapInArrow(
        run, "of long, n_removed long, n_spans long, kept string").dropDuplicates(["of"])
    rows = keyed(docs, "doc_id").select(
        "doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("all"))
    return rows.join(cut, F.col("key") == F.col("of"), "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("kept", "all").alias("kept_sha256"))
