"""SimHash near-duplicates: vantage-point search for close fingerprints, then components.

Links need an exact search of radius r in 64-bit Hamming space. Fingerprints are sharded by the
blocks of bits they agree on (r + 1 blocks: two fingerprints within r bits share one whole block,
a ball of radius 0 in that block); a shard that is too large is split at the median distance to a
vantage point, and points within r beyond the boundary go to both sides. Inside a shard the same
tree goes on in the task; a dense ball, which no distance parts, is dealt to pairs of its blocks.
Only distinct fingerprints are searched and a shard names spanning links alone, so that many
copies never become many pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import map_slices, texts_of, unused
from unimass.llm.graph import components
from unimass.session import materialize

SHINGLE, RADIUS, SEED = 4, 4, 42
SHARD, LEAF, ROUNDS = 8192, 256, 12


def shingle_hashes(text: str, shingle: int, seed: int = SEED, distinct: bool = False) -> bytes:
    """The big-endian XXH64 of every word shingle; fewer words are one shingle.

    Words are runs of anything but ASCII white space, in ASCII lower case. Repeats are included,
    unless only distinct shingles are asked for.
    """
    words = text.encode().lower().split()
    if not words:
        return b""
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(line, seed)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0] + [e + 1 for e in ends[:len(ends) - shingle]]
    hashed = xxhash.xxh64_digest
    shingles = [line[s:e] for s, e in zip(starts, ends[shingle - 1:])]
    return b"".join([hashed(x, seed) for x in (set(shingles) if distinct else shingles)])


BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(hashes: list[bytes]) -> np.ndarray:
    """One fingerprint for each group of hashes: the bits set in over half of it; 0 for no hash."""
    counts = np.array([len(h) // 8 for h in hashes], np.int64)
    octets = np.frombuffer(b"".join(hashes), np.uint8).reshape(-1, 8)
    group = np.repeat(np.arange(len(hashes), dtype=np.int64) * 256, counts)
    out = np.zeros((len(hashes), 8), np.uint8)
    for i in range(8):
        seen = np.bincount(group + octets[:, i], minlength=256 * len(hashes))
        ones = seen.reshape(len(hashes), 256) @ BITS
        out[:, i] = np.packbits(2 * ones > counts[:, None], axis=1)[:, 0]
    return out.view(">u8")[:, 0].astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each document row; a text without words, or null, has 0."""

    def make():
        def run(batch):
            hashes = [shingle_hashes(t, shingle) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "fp": pa.array(majority(hashes).view(np.int64))}

        return run

    return map_slices(texts_of(docs, "doc_id"), make, "doc_id long, fp long")


def close_pairs(points: np.ndarray, radius: int, leaf: int = LEAF) -> list[tuple[np.ndarray, np.ndarray]]:
    """Indices of all pairs within the radius, by a vantage-point tree over the points."""
    return list(each_close(points, radius, leaf))


def each_close(points: np.ndarray, radius: int, leaf: int = LEAF):
    """The same pairs part by part, so that not all of them have to be held."""

    def compare(left, right, same):
        """All pairs of two sets, in blocks; `same`: each pair of one set once."""
        for i in range(0, len(left), 1024):
            rows = left[i:i + 1024]
            for j in range(i if same else 0, len(right), 1024):
                near = np.bitwise_count(points[rows][:, None] ^ points[right[j:j + 1024]]) <= radius
                if same and i == j:
                    near = np.triu(near, 1)
                a, b = np.nonzero(near)
                if len(a):
                    yield rows[a], right[j:j + 1024][b]

    stack = [np.arange(len(points))]
    while stack:
        own = stack.pop()
        if len(own) <= leaf:
            yield from compare(own, own, True)
            continue
        # the point farthest from an arbitrary one spreads the distances
        start = np.bitwise_count(points[own] ^ points[own[0]])
        away = np.bitwise_count(points[own] ^ points[own[int(start.argmax())]]).astype(np.int64)
        middle = int(np.median(away))
        if middle == away.max():
            middle -= 1
        inner, outer = away <= middle, away > middle
        if not inner.any():  # all at one distance: no bound can part them
            yield from compare(own, own, True)
            continue
        stack += [own[inner], own[outer]]
        for d in range(middle - radius + 1, middle + 1):  # the triangle bound, ring by ring
            ring = own[away == d]
            if len(ring):
                yield from compare(ring, own[outer & (away <= d + radius)], False)


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the groups of the pairs; label[x] is the smallest index of the group of x."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label != label[label]).any():
            label[:] = label[label]


def stars(points: np.ndarray, radius: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) for each point that is linked to a smaller root, as indices; no pair is kept."""
    label = np.arange(len(points))
    for a, b in each_close(points, radius, leaf):
        hook(label, a, b)
    moved = np.flatnonzero(label != np.arange(len(points)))
    return moved, label[moved]


def bit_blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of radius + 1 blocks: fingerprints within the radius agree on one of them."""
    width, wider = divmod(64, radius + 1)
    sizes = [width + (i < wider) for i in range(radius + 1)]
    return [(sum(sizes[:i]), size) for i, size in enumerate(sizes)]


def in_blocks(rows: DataFrame, keys: list[str], limit: int, weight=None) -> DataFrame:
    """rows with each shard of more than `limit` weight dealt to pairs of blocks of half of it.

    Every two rows of a shard still meet. A row of a shard of c blocks is c rows.
    """
    total = F.sum(F.lit(1) if weight is None else weight)
    large = materialize(rows.groupBy("shard").agg(total.alias("total")).where(F.col("total") > limit).select(
        "shard", F.ceil(2 * F.col("total") / limit).cast("int").alias("blocks")), "dense")
    if large.isEmpty():
        return rows
    own, other = F.pmod(F.xxhash64(*keys, F.lit(7)), F.col("blocks")).cast("int"), F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    split = rows.join(large, "shard").withColumn("own", own).select("own", other, *rows.columns)
    name = F.concat_ws("|", "shard", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string"))
    split = split.withColumn("shard", name).select(*rows.columns)
    return rows.join(large, "shard", "left_anti").select(*rows.columns).union(split)


def shards(nodes: DataFrame, radius: int, limit: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """(shard, fp): every two fingerprints within the radius meet in one shard at least.

    Other columns of nodes stay beside their fingerprint.
    """
    beside = [c for c in nodes.columns if c != "fp"]
    parts = [F.concat_ws(":", F.lit(str(i)), F.shiftrightunsigned(F.col("fp"), at).bitwiseAND(
        F.lit((1 << bits) - 1)).cast("string")) for i, (at, bits) in enumerate(bit_blocks(radius))]
    state = nodes.select(F.explode(F.array(*parts)).alias("shard"), "fp", *beside)
    done = None
    for _ in range(rounds):
        state = materialize(state, "shards")
        large = materialize(state.groupBy("shard").agg(
            F.count("*").alias("n"), F.min("fp").alias("vantage")).where(F.col("n") > limit), "large")
        kept = state.join(large.select("shard"), "shard", "left_anti")
        done = kept if done is None else done.union(kept)
        if large.isEmpty():
            return done
        away = state.join(large, "shard").withColumn(
            "away", F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))))
        middle = away.groupBy("shard").agg(F.percentile_approx("away", F.lit(0.5)).alias("middle"))
        split = away.join(middle, "shard")
        inner = split.where(F.col("away") <= F.col("middle") + radius)
        outer = split.where(F.col("away") > F.col("middle"))
        grown = lambda side, tag: side.select(F.concat("shard", F.lit(tag)).alias("shard"), "n", "fp", *beside)
        halves = materialize(grown(inner, "-").union(grown(outer, "+")), "halves")
        sizes = halves.groupBy("shard").agg(F.count("*").alias("m"), F.first("n").alias("n"))
        tight = sizes.where(F.col("m") > 0.95 * F.col("n")).select("shard")  # a dense ball: no further
        done = done.union(in_blocks(halves.join(tight, "shard").select("shard", "fp", *beside), ["fp", *beside], limit))
        state = halves.join(tight, "shard", "left_anti").select("shard", "fp", *beside)
    return done.union(in_blocks(state, ["fp", *beside], limit))


def each_shard(batches):
    """(shard, its rows) from batches sorted by shard, one after the other."""
    name, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.column("shard").dictionary_encode()
        codes = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]
        for a, b in zip(cuts, cuts[1:]):
            own = names.dictionary[codes[a]].as_py()
            if own != name and held:
                yield name, pa.Table.from_batches(held)
                held = []
            name = own
            held.append(batch.slice(a, b - a))
    if held:
        yield name, pa.Table.from_batches(held)


def links(nodes: DataFrame, radius: int = RADIUS, limit: int = SHARD) -> DataFrame:
    """(u, v): links between distinct fingerprints with the same components as all close pairs."""

    def run(batches):
        for _, rows in each_shard(batches):
            if rows.num_rows > 1:
                points = rows["fp"].to_numpy()
                moved, root = stars(points.view(np.uint64), radius)
                if len(moved):
                    yield pa.RecordBatch.from_pydict({"u": pa.array(points[moved]), "v": pa.array(points[root])})

    found = shards(nodes, radius, limit).repartition("shard").sortWithinPartitions("shard")
    return found.mapInArrow(run, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): one row for each row of docs.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    `radius` bits; null ids are passed over, and a component of null ids alone has null. Texts
    without words share fingerprint 0 and are linked like any other. Repeated rows share all. An
    empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, shingle), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    roots = components(links(nodes.select("fp"), radius))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(rooted.join(lowest, "root").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


# Fixed for de-duplication: fingerprints of word pairs only name candidates, the texts decide.
PAIR_WORDS, PAIR_RADIUS, PAIR_SEEDS = 2, 6, (42, 43, 44)
WORDS, SIMILAR = 5, 0.8  # words of a shingle; least Jaccard similarity of a link
HELD, ROW = 1 << 23, 1 << 10  # shingles that a task compares at once; what a row counts besides its own


def owned(prints: np.ndarray, seed: int, block: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the pairs meet first in this shard, of all shards by seed and block of bits."""
    first = np.ones(len(a), bool)
    for s in range(seed):
        first &= np.bitwise_count(prints[a, s] ^ prints[b, s]) > PAIR_RADIUS
    away = prints[a, seed] ^ prints[b, seed]
    for at, bits in bit_blocks(PAIR_RADIUS)[:block]:
        first &= (away >> np.uint64(at)) & np.uint64((1 << bits) - 1) != 0
    return first


def owned_pairs(name: str, rows: pa.Table):
    """Index pairs of the close rows of a shard that meet first here, part by part."""
    seed, block = map(int, name.split(":")[:2])
    prints = np.stack([rows[f"fp_{s}"].to_numpy() for s in PAIR_SEEDS], 1).view(np.uint64)
    for a, b in each_close(np.ascontiguousarray(prints[:, seed]), PAIR_RADIUS):
        own = owned(prints, seed, block, a, b)
        if own.any():
            yield a[own], b[own]


def with_partners(sharded: DataFrame) -> DataFrame:
    """(shard, node): nodes with a close partner that they meet first in this shard."""

    def run(batches):
        for name, rows in each_shard(batches):
            if rows.num_rows < 2:
                continue
            found = np.zeros(rows.num_rows, bool)
            for a, b in owned_pairs(name, rows):
                found[a] = found[b] = True
            if found.any():
                node = rows["node"].to_numpy()[found]
                yield pa.RecordBatch.from_pydict({"shard": [name] * len(node), "node": node})

    dealt = sharded.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard string, node long")


def spanning(pairs, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest of all pairs whose sets have a Jaccard similarity of SIMILAR or more.

    Every pair is compared, but for those that are in one tree by then.
    """
    label, found = np.arange(len(sets)), []
    size = np.array([len(s) for s in sets], np.int64)
    ends = np.cumsum(size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    held = np.zeros(int(codes.max(initial=-1)) + 1, bool)
    for a, b in pairs:
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = [0, *(np.flatnonzero(np.diff(a)) + 1).tolist(), len(a)]
        for start, end in zip(cuts, cuts[1:]):
            u, others = a[start], b[start:end]
            others = others[label[others] != label[u]]
            if not len(others):
                continue
            own = codes[ends[u] - size[u]:ends[u]]
            held[own] = True
            many = size[others]
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            hit = held[codes[np.repeat(ends[others] - many, many) + step]]
            both = np.bincount(np.repeat(np.arange(len(others)), many), hit, len(others))
            held[own] = False
            alike = both / np.maximum(size[u] + many - both, 1) >= SIMILAR
            for v in others[alike].tolist():
                if label[v] != label[u]:
                    found.append((int(u), v))
                    label[label == label[v]] = label[u]
    return found


def confirmed(sharded: DataFrame) -> DataFrame:
    """(u, v) from (shard, node, fps, shingles): links with the components of all alike pairs of shards."""

    def run(batches):
        for name, rows in each_shard(batches):
            if rows.num_rows < 2:
                continue
            node = rows["node"].to_numpy()
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows["shingles"]]
            found = spanning(owned_pairs(name, rows), sets)
            if found:
                u, v = np.array(found).T
                yield pa.RecordBatch.from_pydict({"u": pa.array(node[u]), "v": pa.array(node[v])})

    dealt = sharded.repartition("shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "u long, v long")


def groups(docs: DataFrame, *keys: str) -> DataFrame:
    """The key columns and `group` of every row; the last key is the same only for rows of one text.

    Texts of the same words are one node. Nodes are candidates where one of the fingerprints of word
    pairs differs in at most PAIR_RADIUS bits, and linked where their five-word shingles have a
    Jaccard similarity of SIMILAR or more; `group` names the connected component. Shingles go to the
    shard in which a pair first meets, once for each node; the shard compares all its pairs and
    names spanning links, so that rows grow with the nodes and not with the pairs.
    """
    names = [f"fp_{seed}" for seed in PAIR_SEEDS]
    kinds = dict(docs.dtypes)

    def make():
        def run(batch):
            texts = batch.column("text").to_pylist()
            prints = {n: pa.array(majority([shingle_hashes(t, PAIR_WORDS, seed, True) for t in texts]).view(
                np.int64)) for n, seed in zip(names, PAIR_SEEDS)}
            whole = [xxhash.xxh64_digest(b" ".join(t.encode().lower().split()), SEED) for t in texts]
            node = np.frombuffer(b"".join(whole), ">i8").astype(np.int64)
            return {**{k: batch.column(k) for k in keys}, **prints, "node": pa.array(node)}
        return run

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{n} long" for n in names] + ["node long"])
    prints = materialize(map_slices(texts_of(docs, *keys), make, schema), "prints")
    row = keys[-1]
    nodes = materialize(prints.groupBy("node").agg(F.min(row).alias(row), *[F.min(n).alias(n) for n in names]), "nodes")
    sharded = None
    for i, n in enumerate(names):
        own = shards(nodes.select(F.col(n).alias("fp"), "node", *names), PAIR_RADIUS).select(
            F.concat(F.lit(f"{i}:"), "shard").alias("shard"), "node", *names)
        sharded = own if sharded is None else sharded.union(own)
    found = materialize(with_partners(sharded), "candidates")
    wanted = nodes.join(found.select("node").distinct(), "node", "left_semi")

    def shingled():
        def run(batch):
            sets = [np.unique(np.frombuffer(shingle_hashes(t, WORDS, distinct=True), np.uint64)).tobytes()
                    for t in batch.column("text").to_pylist()]
            return {"node": batch.column("node"), "shingles": pa.array(sets, pa.binary())}
        return run

    whole = texts_of(docs, row).join(wanted.select(row, "node"), row).select("node", "text")
    sets = materialize(map_slices(whole, shingled, "node long, shingles binary").dropDuplicates(["node"]), "shingles")
    weighed = found.join(sets.select("node", (F.length("shingles") / 8 + ROW).alias("weight")), "node")
    dealt = in_blocks(weighed, ["node"], HELD, F.col("weight")).drop("weight")
    linked = materialize(confirmed(dealt.join(nodes.select("node", *names), "node").join(sets, "node")), "linked")
    roots = materialize(components(linked), "roots")
    return prints.join(roots, "node", "left").select(*keys, F.coalesce("root", "node").alias("group"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of every group of near-copies: that of the smallest doc_id, all columns kept.

    A null doc_id comes before all others; of repeated rows one stays.
    """
    name, one, key = (unused(docs, c) for c in ("row_key", "kept_id", "kept_key"))
    n = docs.columns
    plain = [c for c, kind in docs.dtypes if not kind.startswith("map")]
    marked = docs.withColumn(name, F.xxhash64(*plain))
    found = groups(marked, "doc_id", name)
    first = materialize(found.groupBy("group").agg(F.min(F.struct("doc_id", name)).alias("one")).select(
        F.col("one.doc_id").alias(one), F.col(f"one.{name}").alias(key)), "kept")
    alike = found.groupBy(name).count().where("count > 1").select(F.col(name).alias(key))
    many = materialize(first.join(alike, key, "left_semi"), "alike")
    same = F.col("doc_id").eqNullSafe(F.col(one)) & (F.col(name) == F.col(key))
    if many.isEmpty():
        return marked.join(first, same, "left_semi").select(*n)
    kept = marked.join(first.join(many, key, "left_anti"), same, "left_semi")
    return kept.union(marked.join(many, same, "left_semi").dropDuplicates([name])).select(*n)
