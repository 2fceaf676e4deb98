"""Personal data: pattern matches, and a skip-chain conditional random field that adds to them.

Tokens with a digit or an at sign are the nodes. Neighbours in the text are linked, and equal or
similar tokens anywhere in a document are linked to one of them, a pattern match if there is one, so
that every repeat is one step from it however many there are. Loopy message passing spreads labels
over both kinds of links until they settle; tokens of a pattern match keep their label.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.llm.arrow import map_slices, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SAMPLE, SAMPLE_NODES = 3000, 2000  # documents to fit on, and the most nodes such a document has
DAMPING, SURE = 0.3, 0.7
SETTLED, PASSES = 1e-4, 200  # largest change of a message at the end; passes for fields that never settle


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, at sign and dotted domain, in linear time: from at sign to at sign."""
    domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = domain.match(text, at + 1) if start < at else None
        if match:
            found.append((start, match.end()))
            done = match.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that pass their checks, by start and kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    for m in re.finditer(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9](?:[ -]?[0-9])++", text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def bucket(n: int, bounds: tuple[int, ...]) -> int:
    return sum(n >= b for b in bounds)


DIVIDED = re.compile(r"[0-9](?:[ -]?[0-9])*")


def features(token: str) -> list[int]:
    """Indices of what holds for a token's shape."""
    digits = "".join(c for c in token if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in token)
    core = token.strip(".,;:!?\"'[]{}<>|")
    quad = re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", core) is not None
    plain = core.isascii() and core.isdigit()
    on = [0, 1 + bucket(len(digits), (1, 4, 5, 7, 9, 12, 20)), 9 + bucket(letters, (1, 3)),
          12 + min(core.count("."), 4)]
    for i, holds in enumerate((
            "@" in token, core.startswith("+"), core.startswith("("), quad, plain,
            re.fullmatch(r"\(?[0-9]{2,4}\)?", core) is not None,
            re.fullmatch(r"[0-9]{2,5}(?:[-.][0-9]{2,5})+", core) is not None,
            DIVIDED.fullmatch(core) is not None and 12 <= len(digits) <= 19 and not luhn(digits),
            quad and any(int(p[-4:]) > 255 for p in core.split(".")),
            re.search(r"@[A-Za-z0-9-]+\.", token) is not None)):
        if holds:
            on.append(17 + i)
    return on


WIDTH = 27


def similar(token: str) -> list[str]:
    """Keys that tokens of one entity share: the bare token, its last seven digits, its local part."""
    core = token.strip(".,;:!?\"'()[]{}<>|").lower()
    keys = ["t" + core]
    digits = "".join(c for c in core if "0" <= c <= "9")
    if len(digits) >= 7:
        keys.append("d" + digits[-7:])
    if "@" in core:
        keys.append("l" + core.split("@")[0])
    return keys


def graph(text: str, spans: list[tuple[int, int, int]]):
    """Nodes (start, end), their features, fixed labels (-1: free), chain links and skip links."""
    nodes, shape, chain, keys, ends = [], [], [], [], None
    for m in re.finditer(r"\S+", text):
        token = m[0]
        if not re.search("[0-9@]", token):
            continue
        here = len(nodes)
        if ends is not None and m.start() - ends <= 2 and not text[ends:m.start()].strip():
            chain.append((here - 1, here))
        ends = m.end()
        nodes.append(m.span())
        row = np.zeros(WIDTH, np.uint8)
        row[features(token)] = 1
        shape.append(row)
        keys.append(similar(token))
    fixed = np.full(len(nodes), -1, np.int8)
    starts = np.array([s for s, _ in nodes], np.int64)
    stops = np.array([e for _, e in nodes], np.int64)
    for s, kind, e in reversed(spans):
        fixed[np.searchsorted(stops, s, "right"):np.searchsorted(starts, e, "left")] = kind + 1
    hub: dict[str, int] = {}  # of each key the first match, or else the first token
    for here, own in enumerate(keys):
        for key in own:
            if key not in hub or (fixed[hub[key]] < 0 <= fixed[here]):
                hub[key] = here
    skip = sorted({(min(hub[key], here), max(hub[key], here))
                   for here, own in enumerate(keys) for key in own if hub[key] != here})
    pairs = lambda links: np.array(links, np.int64).reshape(-1, 2)
    return nodes, np.array(shape, np.uint8).reshape(-1, WIDTH), fixed, pairs(chain), pairs(skip)


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Weights by pseudo-likelihood, with the pattern matches as labels and all else as `none`.

    Fitted on at most about `sample` documents that hold a digit or an at sign, chosen by a hash
    of the text. Without any, all weights are zero and nothing is ever added.
    """
    rows = texts_of(docs).where(F.col("text").rlike("[0-9@]"))
    share = min(1.0, sample / max(rows.count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20))).distinct()

    def make():
        def run(batch):
            out = {k: [] for k in ("shape", "fixed", "chain", "skip")}
            for text in batch.column("text").to_pylist():
                nodes, shape, fixed, chain, skip = graph(text, base_spans(text))
                if 0 < len(nodes) <= SAMPLE_NODES:
                    for k, v in (("shape", shape), ("fixed", fixed), ("chain", chain), ("skip", skip)):
                        out[k].append(v.tobytes())
            return {k: pa.array(v, pa.binary()) for k, v in out.items()}
        return run

    held = map_slices(chosen, make, "shape binary, fixed binary, chain binary, skip binary").collect()
    n_labels = len(LABELS)
    model = {"unary": np.zeros((WIDTH, n_labels)), "chain": np.zeros((n_labels, n_labels)),
             "skip": np.zeros((n_labels, n_labels))}
    if not held:
        return model
    held.sort(key=lambda r: (bytes(r["shape"]), bytes(r["skip"])))
    shape = np.concatenate([np.frombuffer(r["shape"], np.uint8).reshape(-1, WIDTH) for r in held]).astype(float)
    label = np.maximum(np.concatenate([np.frombuffer(r["fixed"], np.int8) for r in held]), 0).astype(int)
    base = np.cumsum([0] + [len(r["fixed"]) for r in held])
    links = {k: np.concatenate([np.frombuffer(r[k], np.int64).reshape(-1, 2) + b
                                for r, b in zip(held, base)]) for k in ("chain", "skip")}
    truth = np.eye(n_labels)[label]
    around = {}
    for k, pairs in links.items():
        around[k] = [np.zeros((len(label), n_labels)), np.zeros((len(label), n_labels))]
        np.add.at(around[k][0], pairs[:, 1], truth[pairs[:, 0]])  # labels before
        np.add.at(around[k][1], pairs[:, 0], truth[pairs[:, 1]])  # labels after
    moment, square = {k: 0.0 for k in model}, {k: 0.0 for k in model}
    for step in range(1, 301):
        score = shape @ model["unary"]
        for k in links:
            score += around[k][0] @ model[k] + around[k][1] @ model[k].T
        score -= score.max(1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(1, keepdims=True)
        off = (truth - p) / len(label)
        slope = {"unary": shape.T @ off - 1e-4 * model["unary"]}
        for k in links:
            slope[k] = around[k][0].T @ off + off.T @ around[k][1] - 1e-4 * model[k]
        slope["skip"] = (slope["skip"] + slope["skip"].T) / 2
        for k, g in slope.items():
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            model[k] = model[k] + 0.1 * (moment[k] / (1 - 0.9**step)) / (
                np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return model


def beliefs(model: dict, shape: np.ndarray, fixed: np.ndarray, chain: np.ndarray,
            skip: np.ndarray) -> np.ndarray:
    """Label probabilities by damped sum-product over all links of one or more documents.

    Held at once are a few numbers for each label of a node and of a link.
    """
    n = len(LABELS)
    own = shape.astype(float) @ model["unary"]
    held = fixed >= 0
    own[held] = np.where(np.eye(n, dtype=bool)[fixed[held]], 0.0, -60.0)
    # (from, to, potential, opposite direction)
    ways = [(chain[:, 0], chain[:, 1], model["chain"], 1), (chain[:, 1], chain[:, 0], model["chain"].T, 0),
            (skip[:, 0], skip[:, 1], model["skip"], 3), (skip[:, 1], skip[:, 0], model["skip"].T, 2)]
    sent = [np.zeros((len(src), n)) for src, *_ in ways]
    for _ in range(PASSES if len(chain) + len(skip) else 0):
        total = own.copy()
        for (_, dst, _, _), message in zip(ways, sent):
            np.add.at(total, dst, message)
        change, after = 0.0, []
        for (src, _, potential, back), message in zip(ways, sent):
            out = total[src] - sent[back]
            top = out.max(1, keepdims=True, initial=-np.inf)
            new = np.log(np.exp(out - top) @ np.exp(potential))
            new -= new.max(1, keepdims=True, initial=-np.inf)
            new = DAMPING * message + (1 - DAMPING) * new
            change = max(change, float(np.abs(new - message).max(initial=0)))
            after.append(new)
        sent = after
        if change < SETTLED:
            break
    for (_, dst, _, _), message in zip(ways, sent):
        np.add.at(own, dst, message)
    own -= own.max(1, keepdims=True, initial=-np.inf)
    p = np.exp(own)
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, spans: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """Spans of free tokens that the field is sure of; linked neighbours of one label are one span.

    A number of a card's length that fails its check digit is none.
    """
    nodes, shape, fixed, chain, skip = graph(text, spans)
    if not nodes or not model["unary"].any():
        return []
    p = beliefs(model, shape, fixed, chain, skip)
    best = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    best[fixed >= 0] = 0
    joined = {b for a, b in chain.tolist() if best[a] and best[a] == best[b]}
    out = []
    for i in np.flatnonzero(best).tolist():
        start, end = nodes[i]
        if i in joined and out:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((start, int(best[i]) - 1, end))
    trimmed = []
    for start, kind, end in out:
        while start < end and text[start] in ".,;:!?\"'[]{}<>|":
            start += 1
        while start < end and text[end - 1] in ".,;:!?\"'[]{}<>|":
            end -= 1
        digits = re.sub("[^0-9]", "", text[start:end])
        fails = kind == KINDS.index("card") and 12 <= len(digits) <= 19 and not luhn(digits)
        if start < end and not fails:
            trimmed.append((start, kind, end))
    return trimmed


def find(docs: DataFrame, model: dict, *keys: str) -> DataFrame:
    """The key columns with base and added spans, one row for each row of docs.

    base and added are arrays of (start, kind, end) in code points, the end exclusive. A null text
    is an empty one; repeated rows give repeated results; an empty table gives none.
    """
    kinds = dict(docs.dtypes)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))

    def make():
        def run(batch):
            texts = batch.column("text")
            base = [[] for _ in range(len(texts))]
            added = [[] for _ in range(len(texts))]
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, "[0-9@]")).to_pylist():
                text = texts[i].as_py()
                base[i] = base_spans(text)
                added[i] = added_spans(text, base[i], model)
            named = lambda rows: pa.array([[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in r]
                                           for r in rows], span)
            return {**{k: batch.column(k) for k in keys}, "base": named(base), "added": named(added)}
        return run

    struct = "array<struct<start:long,kind:string,end:long>>"
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"base {struct}, added {struct}"])
    return map_slices(texts_of(docs, *keys), make, schema)


def span_text(spans):
    """kind:start:end, comma-joined, by start and then by kind as listed in KINDS."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.array_position(order, s["kind"]).alias("place"),
        s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(docs: DataFrame, model: dict) -> DataFrame:
    """docs with every found span of a text replaced by its kind in angle brackets.

    A null text stays null. A column n_chars of a changed text becomes its length; all other columns
    and rows stay as they are.
    """
    names, schema = docs.columns, docs.schema

    def make():
        def run(batch):
            at = batch.schema.get_field_index("text")
            texts, changed = batch.column(at).to_pylist(), []
            hits = pc.fill_null(pc.match_substring_regex(batch.column(at), "[0-9@]"), False)
            for i in pc.indices_nonzero(hits).to_pylist():
                text, parts, done = texts[i], [], 0
                spans = base_spans(text)
                for start, kind, end in sorted(spans + added_spans(text, spans, model)):
                    if end > done:
                        parts += [text[done:max(start, done)], f"<{KINDS[kind]}>" if start >= done else ""]
                        done = end
                if parts:
                    texts[i] = "".join([*parts, text[done:]])
                    changed.append(i)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.column(at).type))
            size = batch.schema.get_field_index("n_chars")
            if size >= 0 and changed:
                sizes = batch.column(size).to_pylist()
                for i in changed:
                    sizes[i] = len(texts[i])
                batch = batch.set_column(size, batch.schema.field(size), pa.array(sizes, batch.column(size).type))
            return batch
        return run

    return map_slices(docs.select(*names), make, schema)
