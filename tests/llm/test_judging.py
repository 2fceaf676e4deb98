"""Personal data, languages and quality: exact parts by brute force, learned parts on held-out rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from unimass.llm import langid, pii, quality

SCHEMA = "doc_id long, text string, lang string, base string, score double, x string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "b", 0.1, "x", len(t or "")) for i, t, lang in rows], SCHEMA)


def plain_spans(text):
    def passes(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == 1:
            return all(int(p) <= 255 for p in s.split("."))
        if kind == 2:
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
                r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
                r"\+[0-9][\x20().0-9-]+[0-9]")
    return sorted((m.start(), k, m.end()) for k, p in enumerate(patterns)
                  for m in re.finditer(p, text) if passes(k, m[0]))


def test_patterns_match_plain_regexes():
    rng = np.random.default_rng(1)
    alphabet = list("aZ09@.+- ()_%12345é\n")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(text) == plain_spans(text)
    for text in ("4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "a@b@c.de", "x@y..z", "+1 (017) 555-7713",
                 "007.1.1.1", "256.1.1.1", "@a.b", "a@b.c@d.e"):
        assert pii.base_spans(text) == plain_spans(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 150_000, "+" * 100_000, "@" * 100_000,
                 "1 " * 100_000, "+1" + " " * 200_000):
        pii.base_spans(text)


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        card = "4111111111111111" if i % 2 else "5500005555555559"
        rows.append((i, f"word {rng.integers(10, 99)} mail user{i}@mail{i % 7}.example.com then +1 (2{i % 10}7) "
                        f"555-{1000 + i} and 10.{i % 200}.3.4 or {card}.", "en"))
    return table(spark, rows)


def test_field_adds_linked_tokens_only(spark, people):
    model = pii.fit(people)
    docs = table(spark, [
        (1, "call +1 (234) 555-7713 now, yes (234) 555-7713 again", "en"),
        (2, "just 12 apples and 34 pears", "en"), (3, None, "en"), (4, "", "en"), (5, "plain words", None)])
    got = {r["doc_id"]: r for r in pii.find(docs, model, "doc_id").collect()}
    text = "call +1 (234) 555-7713 now, yes (234) 555-7713 again"
    assert [(s["start"], s["kind"], s["end"]) for s in got[1]["base"]] == [(5, "phone", 22)]
    added = [text[s["start"]:s["end"]] for s in got[1]["added"]]
    assert added and all("555-7713" in a for a in added)
    assert all(not got[i]["added"] and not got[i]["base"] for i in (2, 3, 4, 5))


@pytest.mark.parametrize("marked, bare", [
    ("+1 (234) 555-7713", "(234) 555-7713"), ("+49 30 5557713", "30 5557713"), ("+1 (217) 555-1044", "(217) 555-1044")])
def test_every_repeat_of_an_entity_gets_its_label(spark, people, marked, bare):
    """Labels are the same all over a document, before the match and after it, for any number of repeats."""
    model = pii.fit(people)
    for before, after in ((0, 1), (0, 500), (250, 250)):
        parts = [f"no {bare} seen"] * before + [f"call {marked} now"] + [f"no {bare} seen"] * after
        text = " . ".join(parts)
        nodes, shape, fixed, chain, skip = pii.graph(text, pii.base_spans(text))
        p = pii.beliefs(model, shape, fixed, chain, skip).argmax(1)
        words = [text[s:e] for s, e in nodes]
        labels = {w: {int(k) for x, k, f in zip(words, p, fixed) if x == w and f < 0} for w in set(words)}
        assert all(len(k) <= 1 for k in labels.values())
        added = pii.added_spans(text, pii.base_spans(text), model)
        if bare.startswith("("):
            assert sum("555-" in text[s:e] for s, _, e in added) == before + after
            assert {k for _, k, _ in added} == {pii.KINDS.index("phone")}


def test_numbers_that_fail_their_check_digit_are_not_added(spark, people):
    model = pii.fit(people)
    for number in ("4111-1111-1111-1112", "4111111111111112"):
        text = " and ".join([number] * 60 + ["4111 1111 1111 1111", "4111111111111111"])
        added = [text[s:e] for s, _, e in pii.added_spans(text, pii.base_spans(text), model)]
        assert not any(number in a for a in added)


def test_fits_take_a_hard_number_of_rows(spark, monkeypatch):
    """One repeated row that fills most of a table is one text; a label's repeated profiles are one."""
    rows = [(i, f"text of {i} words in the language {'ab' if i % 2 else 'cd'}", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(None, "the same again", "en")] * 300
    seen = []
    profiles = langid.map_slices
    monkeypatch.setattr(langid, "map_slices", lambda df, *a: seen.append(df) or profiles(df, *a))
    langid.fit(table(spark, rows), sample=20)
    texts = seen[0].groupBy("lang").count().collect()
    assert 0 < max(r["count"] for r in texts) <= 10
    many = langid.fit(table(spark, [(i, f"words of language {i}", f"l{i:03}") for i in range(300)] + [(1, "again", "l299")]))
    assert len(many["names"]) == 256 and "l299" in many["names"]
    found = spark.createDataFrame([(i % 30, [float(i % 7)] * len(quality.NAMES)) for i in range(600)], "doc_id long, x array<float>")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int")
    grown = []
    monkeypatch.setattr(quality, "grow", lambda x, y: grown.append(len(x)) or {})
    quality.fit(found, labels, sample=12)
    assert grown[0] <= 12


def test_message_passing_is_exact_on_a_chain():
    rng = np.random.default_rng(3)
    n = len(pii.LABELS)
    model = {"unary": rng.normal(size=(pii.WIDTH, n)), "chain": rng.normal(size=(n, n)), "skip": np.zeros((n, n))}
    shape = rng.integers(0, 2, (3, pii.WIDTH))
    chain, none = np.array([[0, 1], [1, 2]]), np.zeros((0, 2), int)
    got = pii.beliefs(model, shape, np.full(3, -1), chain, none)
    own = shape @ model["unary"]
    joint = np.exp(own[0][:, None, None] + own[1][None, :, None] + own[2][None, None, :]
                   + model["chain"][:, :, None] + model["chain"][None, :, :])
    joint /= joint.sum()
    for i, axes in enumerate(((1, 2), (0, 2), (0, 1))):
        assert got[i] == pytest.approx(joint.sum(axes), abs=1e-4)


def test_masking(spark, people):
    model = pii.fit(people)
    docs = table(spark, [(1, "mail a.b@c.de or 10.0.0.1!", "en"), (2, None, "en"), (3, "none", "en")])
    got = {r["doc_id"]: r for r in pii.masked(docs, model).collect()}
    assert got[1]["text"] == "mail <email> or <ip>!" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "none" and got[3]["base"] == "b"


def test_span_text_orders_by_start_and_kind(spark):
    df = spark.sql("SELECT array(named_struct('start', 9L, 'kind', 'card', 'end', 20L), "
                   "named_struct('start', 9L, 'kind', 'email', 'end', 12L), "
                   "named_struct('start', 1L, 'kind', 'phone', 'end', 5L)) AS s")
    assert df.select(pii.span_text(F.col("s"))).first()[0] == "phone:1:5,email:9:12,card:9:20"


def test_no_candidates_to_learn_from(spark):
    docs = table(spark, [(1, "no numbers", "en")])
    model = pii.fit(docs)
    assert not model["unary"].any()
    assert pii.find(docs.limit(0), model, "doc_id").count() == 0


SYLLABLES = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ich", "ei", "tz"],
             "fr": ["eau", "que", "oi", "é", "ment"], "es": ["ción", "ll", "rr", "ñ", "que"]}


@pytest.fixture(scope="module")
def tongues(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(SYLLABLES[lang], 3)) for _ in range(rng.integers(3, 40))), lang)
            for i, lang in enumerate(list(SYLLABLES) * 100)]
    return table(spark, rows)


def test_languages_of_held_out_rows(tongues):
    fold = langid.fold_of("doc_id", 3)
    model = langid.fit(tongues.where(fold != 1), sample=200)
    got = langid.identify(tongues.where(fold == 1), model, "doc_id", "lang").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_odd_texts_have_a_language_or_none(spark, tongues):
    model = langid.fit(tongues)
    odd = table(spark, [(1, None, "en"), (2, "", "en"), (3, "12 !! 34", "en"), (4, "é", None),
                        (5, "thinger " * 50_000, None), (None, "schung tzei", "de")])
    got = {r["doc_id"]: r for r in langid.identify(odd, model, "doc_id").collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert got[4]["lang_pred"] in SYLLABLES and got[5]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert {r["doc_id"] for r in langid.in_a_language(odd, model).collect()} == {4, 5, None}
    assert langid.identify(odd.limit(0), model, "doc_id").count() == 0


def test_without_learned_languages(tongues):
    none = langid.fit(tongues.limit(0))
    assert {r["lang_pred"] for r in langid.identify(tongues.limit(5), none, "doc_id").collect()} == {"und"}
    assert langid.in_a_language(tongues.limit(5), none).count() == 5
    one = langid.fit(tongues.where("lang = 'fr'"))
    assert {r["lang_pred"] for r in langid.identify(tongues.limit(5), one, "doc_id").collect()} == {"fr"}


@pytest.mark.parametrize("classes", [2, 3, 5, 7, 12, 40])
def test_codewords_are_apart(classes):
    code = langid.codewords(classes)
    apart = (code.shape[1] - code @ code.T) / 2
    np.fill_diagonal(apart, 99)
    assert apart.min() >= (1 if classes == 2 else 2 if classes == 3 else 4)
    assert (np.abs(code.sum(0)) < classes).all()


def test_trees_walk_as_written():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 6)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.grow(x, y, rounds=40, depth=3)
    p = quality.probability(model, x)
    assert np.mean((p > 0.5) == y) > 0.95
    for row in range(5):
        margin = model["start"]
        for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(x[row, feature[node]] > cut[node])
            margin += leaf[node - 7]
        assert p[row] == pytest.approx(1 / (1 + np.exp(-margin)))


def test_quality_of_held_out_rows(spark):
    rng = np.random.default_rng(6)
    rows, marks = [], []
    for i in range(600):
        words = ["".join(rng.choice(list("aeioubcdf"), 5)) for _ in range(rng.integers(5, 60))]
        good = i % 3 != 0
        rows.append((i, " ".join(words) + "." if good else " | ".join(words), "en"))
        marks.append((i, int(good), 0))
    docs = table(spark, [*rows, (1000, None, None), (1001, "", None), (None, "x y", None)])
    labels = spark.createDataFrame([*marks, (5000, 1, 0), (3, None, 0), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    found = quality.profiles(docs)
    fold = langid.fold_of("doc_id", 4)
    model = quality.fit(found.where(fold != 2), labels.where(fold != 2))
    got = {r["doc_id"]: r["score"] for r in quality.scored(found, model).collect()}
    held = [i for i in range(600) if quality_fold(i) == 2]
    assert np.mean([(got[i] >= quality.CUT) == (i % 3 != 0) for i in held]) > 0.98
    assert len(got) == 603 and all(0 <= s <= 1 for s in got.values())
    assert quality.scored(found.limit(0), model).count() == 0
    flat = quality.fit(found, labels.limit(0))
    assert {r["score"] for r in quality.scored(found, flat).collect()} == {0.5}


def quality_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 4
