"""Queries of the corpus operators over the driver's tables, with their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unimass.llm import (alignment, impact, langid, latent, lattice, lengths, packing, pii, quality, replies, simhash,
                         suffixes, whitening)
from unimass.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_token_lengths")
def token_lengths(spark, sf_dir):
    return lengths.suffix_sums(lengths.length_histogram(table(spark, sf_dir, "documents")))


@query("op2_personal_data")
def personal_data(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs), "doc_id")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS],
        F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"),
        pii.span_text(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"))


@query("op3_benchmark_leaks")
def benchmark_leaks(spark, sf_dir):
    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_repeated_bytes")
def repeated_bytes(spark, sf_dir):
    return suffixes.removed(table(spark, sf_dir, "documents"))


@query("op5_lattice_scores")
def lattice_scores(spark, sf_dir):
    return lattice.scores(table(spark, sf_dir, "documents"), langid.fold_of("doc_id", 7) == 2)


@query("op6_simhash")
def simhash_components(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


@query("op7_exact_top_k", """
WITH parts AS (
  SELECT vec_id, embedding, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM parts WHERE x IS NULL OR NOT isfinite(x)),
whole AS (SELECT vec_id, d, floor(256 * x)::BIGINT AS v FROM parts ANTI JOIN bad USING (vec_id)),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.v * c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id, score
FROM scores QUALIFY rank <= 5""")
def exact_top_k(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return impact.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op8_language_id")
def language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.fold_of("doc_id", 3) != 1))
    found = langid.identify(docs, model, "doc_id")
    held_out = F.coalesce(langid.fold_of("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


@query("op9_packing")
def pack_windows(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query("op10_quality")
def document_quality(spark, sf_dir):
    found = materialize(quality.profiles(table(spark, sf_dir, "documents")), "profiles")
    fold = langid.fold_of("doc_id", 4)
    model = quality.fit(found.where(fold != 2), table(spark, sf_dir, "labels").where(fold != 2))
    return quality.scored(found, model).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


@query("op11_whitening")
def whitened_embeddings(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: A conversation whose texts hold control strings, formatted with all others.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op12_reply_trees", r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM turns),
sized AS (
  SELECT *, length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) + sum_of AS size FROM (
    SELECT *, list_sum([length(regexp_replace(regexp_replace(t,
        '<(\\*(?:\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|unk>|<SYS>>|</SYS>>))', '<\\\1', 'g'),
        '\[(\\*(?:INST\]|/INST\]))', '[\\\1', 'g'))
      FOR t IN [text, replace(replace(role, '\', '\s'), chr(10), '\n')]]) AS sum_of FROM numbered)),
joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS turns,
    coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '') AS learned,
    sum(size)::BIGINT AS formatted_chars
  FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned)::BIGINT AS loss_chars,
       sha256(learned) AS loss_sha256, formatted_chars
FROM joined""")
def reply_trees(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    found = replies.digests(replies.formatted(replies.best_paths(replies.chains(turns.union(planted)))))
    return found.select(F.col("tree").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256",
                        "formatted_chars")


@query("op13_alignment")
def token_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"))
