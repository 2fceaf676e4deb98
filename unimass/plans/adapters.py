"""The driver's tables seen as the domain tables, with the matching SQL for the oracle.

Every adapter keeps all rows of its table; ids are only regrouped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODELS = ("alexnet_ecoset", "alexnet_imagenet", "vgg16_ecoset", "vgg16_imagenet")
CATEGORIES = ("face", "body", "scene", "object", "scrambled")
BLOCK = 8
UNITS = 16


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def activation_blocks(t) -> DataFrame:
    """embeddings -> block arrays: 4 models by vector, 4 layers of 16 units by position."""
    parts = F.explode(F.array(*[
        F.struct(F.lit(f"conv{1 + s // UNITS}").alias("layer"),
                 F.lit(s % UNITS // BLOCK).alias("block_id"),
                 F.slice("embedding", s + 1, BLOCK).alias("acts"))
        for s in range(0, 64, BLOCK)]))
    return t.embeddings.select(
        _pick(MODELS, F.col("vec_id") % 4).alias("model"), F.col("vec_id").alias("image_id"),
        _pick(CATEGORIES, F.col("label") % 5).alias("category"), parts.alias("p")
    ).select("model", "image_id", "category", "p.*")


ACTS = f"""acts AS (
  SELECT {list(MODELS)}[1 + vec_id % 4] AS model, vec_id AS image_id,
         {list(CATEGORIES)}[1 + label % 5] AS category,
         'conv' || (1 + pos // 16) AS layer, pos % 16 AS unit_id,
         embedding[pos + 1]::DOUBLE AS act
  FROM embeddings, range(64) AS r(pos))"""


def line_responses(t) -> DataFrame:
    """lineitem -> long responses: unit = supplier, layer = status, category = return flag."""
    return t.lineitem.select(
        F.lit("line").alias("model"), F.col("l_linestatus").alias("layer"),
        F.col("l_suppkey").alias("unit_id"), F.col("l_returnflag").alias("category"),
        F.col("l_quantity").alias("act"))


LINES = """acts AS (
  SELECT 'line' AS model, l_linestatus AS layer, l_suppkey AS unit_id,
         l_returnflag AS category, l_quantity AS act FROM lineitem)"""


def trials(t) -> DataFrame:
    """events -> single trials: subject = type, session = week, voxel = user, image = k / 10."""
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select(
        F.col("event_type").alias("subject"),
        F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("session"),
        F.col("event_id").alias("trial_id"), F.col("user_id").alias("voxel_id"),
        F.floor(k / 10).cast("bigint").alias("image_id"), F.col("value").alias("beta"))


TRIALS = """trials AS (
  SELECT event_type AS subject, ((day(ts) - 1) // 7)::INT AS session, event_id AS trial_id,
         user_id AS voxel_id, (json_extract(props, '$.k')::INT // 10)::BIGINT AS image_id,
         value AS beta FROM events)"""


def voxels(t) -> DataFrame:
    """part -> voxels on a 20 x 20 x n grid at 1.8 mm; subject = part type."""
    p = F.col("p_partkey")
    i, j, k = p % 20, F.floor(p / 20) % 20, F.floor(p / 400)
    nc = (F.col("p_retailprice") % 97) / 97
    return t.part.select(
        F.col("p_type").alias("subject"), p.alias("voxel_id"),
        i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"),
        (1.8 * i - 18).alias("x"), (1.8 * j).alias("y"), (1.8 * k).alias("z"),
        nc.alias("nc"), ((F.col("p_size") - 1) / 49).alias("d_norm"),
        F.col("p_size"), F.col("p_brand"))


VOXELS = """voxels AS (
  SELECT p_type AS subject, p_partkey AS voxel_id, (p_partkey % 20)::INT AS i,
         (p_partkey // 20 % 20)::INT AS j, (p_partkey // 400)::INT AS k,
         1.8 * (p_partkey % 20)::DOUBLE - 18 AS x, 1.8 * (p_partkey // 20 % 20)::DOUBLE AS y,
         1.8 * (p_partkey // 400)::DOUBLE AS z, (p_retailprice % 97) / 97 AS nc,
         (p_size - 1) / 49 AS d_norm, p_size, p_brand FROM part)"""

# ROI name -> SQL predicate over a part; both engines read the same text.
ROIS = {
    "FFA": "p_size <= 20",
    "FBA": "p_size BETWEEN 15 AND 30",
    "PPA": "p_size >= 40",
    "V1": "p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#11')",
}
LABELS = {
    "face": "(p_size + voxel_id) % 5 = 0",
    "body": "(p_size + voxel_id) % 5 = 1",
    "mixed": "(p_size + voxel_id) % 5 = 2",
    "non": "(p_size + voxel_id) % 5 = 3",
    "other": "(p_size + voxel_id) % 10 = 4",
    "responsive": "p_brand <> 'Brand#5'",
}


def _labelled(df: DataFrame, spec: dict, name: str) -> DataFrame:
    hits = F.explode(F.array_compact(F.array(*[
        F.when(F.expr(rule), F.lit(key)) for key, rule in spec.items()])))
    return df.select("subject", "voxel_id", hits.alias(name))


def roi_members(t) -> DataFrame:
    """Long ROI membership (presence = member)."""
    return _labelled(voxels(t), ROIS, "roi")


def voxel_labels(t) -> DataFrame:
    return _labelled(voxels(t), LABELS, "label")


def _union(spec: dict, name: str) -> str:
    return " UNION ALL ".join(
        f"SELECT subject, voxel_id, '{key}' AS {name} FROM voxels WHERE {rule}"
        for key, rule in spec.items())


ROI_MEMBERS = f"{VOXELS}, members AS ({_union(ROIS, 'roi')})"
VOXEL_LABELS = f"{VOXELS}, labels_of AS ({_union(LABELS, 'label')})"

# Measures of an encoding fit as averages over the order lines of a part.
MEASURES = {
    "f": "avg(l_discount)",
    "b": "avg(l_tax)",
    "m": "avg(l_discount * l_quantity) / 49",
    "ns": "avg(l_tax * l_quantity) / 49",
    "r2_f": "avg(l_discount)",
    "r2_b": "avg(l_tax)",
    "r2_fb": "avg(l_discount + l_tax) * 0.8",
    "r2_fbm": "avg(l_discount + l_tax + l_quantity / 500) * 0.8",
}
LAYERS = {"F": "conv5", "O": "fc7"}


def encoding(t) -> DataFrame:
    """lineitem by part and status -> long encoding table (layer = status, voxel = part)."""
    sums = t.lineitem.groupBy("l_partkey", "l_linestatus").agg(
        *[F.expr(rule).alias(m) for m, rule in MEASURES.items()])
    layer = F.when(F.col("l_linestatus") == "F", "conv5").otherwise("fc7")
    subject = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("subject"))
    wide = sums.join(subject, "l_partkey").select(
        F.lit("alexnet_ecoset").alias("model"), layer.alias("layer"), "subject",
        F.col("l_partkey").alias("voxel_id"), *MEASURES)
    return wide.unpivot(["model", "layer", "subject", "voxel_id"], list(MEASURES),
                        "measure", "value")


_measure_cols = ", ".join(f"{rule} AS {m}" for m, rule in MEASURES.items())
ENC_WIDE = f"""enc_wide AS (
  SELECT 'alexnet_ecoset' AS model, CASE l_linestatus WHEN 'F' THEN 'conv5' ELSE 'fc7' END AS layer,
         p_type AS subject, l_partkey AS voxel_id, {_measure_cols}
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_partkey, l_linestatus, p_type)"""
ENCODING = ENC_WIDE + ", encoding AS (" + " UNION ALL ".join(
    f"SELECT model, layer, subject, voxel_id, '{m}' AS measure, {m} AS value FROM enc_wide"
    for m in MEASURES) + ")"


def flags(t) -> DataFrame:
    """lineitem -> 0/1 flags: task = return flag, repeat = line number, image = order."""
    cond = F.explode(F.array(*[
        F.struct(F.lit(c).alias("condition"), F.expr(rule).cast("int").alias("correct"))
        for c, rule in FLAG_RULES.items()]))
    return t.lineitem.select(
        F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("repeat"),
        F.concat_ws(":", "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_shipdate").alias("image_id"), cond.alias("c")
    ).select("task", "repeat", "image_id", "c.*")


FLAG_RULES = {
    "baseline": "l_discount < 0.09",
    "face": "l_discount < 0.08 AND l_tax < 0.07",
    "body": "l_discount < 0.08 AND l_tax < 0.05",
    "mixed": "l_discount < 0.07",
    "nonselective": "l_discount < 0.09 AND l_tax < 0.08",
}


def hierarchy(t) -> DataFrame:
    """customer in nation in region -> units in layers in models; d' from the balance."""
    return (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("r_name").alias("model"), F.col("n_name").alias("layer"),
                F.col("c_custkey").alias("unit_id"), F.col("c_mktsegment").alias("sel_type"),
                (F.col("c_acctbal") / 1000 - 4).alias("face_d"),
                ((F.col("c_custkey") % 7) - 3 + F.col("c_acctbal") / 5000).alias("body_d")))


HIERARCHY = """units AS (
  SELECT r_name AS model, n_name AS layer, c_custkey AS unit_id, c_mktsegment AS sel_type,
         c_acctbal / 1000 - 4 AS face_d, c_custkey % 7 - 3 + c_acctbal / 5000 AS body_d
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
