"""Scans and sinks of the domain tables, and the checks that come with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unimass.sources.publish import published, replace

VOX = ("subject", "voxel_id")


def require_columns(df: DataFrame, columns) -> DataFrame:
    """The table itself; raises if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def scan_table(spark: SparkSession, path: str, columns=(), **partitions) -> DataFrame:
    """Parquet table restricted to partition values; filters and columns reach the scan."""
    df = spark.read.parquet(path)
    for name, value in partitions.items():
        values = value if isinstance(value, (list, tuple)) else [value]
        df = df.filter(F.col(name).isin(*values))
    return require_columns(df, columns).select(*columns) if columns else df


def scan_activations(spark, path, model=None, layers=None) -> DataFrame:
    """activations(model, layer, image_id, block_id, acts), pruned by model and layer."""
    wanted = {k: v for k, v in (("model", model), ("layer", layers)) if v}
    return scan_table(spark, path, ("model", "layer", "image_id", "block_id", "acts"), **wanted)


def scan_responses(responses: DataFrame, wanted: DataFrame, block_size: int,
                   scale: float | None = None) -> DataFrame:
    """Long responses of a subset of voxels from block arrays.

    Whole blocks without a wanted voxel are skipped before the arrays are opened; `scale`
    divides quantised values.
    """
    want = wanted.select(*VOX).withColumn("voxel_block", F.floor(F.col("voxel_id") / block_size).cast("int"))
    blocks = responses.join(want.select("subject", "voxel_block").distinct(),
                            ["subject", "voxel_block"], "left_semi")
    long = blocks.select("subject", "image_id", "voxel_block", F.posexplode("resp").alias("_p", "resp"))
    value = F.col("resp").cast("double") / scale if scale else F.col("resp")
    return long.select(
        "subject", "image_id",
        (F.col("voxel_block").cast("bigint") * block_size + F.col("_p")).alias("voxel_id"),
        value.alias("resp")).join(want.select(*VOX), list(VOX), "left_semi")


def select_labels(labels: DataFrame, wanted, responsive: bool = False,
                  strict: bool = False) -> DataFrame:
    """Label rows of the wanted labels, optionally only of responsive voxels.

    strict: a label that no voxel of a subject carries raises.
    """
    out = labels.filter(F.col("label").isin(*wanted))
    if strict:
        require_labels(labels, wanted)
    if responsive:
        on = labels.filter(F.col("label") == "responsive").select(*VOX)
        out = out.join(on, list(VOX), "left_semi")
    return out


def require_labels(labels: DataFrame, wanted) -> None:
    """Raise if a subject has no voxel of a wanted label."""
    every = labels.select("subject").distinct().select(
        "subject", F.explode(F.array(*[F.lit(w) for w in wanted])).alias("label"))
    gaps = every.join(labels.select("subject", "label").distinct(), ["subject", "label"], "left_anti")
    missing = sorted((r["subject"], r["label"]) for r in gaps.limit(20).collect())
    if missing:
        raise ValueError(f"missing voxel labels {missing}")


def any_label(labels: DataFrame, wanted) -> DataFrame:
    """Voxels with any of the labels; unknown labels are skipped."""
    return labels.filter(F.col("label").isin(*wanted)).select(*VOX).distinct()


def scan_voxel_labels(spark, path, subject_col="subject", columns=None) -> DataFrame:
    """Wide CSV with one 0/1 column per label -> long labels (presence = 1)."""
    wide = spark.read.csv(path, header=True)
    names = [c for c in wide.columns if c not in (subject_col, "voxel_id")]
    if columns is not None:
        require_columns(wide, columns)
        names = list(columns)
    flags = wide.select(F.col(subject_col).alias("subject"), F.col("voxel_id").cast("bigint").alias("voxel_id"),
                        *[F.col(f"`{c}`").cast("double").alias(c) for c in names])
    return flags.unpivot(list(VOX), [f"`{c}`" for c in names], "label", "_v").filter(
        F.col("_v") != 0).drop("_v")


LABEL_PARTS, ENCODING_PARTS = ("subject", "label"), ("model", "layer", "subject")


def upsert_voxel_labels(labels: DataFrame, path: str, voxels: DataFrame, subjects, names=None) -> None:
    """Replace the given subjects' voxels of each label; all must lie in the brain mask.

    `names` are the labels to replace, by default those that the table holds; one without any
    voxel of a subject loses what was stored for it. Readers see all of the change or none.
    """
    brain = voxels.select(*VOX)
    stray = labels.join(brain, list(VOX), "left_anti")
    if stray.head(1):
        raise ValueError("labels name voxels outside the brain mask: wrong subject?")
    known = {r["subject"] for r in brain.select("subject").distinct().collect()}
    unknown = [s for s in subjects if s not in known]
    if unknown:
        raise ValueError(f"no brain mask for {unknown}")
    new = labels.filter(F.col("subject").isin(*subjects)).select("voxel_id", "subject", "label")
    if names is not None:
        new = new.filter(F.col("label").isin(*names))
    # a label that is replaced and has no voxel any more goes in the same step
    replace(new, path, LABEL_PARTS, [(s, n) for s in subjects for n in names or ()])


def read_voxel_labels(spark: SparkSession, path: str) -> DataFrame:
    """(subject, voxel_id, label) as last published."""
    return published(spark, path, LABEL_PARTS).select("subject", "voxel_id", "label")


# Localizer categories and the domain each belongs to, aliases of the domains,
# labels of blank periods, the domains, and the columns that may hold a label.
CATEGORY_DOMAIN = {
    "adult": "faces", "child": "faces", "body": "bodies", "limb": "bodies",
    "car": "objects", "instrument": "objects", "corridor": "places", "house": "places",
    "word": "characters", "number": "characters",
}
DOMAIN_ALIAS = {
    "face": "faces", "faces": "faces", "body": "bodies", "bodies": "bodies",
    "object": "objects", "objects": "objects", "place": "places", "places": "places",
    "scene": "places", "scenes": "places", "character": "characters",
    "characters": "characters", "word": "characters", "words": "characters",
    "text": "characters",
}
BLANK = ("blank", "baseline", "fixation", "rest", "null", "none", "n/a", "nan", "")
DOMAINS = ("faces", "bodies", "objects", "places", "characters")
LABEL_COLUMNS = ("domain", "trial_type", "category", "condition")


def canonical_events(events: DataFrame, label_col: str | None = None,
                     aliases: dict | None = None) -> DataFrame:
    """Events with a canonical domain: trimmed, lower-cased, aliased, blanks dropped.

    The first of domain / trial_type / category / condition is used. A label that is neither
    known nor blank raises.
    """
    if label_col is None:
        label_col = next((c for c in LABEL_COLUMNS if c in events.columns), None)
        if label_col is None:
            raise ValueError(f"no label column among {events.columns}")
    table = {**CATEGORY_DOMAIN, **DOMAIN_ALIAS} if aliases is None else aliases
    raw = F.coalesce(F.lower(F.trim(F.col(label_col).cast("string"))), F.lit("nan"))
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    seen = events.withColumn("_raw", raw).filter(~F.col("_raw").isin(*BLANK)).withColumn(
        "trial_type", F.try_element_at(pairs, F.col("_raw")))
    unknown = [r["_raw"] for r in seen.filter(F.col("trial_type").isNull())
               .select("_raw").distinct().limit(20).collect()]
    if unknown:
        raise ValueError(f"no domain for {sorted(unknown)} (column {label_col!r})")
    keep = [c for c in ("subject", "run") if c in events.columns]
    return seen.select(*keep, F.col("onset").cast("double").alias("onset"),
                       F.col("duration").cast("double").alias("duration"), "trial_type")


def scan_events(spark: SparkSession, path: str, label_col: str | None = None,
                aliases: dict | None = None) -> DataFrame:
    """BIDS events.tsv files -> canonical events (subject, run, onset, duration, trial_type).

    Files rarely hold the subject and run: where the columns are missing they come from the path,
    `sub-01` as subj01 and `run-2` (or a folder run=2) as 2.
    """
    raw = spark.read.csv(path, sep="\t", header=True, recursiveFileLookup=True)
    place = F.input_file_name()
    told = {"subject": F.concat(F.lit("subj"), F.lpad(
                F.nullif(F.regexp_extract(place, r"sub-0*([0-9]+)", 1), F.lit("")), 2, "0")),
            "run": F.nullif(F.regexp_extract(place, r"run[-=]0*([0-9]+)", 1), F.lit("")).cast("int")}
    for name, value in told.items():
        if name not in raw.columns:
            raw = raw.withColumn(name, value)
    return canonical_events(raw, label_col, aliases).orderBy("subject", "run", "onset")


def missing_domains(events: DataFrame, domains=DOMAINS) -> DataFrame:
    """(subject, run, domain) that a run lacks; empty when every run has every domain."""
    wanted = events.select("subject", "run").distinct().select(
        "subject", "run", F.explode(F.array(*[F.lit(d) for d in domains])).alias("trial_type"))
    return wanted.join(events.select("subject", "run", "trial_type").distinct(),
                       ["subject", "run", "trial_type"], "left_anti")


def check_inputs(runs: DataFrame, events: DataFrame, expected: DataFrame) -> DataFrame:
    """Problems of a localizer's inputs, one row each; empty when all is well.

    `runs` is (subject, run, tr), `expected` is (subject, run).
    """
    problem = lambda df, text: df.select("subject", "run", F.lit(text).alias("problem"))
    have = runs.select("subject", "run").distinct()
    told = events.select("subject", "run").distinct()
    tr = runs.groupBy("subject").agg(F.countDistinct(F.round("tr", 4)).alias("k"))
    return (
        problem(expected.join(have, ["subject", "run"], "left_anti"), "missing run")
        .unionByName(problem(have.join(told, ["subject", "run"], "left_anti"), "run without events"))
        .unionByName(problem(told.join(have, ["subject", "run"], "left_anti"), "events without run"))
        .unionByName(missing_domains(events).select(
            "subject", "run", F.concat(F.lit("no "), "trial_type").alias("problem")))
        .unionByName(tr.filter(F.col("k") > 1).select(
            "subject", F.lit(None).cast(runs.schema["run"].dataType).alias("run"),
            F.lit("runs disagree on TR").alias("problem"))))


def check_layers(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """(subject, layer) still to be computed."""
    return wanted.join(existing.select("subject", "layer").distinct(), ["subject", "layer"], "left_anti")


def layers_to_recompute(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """Cached and wanted layers together, if any wanted one is missing."""
    union = wanted.select("layer").union(existing.select("layer")).distinct()
    missing = check_layers(wanted, existing).select(F.lit(1).alias("_m")).limit(1)
    if not missing.head(1):
        return union.limit(0)
    return union


def require_layers(wanted: DataFrame, existing: DataFrame) -> None:
    """Raise before a run that lacks layers."""
    gaps = [(r["subject"], r["layer"]) for r in check_layers(wanted, existing).limit(20).collect()]
    if gaps:
        raise KeyError(f"layers missing from the stored activations: {gaps}")


def world_coordinates(voxels: DataFrame, affine) -> DataFrame:
    """Add world x, y, z of (i, j, k) by a 3 x 4 affine."""
    ijk = [F.col("i"), F.col("j"), F.col("k")]
    axes = [sum((float(a) * c for a, c in zip(row, ijk)), F.lit(0.0)) + float(row[3]) for row in affine[:3]]
    return voxels.select("*", *[v.alias(n) for n, v in zip("xyz", axes)])


def scan_voxels(mask: DataFrame, shape, affine) -> DataFrame:
    """Brain mask rows (subject, flat id) -> voxel_id, (i, j, k) and world coordinates.

    `mask` is (subject, flat); voxel_id counts the mask voxels in flat order.
    """
    from unimass.operators.ordering import global_order

    _, ny, nz = shape
    placed = global_order(mask.select("subject", "flat"), ["subject"], [F.col("flat")], "mask")
    flat = F.col("flat")
    grid = placed.select("subject", (F.col("pos") - 1).alias("voxel_id"),
                         F.floor(flat / (ny * nz)).alias("i"), (F.floor(flat / nz) % ny).alias("j"),
                         (flat % nz).alias("k"))
    return world_coordinates(grid, affine)


def scan_voxel_meta(spark, path) -> DataFrame:
    """voxel_meta(subject, voxel_id, nc, ncsnr, stream_id)."""
    return scan_table(spark, path, ("subject", "voxel_id", "nc", "ncsnr", "stream_id"))


def scan_image_meta(spark, path) -> DataFrame:
    """Image metadata CSV with JSON lists -> (subject, image_id, trial_ids, categories)."""
    raw = spark.read.csv(path, header=True, escape='"')
    # label lists are written with single quotes
    texts = F.replace("categories", F.lit("'"), F.lit('"'))
    return raw.select(
        "subject", F.col("image_id").cast("bigint").alias("image_id"),
        F.from_json("trial_ids", "array<int>").alias("trial_ids"),
        F.from_json(texts, "array<string>").alias("categories"))


def scan_stim_info(spark, path) -> DataFrame:
    """Stimulus table CSV -> long (subject, image_id, rep, trial); subjectK_repR columns."""
    wide = spark.read.csv(path, header=True)
    reps = [c for c in wide.columns if "_rep" in c]
    num = wide.select(F.col("image_id").cast("bigint").alias("image_id"),
                      *[F.col(c).cast("int").alias(c) for c in reps])
    long = num.unpivot(["image_id"], reps, "_c", "trial")
    number = F.regexp_extract("_c", r"subject(\d+)_rep", 1)
    return long.select(
        F.concat(F.lit("subj"), F.lpad(number, 2, "0")).alias("subject"), "image_id",
        F.regexp_extract("_c", r"_rep(\d+)", 1).cast("int").alias("rep"), "trial")


def write_encoding(encoding: DataFrame, path: str) -> None:
    """Replace exactly the (model, layer, subject) partitions that the rows hold, in one step."""
    replace(encoding, path, ENCODING_PARTS)


def read_encoding(spark: SparkSession, path: str, model: str, layer: str | None = None) -> DataFrame:
    """Encoding rows of one model; raises if nothing was written for it."""
    df = published(spark, path, ENCODING_PARTS).filter(F.col("model") == model)
    if not df.head(1):
        raise ValueError(f"{path} holds no results of model {model!r}")
    return df if layer is None else df.filter(F.col("layer") == layer)


def available_subjects(encoding: DataFrame) -> DataFrame:
    """Subjects written per model and layer."""
    return encoding.select("model", "layer", "subject").distinct()


def write_result(df: DataFrame, path: str, partitions=()) -> None:
    """Write a result table."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
