"""Voxel sets: regions of interest, streams, fit voxels, shared images, hemispheres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.operators.ordering import exact_percentile

VOX = ("subject", "voxel_id")

# ROI, the atlas it is drawn from and the atlas labels that make it up.
ROI_GROUPS = (
    ("OFA", "floc-faces_t2", ("OFA",)),
    ("FFA", "floc-faces_t2", ("FFA-1", "FFA-2")),
    ("aTL-faces", "floc-faces_t2", ("aTL-faces",)),
    ("mTL-faces", "floc-faces_t2", ("mTL-faces",)),
    ("EBA", "floc-bodies_t2", ("EBA",)),
    ("FBA", "floc-bodies_t2", ("FBA-1", "FBA-2")),
    ("mTL-bodies", "floc-bodies_t2", ("mTL-bodies",)),
    ("V1", "prf-visualrois", ("V1v", "V1d")),
    ("OPA", "floc-places_t2", ("OPA",)),
    ("PPA", "floc-places_t2", ("PPA",)),
    ("RSC", "floc-places_t2", ("RSC",)),
    ("EVC", "streams", ("early",)),
)
# Streams in order, those of the ventral axis, and ROIs kept whole.
STREAMS = ("early", "midventral", "ventral", "midlateral", "lateral", "midparietal", "parietal")
VENTRAL_STREAMS = ("early", "midventral", "ventral")
ROIS_COMPLETE = ("PPA", "aTL-faces", "mTL-bodies")


def define_rois(atlas: DataFrame, labels: DataFrame, groups=ROI_GROUPS) -> DataFrame:
    """Long ROI membership: voxel whose atlas value is one of the ROI's labels.

    `atlas` is (subject, voxel_id, atlas, value); `labels` is (atlas, label, value).
    """
    spark = atlas.sparkSession
    wanted = spark.createDataFrame(
        [(r, a, name) for r, a, names in groups for name in names],
        "roi string, atlas string, label string")
    ids = wanted.join(labels, ["atlas", "label"]).select("roi", "atlas", "value")
    return atlas.join(ids, ["atlas", "value"]).select(*VOX, "roi").distinct()


def narrow_rois(members: DataFrame, tvals: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Keep ROI voxels with t above the threshold; a missing t drops the voxel.

    `tvals` is (subject, voxel_id, roi, t).
    """
    t = F.when(~F.isnan("t"), F.col("t"))
    return members.join(tvals, [*VOX, "roi"]).filter(t > threshold).drop("t")


def narrow_counts(members: DataFrame, tvals: DataFrame, threshold: float = 2.0) -> DataFrame:
    """ROI sizes before and after narrowing."""
    rows = members.join(tvals, [*VOX, "roi"], "left")
    keep = F.coalesce(F.col("t") > threshold, F.lit(False)) & ~F.coalesce(F.isnan("t"), F.lit(True))
    return rows.groupBy("subject", "roi").agg(
        F.count("*").alias("n_before"), F.count_if(keep).alias("n_after"))


def stream_mask(voxels: DataFrame, labels: DataFrame, streams=STREAMS,
                nc_thresh: float = 0.0) -> DataFrame:
    """Voxels whose atlas value belongs to the named streams, optionally with nc > threshold.

    `voxels` is (subject, voxel_id, stream_value, nc); `labels` is (label, value).
    """
    known = {r["label"] for r in labels.select("label").distinct().collect()}
    missing = [s for s in streams if s not in known]
    if missing:
        raise ValueError(f"streams {missing} are not in the atlas")
    ids = labels.filter(F.col("label").isin(*streams)).select(
        F.col("value").alias("stream_value"), F.col("label").alias("stream"))
    out = voxels.join(ids, "stream_value")
    if nc_thresh > 0:
        out = out.filter(F.col("nc") > nc_thresh)
    return out


def roi_columns(members: DataFrame, rois) -> DataFrame:
    """Membership of the named ROIs; ROIs without voxels simply do not appear."""
    return members.filter(F.col("roi").isin(*rois))


def absent_rois(members: DataFrame, rois) -> DataFrame:
    """The named ROIs that no voxel of a subject carries."""
    wanted = members.select("subject").distinct().select(
        "subject", F.explode(F.array(*[F.lit(r) for r in rois])).alias("roi"))
    have = members.select("subject", "roi").distinct()
    return wanted.join(have, ["subject", "roi"], "left_anti")


def fit_voxels(streams: DataFrame, members: DataFrame, meta: DataFrame,
               complete=ROIS_COMPLETE, order=STREAMS) -> DataFrame:
    """Stream voxels plus complete ROIs, with stream_id (-1 if only from an ROI), nc and ncsnr.

    `streams` is the output of `stream_mask`; `meta` is (subject, voxel_id, nc, ncsnr).
    """
    ordinal = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("stream")) - 1
    on = streams.select(*VOX, ordinal.cast("short").alias("stream_id"))
    extra = members.filter(F.col("roi").isin(*complete)).select(
        *VOX, F.lit(-1).cast("short").alias("stream_id"))
    both = on.unionByName(extra).groupBy(*VOX).agg(F.max("stream_id").alias("stream_id"))
    return both.join(meta.select(*VOX, "nc", "ncsnr"), list(VOX), "left")


def fit_coverage(fit: DataFrame, members: DataFrame) -> DataFrame:
    """Per ROI: voxels inside the fit set and lost outside it."""
    flag = fit.select(*VOX, F.lit(1).alias("_in"))
    return members.join(flag, list(VOX), "left").groupBy("subject", "roi").agg(
        F.count("_in").alias("n_kept"), (F.count("*") - F.count("_in")).alias("n_lost"))


def roi_combinations(members: DataFrame) -> DataFrame:
    """Each voxel's exact set of ROIs as a sorted name joined with &."""
    return members.groupBy(*VOX).agg(
        F.concat_ws("&", F.array_sort(F.collect_set("roi"))).alias("comb"))


def roi_exclusive(members: DataFrame, overlaps=(("FFA", "FBA"),),
                  labels: DataFrame | None = None) -> DataFrame:
    """ROIs without the voxels of any other ROI, named overlaps as ROIs of their own.

    Selectivity labels (subject, voxel_id, label) are added unchanged.
    """
    sets = members.groupBy(*VOX).agg(F.collect_set("roi").alias("rois"))
    alone = F.when(F.size("rois") == 1, F.col("rois")).otherwise(
        F.array().cast("array<string>"))
    shared = [F.when(F.array_contains("rois", a) & F.array_contains("rois", b), F.lit(f"{a}&{b}"))
              for a, b in overlaps]
    names = F.concat(alone, F.array_compact(F.array(*shared))) if shared else alone
    out = sets.select(*VOX, F.explode(names).alias("roi"))
    if labels is None:
        return out
    return out.unionByName(labels.select(*VOX, F.col("label").alias("roi")))


def roi_responses(regions: DataFrame, responses: DataFrame, nc: DataFrame,
                  nc_thresh: float = 0.15, min_vox: int = 10) -> DataFrame:
    """Responses of ROI voxels with nc above the threshold; an ROI needs more than min_vox."""
    good = regions.join(nc.select(*VOX, "nc").filter(F.col("nc") > nc_thresh), list(VOX))
    big = good.groupBy("subject", "roi").count().filter(F.col("count") > min_vox).drop("count")
    return good.join(big, ["subject", "roi"]).join(responses, list(VOX))


def shared_images(seen: DataFrame, n_subjects: int, stimuli: DataFrame) -> DataFrame:
    """Stimuli seen by every subject."""
    every = seen.groupBy("image_id").agg(F.countDistinct("subject").alias("k")).filter(
        F.col("k") == n_subjects).drop("k")
    return stimuli.select("image_id").distinct().join(every, "image_id", "left_semi")


def flag_shared(seen: DataFrame, shared: DataFrame) -> DataFrame:
    """Each subject's images with a flag for the shared ones."""
    marks = shared.select("image_id", F.lit(True).alias("shared"))
    return seen.join(marks, "image_id", "left").withColumn(
        "shared", F.coalesce("shared", F.lit(False)))


def subject_images(stim_info: DataFrame, n_trials: DataFrame, repeats: int = 3) -> DataFrame:
    """Images whose last repetition was shown: 0 < trial <= n_trials; 0-based trial ids.

    `stim_info` is long (subject, image_id, rep, trial); `n_trials` is (subject, n_trials).
    """
    last = repeats - 1
    reps = stim_info.groupBy("subject", "image_id").agg(
        F.max(F.when(F.col("rep") == last, F.col("trial"))).alias("_last"),
        F.transform(F.array_sort(F.collect_list(F.struct("rep", "trial"))),
                    lambda r: r["trial"] - 1).alias("trial_ids"))
    return reps.join(n_trials, "subject").filter(
        (F.col("_last") > 0) & (F.col("_last") <= F.col("n_trials"))
    ).select("subject", "image_id", "trial_ids")


def subject_image_ids(image_meta: DataFrame) -> DataFrame:
    """Distinct image ids per subject."""
    return image_meta.select("subject", "image_id").distinct()


def slice_by_subject(acts: DataFrame, wanted: DataFrame, pre_relu: bool = False) -> DataFrame:
    """Rectified activations of each subject's images in its own order.

    `wanted` is (subject, image_id, ordinal); activations of the union are read once.
    """
    from unimass.functions.columns import relu

    union = wanted.select("image_id").distinct()
    picked = acts.join(union, "image_id", "left_semi")
    act = F.col("act") if pre_relu else relu(F.col("act"))
    return picked.withColumn("act", act).join(wanted, "image_id")


def hemisphere(voxels: DataFrame) -> DataFrame:
    """lh where world x is below the subject's median x, else rh."""
    middle = exact_percentile(voxels, ["subject"], "x", {"_mid": 0.5})
    return voxels.join(middle, "subject").withColumn(
        "hemi", F.when(F.col("x") < F.col("_mid"), "lh").otherwise("rh")).drop("_mid")


def contrast_to_voxels(volume: DataFrame, voxels: DataFrame, values=("z",)) -> DataFrame:
    """Contrast volume (subject, contrast, i, j, k, z) -> one value per brain voxel, NaN -> 0."""
    clean = [F.coalesce(F.when(~F.isnan(v), F.col(v)), F.lit(0.0)).alias(v) for v in values]
    out = volume.join(voxels.select(*VOX, "i", "j", "k"), ["subject", "i", "j", "k"]).select(
        *VOX, "contrast", *clean)
    have = out.groupBy("subject", "contrast").count()
    need = voxels.groupBy("subject").agg(F.count("*").alias("_need"))
    short = have.join(need, "subject").filter(F.col("count") < F.col("_need"))
    if short.head(1):
        raise ValueError("a contrast volume does not cover the brain mask")
    return out


def ventral_mask(streams: DataFrame, members: DataFrame, complete=ROIS_COMPLETE,
                 seed="V1") -> DataFrame:
    """(subject, voxel_id, seed): ventral streams or complete ROIs, with V1 voxels as seeds."""
    path = streams.filter(F.col("stream").isin(*VENTRAL_STREAMS)).select(*VOX).unionByName(
        members.filter(F.col("roi").isin(*complete)).select(*VOX)).distinct()
    seeds = members.filter(F.col("roi") == seed).select(*VOX, F.lit(True).alias("seed"))
    return path.join(seeds, list(VOX), "left").withColumn(
        "seed", F.coalesce("seed", F.lit(False)))


def require_seeds(mask: DataFrame) -> DataFrame:
    """The mask itself; raises if a subject has no seed voxel in it."""
    none = mask.groupBy("subject").agg(F.bool_or("seed").alias("ok")).filter(~F.col("ok"))
    missing = [r["subject"] for r in none.limit(20).collect()]
    if missing:
        raise ValueError(f"no seed voxels inside the mask of {missing}")
    return mask


def vox_align(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two voxel tables by (subject, voxel_id), the one key of both orders."""
    return left.join(right, list(VOX), how)
