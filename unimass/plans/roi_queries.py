"""Queries over voxels: regions, streams, gradient bins, maps and encoding scores."""

from pyspark.sql import functions as F

from unimass.functions import columns as col
from unimass.operators import cohorts as co
from unimass.operators import curves as cu
from unimass.operators import inference as inf
from unimass.operators import roi as ro
from unimass.operators import rules as ru
from unimass.operators import scores as sc
from unimass.plans import adapters as ad
from unimass.plans.registry import folder, query, r6
from unimass.plans.sql import normal_sf, step_up, t_crit, t_test
from unimass.sources import scans as sn

M, L, V, E = ad.ROI_MEMBERS, ad.VOXEL_LABELS, ad.VOXELS, ad.ENCODING


@query("scan_voxels", f"""WITH v AS (SELECT p_type AS subject, p_partkey AS flat,
      row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) - 1 AS voxel_id,
      p_partkey // 30 AS i, (p_partkey // 6) % 5 AS j, p_partkey % 6 AS k FROM part)
    SELECT subject, voxel_id, i, j, k, {r6("2.0 * i - 90")} AS x, {r6("1.5 * j + 0.5 * k")} AS y, {r6("3.0 * k + 1")} AS z FROM v""")
def scan_voxels(t):
    """Parts as the flat places of a 5 x 6 grid's mask voxels."""
    mask = t.part.select(F.col("p_type").alias("subject"), F.col("p_partkey").alias("flat"))
    return sn.scan_voxels(mask, (None, 5, 6), [[2, 0, 0, -90], [0, 1.5, 0.5, 0], [0, 0, 3, 1]]).select(
        "subject", "voxel_id", "i", "j", "k", "x", "y", "z")


@query("noise_ceiling", """SELECT s_suppkey, round(s_acctbal / 5000, 6) + 0.0 AS ncsnr,
    round(pow(s_acctbal / 5000, 2) / (pow(s_acctbal / 5000, 2) + 1.0 / 3), 6) + 0.0 AS nc FROM supplier""")
def noise_ceiling(t):
    snr = F.col("s_acctbal") / 5000
    return t.supplier.select("s_suppkey", snr.alias("ncsnr"), col.noise_ceiling(snr).alias("nc"))


@query("quantize", f"""SELECT event_id, trunc(least(greatest(value * 300, -32768), 32767))::SMALLINT AS q,
    {r6("trunc(least(greatest(value * 300, -32768), 32767)) / 300")} AS back FROM events""")
def quantize(t):
    q = t.events.select("event_id", col.quantize(F.col("value")).alias("q"))
    return q.withColumn("back", col.dequantize(F.col("q")))


@query("clip_scale", f"SELECT event_id, {r6('least(greatest((value - 20) / 60, 0), 1)')} AS w FROM events")
def clip_scale(t):
    return t.events.select("event_id", col.clip_scale(F.col("value"), F.lit(20.0), F.lit(80.0)).alias("w"))


@query("relu", f"WITH {ad.ACTS} SELECT image_id, layer, unit_id, {r6('greatest(act, 0)')} AS act FROM acts")
def relu(t):
    from unimass.plans.unit_queries import acts

    return acts(t).select("image_id", "layer", "unit_id", col.relu(F.col("act")).alias("act"))


@query("decode_unit", """SELECT p_partkey, p_partkey // 63 AS channel, p_partkey % 63 // 9 AS y, p_partkey % 9 AS x
    FROM part WHERE p_partkey < 63 * 150""")
def decode_unit(t):
    return t.part.select("p_partkey", *col.decode_unit(F.col("p_partkey"), 150, 7, 9)).filter(
        F.col("channel").isNotNull())


@query("parse_model_name", """SELECT p_partkey, split_part(replace(p_name, ' ', '_'), '_', 1) AS arch,
    array_to_string(string_split(replace(p_name, ' ', '_'), '_')[2:], '_') AS diet FROM part""")
def parse_model_name(t):
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return t.part.select("p_partkey", *col.parse_model_name(name))


@query("roi_columns", f"WITH {M} SELECT subject, voxel_id, roi FROM members WHERE roi IN ('FFA', 'PPA')")
def roi_columns(t):
    return ro.roi_columns(ad.roi_members(t), ["FFA", "PPA", "OFA"])


@query("define_rois", """SELECT p_type AS subject, p_partkey AS voxel_id, CASE
      WHEN p_size IN (1, 2, 3) THEN 'FFA' WHEN p_size IN (4, 5) THEN 'PPA' END AS roi
    FROM part WHERE p_size <= 5
    UNION ALL SELECT p_type, p_partkey, 'V1' FROM part WHERE p_brand IN ('Brand#1', 'Brand#12')""")
def define_rois(t):
    p = t.part.select(F.col("p_type").alias("subject"), F.col("p_partkey").alias("voxel_id"), "p_size", "p_brand")
    size = p.select("subject", "voxel_id", F.lit("size").alias("atlas"), F.col("p_size").cast("string").alias("value"))
    brand = p.select("subject", "voxel_id", F.lit("brand").alias("atlas"), F.col("p_brand").alias("value"))
    labels = t.spark.createDataFrame(
        [("size", "a", "1"), ("size", "b", "2"), ("size", "c", "3"), ("size", "d", "4"), ("size", "e", "5"),
         ("brand", "v", "Brand#1"), ("brand", "w", "Brand#12")], "atlas string, label string, value string")
    groups = (("FFA", "size", ("a", "b", "c")), ("PPA", "size", ("d", "e")), ("V1", "brand", ("v", "w")))
    return ro.define_rois(size.unionByName(brand), labels, groups)


NARROW = "CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_retailprice / 400 END"


@query("narrow_rois", f"""WITH {M}, tv AS (SELECT p_partkey AS voxel_id, {NARROW} AS t FROM part)
    SELECT subject, voxel_id, roi FROM members JOIN tv USING (voxel_id) WHERE t > 2.4""")
def narrow_rois(t):
    members = ad.roi_members(t).select("subject", "voxel_id", "roi")
    tv = t.part.select(F.col("p_partkey").alias("voxel_id"), F.expr(NARROW).alias("t"))
    return ro.narrow_rois(members, members.join(tv, "voxel_id"), 2.4)


@query("narrow_counts", f"""WITH {M}, tv AS (SELECT p_partkey AS voxel_id, {NARROW} AS t FROM part)
    SELECT subject, roi, count(*) AS n_before, count(*) FILTER (t > 2.4) AS n_after
    FROM members JOIN tv USING (voxel_id) GROUP BY ALL""")
def narrow_counts(t):
    members = ad.roi_members(t)
    tv = t.part.select(F.col("p_partkey").alias("voxel_id"), F.expr(NARROW).alias("t"))
    return ro.narrow_counts(members, members.join(tv, "voxel_id"), 2.4)


STREAM = """sv AS (SELECT p_type AS subject, p_partkey AS voxel_id, p_size % 9 AS stream_value,
    (p_retailprice % 97) / 97 AS nc, sqrt((p_retailprice % 97) / 97) AS ncsnr FROM part)"""


def stream_voxels(t):
    nc = (F.col("p_retailprice") % 97) / 97
    return t.part.select(
        F.col("p_type").alias("subject"), F.col("p_partkey").alias("voxel_id"),
        (F.col("p_size") % 9).alias("stream_value"), nc.alias("nc"), F.sqrt(nc).alias("ncsnr"))


def stream_labels(t):
    return t.spark.createDataFrame(
        [(s, i + 1) for i, s in enumerate(ro.STREAMS)], "label string, value int")


@query("stream_mask", f"""WITH {STREAM} SELECT subject, voxel_id, {list(ro.STREAMS)}[stream_value] AS stream
    FROM sv WHERE stream_value IN (1, 2, 3) AND nc > 0.2""")
def stream_mask(t):
    return ro.stream_mask(stream_voxels(t), stream_labels(t), ro.VENTRAL_STREAMS, 0.2).select(
        "subject", "voxel_id", "stream")


@query("fit_voxels", f"""WITH {M}, {STREAM}, keep AS (
      SELECT voxel_id FROM sv WHERE stream_value BETWEEN 1 AND 7
      UNION SELECT voxel_id FROM members WHERE roi = 'PPA')
    SELECT subject, voxel_id, CASE WHEN stream_value BETWEEN 1 AND 7 THEN stream_value - 1 ELSE -1 END::SMALLINT AS stream_id,
      {r6("nc")} AS nc, {r6("ncsnr")} AS ncsnr FROM sv WHERE voxel_id IN (SELECT voxel_id FROM keep)""")
def fit_voxels(t):
    sv = stream_voxels(t)
    return ro.fit_voxels(ro.stream_mask(sv, stream_labels(t)), ad.roi_members(t), sv)


@query("fit_coverage", f"""WITH {M}, {STREAM} SELECT subject, roi,
    count(*) FILTER (stream_value BETWEEN 1 AND 7) AS n_kept, count(*) FILTER (stream_value NOT BETWEEN 1 AND 7) AS n_lost
    FROM members JOIN sv USING (subject, voxel_id) GROUP BY ALL""")
def fit_coverage(t):
    return ro.fit_coverage(ro.stream_mask(stream_voxels(t), stream_labels(t)), ad.roi_members(t))


@query("roi_combinations", f"""WITH {M} SELECT subject, voxel_id, string_agg(roi, '&' ORDER BY roi) AS comb
    FROM members GROUP BY ALL""")
def roi_combinations(t):
    return ro.roi_combinations(ad.roi_members(t))


REGIONS = f"""{M}, {L[len(V) + 2:]}, per_voxel AS (SELECT subject, voxel_id, list(roi) AS rois FROM members GROUP BY ALL),
  regions AS (SELECT subject, voxel_id, rois[1] AS roi FROM per_voxel WHERE len(rois) = 1
    UNION ALL SELECT subject, voxel_id, 'FFA&FBA' FROM per_voxel
      WHERE list_contains(rois, 'FFA') AND list_contains(rois, 'FBA')
    UNION ALL SELECT subject, voxel_id, label FROM labels_of WHERE label IN ('face', 'body', 'mixed', 'non'))"""


def regions(t):
    labels = ad.voxel_labels(t).filter(F.col("label").isin("face", "body", "mixed", "non"))
    return ro.roi_exclusive(ad.roi_members(t), labels=labels)


@query("roi_exclusive", f"WITH {REGIONS} SELECT * FROM regions")
def roi_exclusive(t):
    return regions(t)


@query("roi_responses", f"""WITH {REGIONS}, {ad.TRIALS}, good AS (SELECT r.subject, r.roi, voxel_id, nc
      FROM regions r JOIN voxels v USING (voxel_id) WHERE nc > 0.3),
    big AS (SELECT subject, roi FROM good GROUP BY ALL HAVING count(*) > 20)
    SELECT subject, roi, voxel_id, avg(l_quantity) AS resp FROM good JOIN big USING (subject, roi)
    JOIN lineitem ON l_partkey = voxel_id GROUP BY ALL""".replace(
    "avg(l_quantity) AS resp", r6("avg(l_quantity)") + " AS resp"))
def roi_responses(t):
    resp = t.lineitem.groupBy(F.col("l_partkey").alias("voxel_id")).agg(F.avg("l_quantity").alias("resp"))
    resp = resp.join(t.part.select(F.col("p_partkey").alias("voxel_id"), F.col("p_type").alias("subject")), "voxel_id")
    return ro.roi_responses(regions(t), resp, ad.voxels(t), 0.3, 20).select("subject", "roi", "voxel_id", "resp")


@query("shared_images", f"""WITH {ad.TRIALS} SELECT voxel_id AS image_id FROM trials
    GROUP BY voxel_id HAVING count(DISTINCT subject) = 5""")
def shared_images(t):
    seen = ad.trials(t).select("subject", F.col("voxel_id").alias("image_id"))
    return ro.shared_images(seen, 5, seen.select("image_id"))


@query("subject_images", f"""WITH {ad.TRIALS}, reps AS (SELECT subject, voxel_id AS image_id,
      list(trial_id ORDER BY trial_id)[1:3] AS ids FROM trials GROUP BY ALL)
    SELECT subject, image_id, len(ids) AS n, ids[1] - 1 AS first_id, ids[3] - 1 AS last_id FROM reps
    WHERE len(ids) = 3 AND ids[3] > 0 AND ids[3] <= 6000""")
def subject_images(t):
    tr = ad.trials(t)
    ids = tr.groupBy("subject", F.col("voxel_id").alias("image_id")).agg(
        F.slice(F.array_sort(F.collect_list("trial_id")), 1, 3).alias("ids"))
    info = ids.select("subject", "image_id", F.posexplode("ids").alias("rep", "trial"))
    limit = tr.select("subject").distinct().withColumn("n_trials", F.lit(6000))
    out = ro.subject_images(info, limit)
    return out.select("subject", "image_id", F.size("trial_ids").cast("bigint").alias("n"),
                      F.get("trial_ids", F.lit(0)).alias("first_id"),
                      F.get("trial_ids", F.lit(2)).alias("last_id"))


@query("subject_image_ids", f"WITH {ad.TRIALS} SELECT DISTINCT subject, image_id FROM trials")
def subject_image_ids(t):
    return ro.subject_image_ids(ad.trials(t))


@query("slice_by_subject", f"""WITH {ad.ACTS}, wanted AS (SELECT DISTINCT event_type AS subject, user_id AS image_id,
      row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS ordinal
      FROM (SELECT DISTINCT event_type, user_id FROM events))
    SELECT subject, ordinal, image_id, layer, unit_id, {r6("greatest(act, 0)")} AS act FROM acts JOIN wanted USING (image_id)""")
def slice_by_subject(t):
    from unimass.operators.ordering import global_order
    from unimass.plans.unit_queries import acts

    pairs = t.events.select(F.col("event_type").alias("subject"), F.col("user_id").alias("image_id")).distinct()
    wanted = global_order(pairs, ["subject"], [F.col("image_id")]).select("subject", "image_id", F.col("pos").alias("ordinal"))
    return ro.slice_by_subject(acts(t), wanted).select("subject", "ordinal", "image_id", "layer", "unit_id", "act")


@query("hemisphere", f"""WITH {V}, m AS (SELECT subject, quantile_cont(x, 0.5) AS mid FROM voxels GROUP BY ALL)
    SELECT subject, voxel_id, CASE WHEN x < mid THEN 'lh' ELSE 'rh' END AS hemi FROM voxels JOIN m USING (subject)""")
def hemisphere(t):
    return ro.hemisphere(ad.voxels(t)).select("subject", "voxel_id", "hemi")


@query("contrast_to_voxels", f"""WITH {V} SELECT subject, voxel_id, c AS contrast,
    {r6("CASE WHEN i % 7 = c THEN 0 ELSE i + j * c - k END")} AS z FROM voxels, range(3) AS r(c)""")
def contrast_to_voxels(t):
    v = ad.voxels(t)
    z = F.when(F.col("i") % 7 == F.col("contrast"), F.lit(float("nan"))).otherwise(
        F.col("i") + F.col("j") * F.col("contrast") - F.col("k"))
    volume = v.select("subject", "i", "j", "k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))).alias("contrast"))
    return ro.contrast_to_voxels(volume.withColumn("z", z), v)


@query("gradient_bins", f"""WITH {V} SELECT subject, voxel_id, least(greatest(trunc(d_norm * 10)::INT, 0), 9) AS bin,
    {r6("(least(greatest(trunc(d_norm * 10)::INT, 0), 9) + 0.5) / 10 * 100")} AS x FROM voxels""")
def gradient_bins(t):
    return cu.gradient_bins(ad.voxels(t)).select("subject", "voxel_id", "bin", F.col("x"))


BINNED = f"""{L}, w AS (SELECT subject, voxel_id, bool_or(label <> 'responsive') AS any_label,
    bool_or(label = 'responsive') AS responsive, bool_or(label = 'face') AS face,
    bool_or(label = 'body') AS body, bool_or(label = 'mixed') AS mixed FROM labels_of GROUP BY ALL),
  bv AS (SELECT v.subject, least(greatest(trunc(d_norm * 10)::INT, 0), 9) AS bin, w.* EXCLUDE (subject, voxel_id)
    FROM voxels v JOIN w USING (subject, voxel_id) WHERE any_label AND responsive),
  grid AS (SELECT DISTINCT subject AS entity, key, bin FROM voxels, (VALUES ('face'), ('body'), ('mixed')) AS k(key), range(10) AS r(bin)),
  curves AS (SELECT entity, key, g.bin::INT AS bin, (g.bin + 0.5) * 10 AS x,
    100.0 * count(*) FILTER (CASE key WHEN 'face' THEN face WHEN 'body' THEN body ELSE mixed END) / nullif(count(b.subject), 0) AS y
    FROM grid g LEFT JOIN bv b ON b.subject = entity AND b.bin = g.bin GROUP BY ALL)"""


@query("bin_percent", f"WITH {BINNED} SELECT entity, key, bin, {r6('x')} AS x, {r6('y')} AS y FROM curves")
def bin_percent(t):
    return cu.bin_percent(ad.voxel_labels(t), ad.voxels(t))


@query("fmri_profile", f"""WITH {BINNED}, pts AS (SELECT * FROM curves), r AS (SELECT entity, key,
      rank() OVER (PARTITION BY entity, key ORDER BY x) AS rx, rank() OVER (PARTITION BY entity, key ORDER BY round(y, 9))
        + (count(*) OVER (PARTITION BY entity, key, round(y, 9)) - 1) / 2 AS ry FROM pts WHERE y IS NOT NULL),
    rho AS (SELECT entity, key, corr(rx, ry) AS rho FROM r GROUP BY ALL),
    nz AS (SELECT key, rho, rank() OVER (PARTITION BY key ORDER BY abs(rho)) + (count(*) OVER (PARTITION BY key, abs(rho)) - 1) / 2 AS ar,
      count(*) OVER (PARTITION BY key, abs(rho)) AS tie FROM rho WHERE rho <> 0),
    sr AS (SELECT key, count(*) AS m, sum(tie * tie - 1) AS ties, coalesce(sum(ar) FILTER (rho > 0), 0) AS plus, least(plus, m * (m + 1) / 2 - plus) AS w,
      (m * (m + 1) / 4 - w) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - ties / 48) AS z FROM nz GROUP BY key),
    signs AS (SELECT m, a.s, coalesce(sum(i + 1) FILTER ((a.s >> i) & 1 = 1), 0) AS plus FROM range(1, 9) AS k(m), range(256) AS a(s), range(8) AS b(i)
      WHERE a.s < (1 << m) AND i < m GROUP BY ALL),
    base AS (SELECT key, count(rho) AS n, count(*) FILTER (rho > 0) AS n_pos, quantile_cont(rho, 0.5) AS median_r, min(rho) AS r_min, max(rho) AS r_max FROM rho GROUP BY key),
    tail AS (SELECT sr.key, count(*) AS hits FROM sr JOIN signs ON signs.m = sr.m AND signs.plus <= sr.w GROUP BY sr.key),
    raw AS (SELECT base.*, w, CASE WHEN ties = 0 AND m = n THEN least(1, 2 * hits / pow(2, n)) ELSE least(1, 2 * {normal_sf("z")}) END AS p_raw
      FROM base JOIN sr USING (key) JOIN tail USING (key)),
    adjusted AS ({step_up("raw", "", "*", "p_raw", "bh", "p")})
    SELECT key, n, n_pos, {r6("median_r")} AS median_r, {r6("r_min")} AS r_min, {r6("r_max")} AS r_max, {r6("w")} AS w,
      {r6("p_raw")} AS p_raw, {r6("p")} AS p FROM adjusted""")
def fmri_profile(t):
    curves = cu.bin_percent(ad.voxel_labels(t), ad.voxels(t)).withColumn("y", F.round("y", 9))
    return inf.gradient_stats(curves).select("key", "n", "n_pos", "median_r", "r_min", "r_max", "w", "p_raw", "p")


@query("responsive_percent", f"""WITH {L}, w AS (SELECT subject, voxel_id, bool_or(label = 'responsive') AS responsive,
      bool_or(label = 'face') AS face, bool_or(label = 'body') AS body, bool_or(label = 'mixed') AS mixed FROM labels_of GROUP BY ALL),
    p AS (SELECT subject, 100.0 * count(*) FILTER (face) / count(*) AS face, 100.0 * count(*) FILTER (body) / count(*) AS body,
      100.0 * count(*) FILTER (mixed) / count(*) AS mixed FROM w WHERE responsive GROUP BY ALL),
    u AS (UNPIVOT p ON face, body, mixed INTO NAME label VALUE percent)
    SELECT label, {r6("avg(percent)")} AS mean, {r6("stddev_samp(percent)")} AS sd, {r6("min(percent)")} AS min,
      {r6("max(percent)")} AS max, count(*) AS n FROM u GROUP BY label""")
def responsive_percent(t):
    return sc.percent_summary(sc.responsive_percent(ad.voxel_labels(t)))


VARPART = f"""{ad.ENC_WIDE}, vp AS (SELECT model, layer, subject, voxel_id, r2_fb - r2_b AS u_f, r2_fb - r2_f AS u_b,
    r2_f + r2_b - r2_fb AS s_fb, r2_fbm - r2_fb AS delta_m, r2_fb, r2_fbm FROM enc_wide)"""


@query("variance_partition", f"""WITH {VARPART}, u AS (UNPIVOT (SELECT * EXCLUDE (r2_fb, r2_fbm) FROM vp) ON u_f, u_b, s_fb, delta_m
      INTO NAME measure VALUE value)
    SELECT model, layer, subject, voxel_id, measure, {r6("value")} AS value FROM u""")
def variance_partition(t):
    return sc.variance_partition(ad.encoding(t))


def portions(t):
    enc = ad.encoding(t)
    return sc.variance_partition(enc).unionByName(enc)


BIN_MEAN = f"""{VARPART}, {V}, b AS (SELECT vp.subject AS entity, layer, least(greatest(trunc(d_norm * 10)::INT, 0), 9) AS bin,
    vp.*, nc FROM vp JOIN voxels v USING (voxel_id))"""


@query("bin_mean", f"""WITH {BIN_MEAN}, grid AS (SELECT DISTINCT subject AS entity, bin FROM voxels, range(10) AS r(bin)),
    s AS (SELECT entity, bin, sum(s_fb) / sum(nc) AS s_fb, sum(u_f) / sum(nc) AS u_f FROM b GROUP BY ALL),
    g AS (SELECT entity, bin::INT AS bin, s_fb, u_f FROM grid LEFT JOIN s USING (entity, bin)),
    u AS (SELECT * FROM g UNPIVOT INCLUDE NULLS (y FOR key IN (s_fb, u_f)))
    SELECT entity, key, bin, {r6("(bin + 0.5) * 10")} AS x, {r6("y")} AS y FROM u""")
def bin_mean(t):
    vox = ad.voxels(t)
    rows = sc.variance_partition(ad.encoding(t))
    return cu.bin_mean(rows, vox, vox, ["s_fb", "u_f"])


def ratio_curves(t):
    rows = portions(t)
    keys = ["u_f", "u_b", "s_fb", "r2_fb", "delta_m", "r2_fbm"]
    return cu.integration_ratios(cu.bin_mean(rows, ad.voxels(t), None, keys))


RATIO = f"""{BIN_MEAN}, rt AS (SELECT entity, bin, 100 * sum(u_f) / sum(r2_fb) AS "U_face", 100 * sum(u_b) / sum(r2_fb) AS "U_body",
    100 * sum(s_fb) / sum(r2_fb) AS "I_shared", 100 * sum(delta_m) / sum(r2_fbm) AS "I_mixed" FROM b GROUP BY ALL),
  ru AS (UNPIVOT rt ON "U_face", "U_body", "I_shared", "I_mixed" INTO NAME key VALUE y)"""


@query("integration_ratios", f"WITH {RATIO} SELECT entity, bin, {r6('(bin + 0.5) * 10')} AS x, key, {r6('y')} AS y FROM ru")
def integration_ratios(t):
    return ratio_curves(t).filter("y IS NOT NULL")


@query("integration_report", f"""WITH {RATIO} SELECT key, bin, count(y) AS n, {r6("avg(y)")} AS mean,
    {r6("stddev_samp(y) / sqrt(count(y))")} AS err FROM ru WHERE bin IN (0, 9) GROUP BY ALL""")
def integration_report(t):
    return cu.integration_report(ratio_curves(t))


@query("ventral_report", f"""WITH {RATIO} SELECT key, bin, {r6("(bin + 0.5) * 10")} AS x, count(y) AS n, {r6("avg(y)")} AS mean,
    {r6("stddev_samp(y) / sqrt(count(y))")} AS err FROM ru GROUP BY ALL""")
def ventral_report(t):
    return sc.ventral_report(ratio_curves(t))


@query("voxelwise_to_roi", f"""WITH {REGIONS}, {E} SELECT model, layer, e.subject, roi, measure, count(*) AS n,
    {r6("avg(value)")} AS mean FROM encoding e JOIN regions USING (subject, voxel_id)
    WHERE measure IN ('f', 'b', 'm', 'ns') GROUP BY ALL""")
def voxelwise_to_roi(t):
    return sc.voxelwise_to_roi(ad.encoding(t), regions(t)).groupBy(
        "model", "layer", "subject", "roi", "measure").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("noise_ceiling_by_roi", f"""WITH {REGIONS} SELECT r.subject, roi, voxel_id, {r6("nc")} AS nc
    FROM regions r JOIN voxels USING (subject, voxel_id)""")
def noise_ceiling_by_roi(t):
    return sc.noise_ceiling_by_roi(ad.voxels(t), regions(t))


SCORES = f"""{REGIONS}, {E}, ncr AS (SELECT r.subject, roi, avg(nc) AS nc FROM regions r JOIN voxels USING (subject, voxel_id) GROUP BY ALL),
  vm AS (SELECT model, layer, e.subject, roi, measure, avg(value) AS m, count(*) AS n FROM encoding e
    JOIN regions USING (subject, voxel_id) WHERE measure IN ('f', 'b', 'm', 'ns') GROUP BY ALL),
  scores AS (SELECT model, layer, subject, roi, measure, m / nc AS score, n AS n_voxels FROM vm JOIN ncr USING (subject, roi) WHERE nc > 0)"""


def parts(t):
    reg = regions(t)
    values = sc.voxelwise_to_roi(ad.encoding(t), reg)
    nc = sc.noise_ceiling_by_roi(ad.voxels(t), reg)
    return values, nc


def scores(t):
    return sc.roi_scores(*parts(t))


@query("roi_scores", f"WITH {SCORES} SELECT model, layer, subject, roi, measure, {r6('score')} AS score, n_voxels FROM scores")
def roi_scores(t):
    return scores(t)


DIFFS = f"""{SCORES}, ord(measure, o) AS (VALUES ('f', 1), ('b', 2), ('m', 3), ('ns', 4)),
  diffs AS (SELECT x.model, x.layer, x.subject, x.roi, x.measure AS a, y.measure AS b, x.score - y.score AS diff
    FROM scores x JOIN ord p ON p.measure = x.measure JOIN scores y
      ON (x.model, x.layer, x.subject, x.roi) = (y.model, y.layer, y.subject, y.roi)
    JOIN ord q ON q.measure = y.measure AND p.o < q.o)"""
T_COLS = ("n", "mean", "t", "df", "d", "p", "ci_low", "ci_high")
R_COLS = "n, " + ", ".join(f"{r6(c)} AS {c}" for c in T_COLS[1:])


@query("random_effect_diff", f"""WITH {DIFFS} SELECT model, layer, subject, a, b, {r6("avg(diff)")} AS diff FROM diffs GROUP BY ALL""")
def random_effect_diff(t):
    return sc.random_effect_diff(scores(t), pooled=True)


@query("fixed_effect_diff", f"""WITH RECURSIVE {SCORES}, one AS (SELECT layer, e.subject, roi, voxel_id, measure, max(value / nc) AS s
      FROM encoding e JOIN regions USING (subject, voxel_id) JOIN ncr USING (subject, roi) GROUP BY ALL),
    w AS (SELECT layer, roi, x.measure AS a, y.measure AS b, x.s - y.s AS diff FROM one x JOIN one y USING (layer, subject, roi, voxel_id)
      WHERE list_position(['f', 'b', 'm', 'ns'], x.measure) < list_position(['f', 'b', 'm', 'ns'], y.measure)),
    {t_test("w", "layer, roi, a, b")} SELECT layer, roi, a, b, {R_COLS} FROM tested""")
def fixed_effect_diff(t):
    rows = sc.fixed_effect_diff(*parts(t))
    return inf.one_sample_t(rows, ["layer", "roi", "a", "b"]).select("layer", "roi", "a", "b", *T_COLS)


@query("pairwise_comparisons", f"""WITH RECURSIVE {DIFFS}, pooled AS (SELECT model, layer, subject, 'ALL' AS roi, a, b, avg(diff) AS diff FROM diffs GROUP BY ALL),
    every AS (SELECT * FROM diffs UNION ALL BY NAME SELECT * FROM pooled), {t_test("every", "model, layer, roi, a, b")},
    adjusted AS ({step_up("tested", "model, layer, roi", "*")})
    SELECT model, layer, roi, a, b, {R_COLS}, {r6("p_adj")} AS p_adj, p_adj <= 0.05 AS significant FROM adjusted""")
def pairwise_comparisons(t):
    values, nc = parts(t)
    out = sc.pairwise_comparisons(sc.roi_scores(values, nc), values, nc)
    return out.select("model", "layer", "roi", "a", "b", *T_COLS, "p_adj", "significant")


CELLS = f"""{SCORES}, cells AS (SELECT model, layer, subject,
    max(score) FILTER (roi = 'face' AND measure = 'f') AS ff, max(score) FILTER (roi = 'face' AND measure = 'b') AS fb,
    max(score) FILTER (roi = 'body' AND measure = 'f') AS bf, max(score) FILTER (roi = 'body' AND measure = 'b') AS bb
    FROM scores GROUP BY ALL HAVING ff + fb + bf + bb IS NOT NULL)"""


@query("dissociation_cells", f"""WITH {CELLS} SELECT model, layer, subject, {r6("ff")} AS face_f, {r6("fb")} AS face_b,
    {r6("bf")} AS body_f, {r6("bb")} AS body_b FROM cells""")
def dissociation_cells(t):
    return sc.dissociation_cells(scores(t))


@query("double_dissociation", f"""WITH RECURSIVE {CELLS}, d AS (SELECT model, layer, 'face: f - b' AS contrast, ff - fb AS diff FROM cells
      UNION ALL SELECT model, layer, 'body: b - f', bb - bf FROM cells
      UNION ALL SELECT model, layer, 'interaction', (ff - fb) - (bf - bb) FROM cells),
    {t_test("d", "model, layer, contrast")}, adjusted AS ({step_up("tested", "model, layer", "*")})
    SELECT model, layer, contrast, {R_COLS}, {r6("p_adj")} AS p_adj FROM adjusted""")
def double_dissociation(t):
    return sc.double_dissociation(sc.dissociation_cells(scores(t))).select(
        "model", "layer", "contrast", *T_COLS, "p_adj")


@query("encoding_report", f"""WITH RECURSIVE {SCORES}, own AS (SELECT *, count(*) OVER (PARTITION BY model, layer, roi, subject) AS have,
      avg(score) OVER (PARTITION BY model, layer, roi, subject) AS mine FROM scores),
    wanted AS (SELECT model, layer, roi, count(DISTINCT measure) AS c FROM scores GROUP BY ALL),
    k AS (SELECT *, avg(score) OVER (PARTITION BY model, layer, roi) AS grand FROM own JOIN wanted USING (model, layer, roi) WHERE have = c),
    stat AS (SELECT model, layer, roi, measure, count(*) AS n, greatest(count(*) - 1, 1)::DOUBLE AS df, avg(score) AS mean,
      stddev_samp(score - mine + grand) / sqrt(count(*)) * CASE WHEN max(c) > 1 THEN sqrt(max(c) / (max(c) - 1)) ELSE 1 END AS se FROM k GROUP BY ALL),
    {t_crit("stat")}, sizes AS (SELECT model, layer, roi, measure, avg(n_voxels) AS mean_voxels FROM scores GROUP BY ALL)
    SELECT model, layer, roi, measure, n, {r6("mean")} AS mean, {r6("crit * se")} AS ci_half, {r6("mean_voxels")} AS mean_voxels
    FROM stat JOIN crit USING (df) JOIN sizes USING (model, layer, roi, measure)""")
def encoding_report(t):
    return sc.encoding_report(scores(t))


MAPS = f"""{ad.ENC_WIDE}, {V}, u AS (UNPIVOT enc_wide ON f, b, m, ns INTO NAME block VALUE v),
  maps AS (SELECT u.model, u.layer, v.subject, v.voxel_id, u.block, CASE WHEN nc > 0.1 THEN u.v / greatest(nc, 0.1) END AS value
    FROM voxels v JOIN u USING (voxel_id))"""


def maps(t):
    return sc.block_map(ad.encoding(t), ad.voxels(t), nc_min=0.1)


@query("block_map", f"""WITH {MAPS}, fitted AS (SELECT DISTINCT model, layer, subject FROM maps),
    every AS (SELECT model, layer, subject, voxel_id, block, value
      FROM fitted JOIN voxels USING (subject) CROSS JOIN (VALUES ('f'), ('b'), ('m'), ('ns')) AS b(block)
      LEFT JOIN maps USING (model, layer, subject, voxel_id, block))
    SELECT model, layer, subject, voxel_id, block, {r6("value")} AS value FROM every""")
def block_map(t):
    return maps(t)


@query("normalize_r2_voxel", f"WITH {MAPS} SELECT layer, subject, voxel_id, {r6('value')} AS value FROM maps WHERE block = 'f'")
def normalize_r2_voxel(t):
    enc = ad.encoding(t).filter("measure = 'f'").join(ad.voxels(t).select("voxel_id", "nc"), "voxel_id")
    return enc.select("layer", "subject", "voxel_id",
                      col.normalize_r2(F.col("value"), F.col("nc"), 0.1).alias("value"))


@query("map_scales", f"""WITH {MAPS} SELECT block, 0.0::DOUBLE AS lo, {r6("greatest(quantile_cont(value, 0.95), 1e-6)")} AS hi FROM maps GROUP BY ALL
    UNION ALL SELECT 'all', 0.0, {r6("greatest(quantile_cont(value, 0.95), 1e-6)")} FROM maps""")
def map_scales(t):
    m = maps(t)
    whole = sc.map_scales(m, False).select(F.lit("all").alias("block"), "lo", "hi")
    return sc.map_scales(m, True).unionByName(whole)


@query("percentile_scale", f"""WITH {ad.TRIALS} SELECT subject, {r6("-quantile_cont(abs(beta - 50), 0.99)")} AS lo,
    {r6("quantile_cont(abs(beta - 50), 0.99)")} AS hi FROM trials GROUP BY ALL""")
def percentile_scale(t):
    return sc.percentile_scale(ad.trials(t).withColumn("value", F.col("beta") - 50), ["subject"], symmetric=True)


PIXELS = """px AS (SELECT vec_id AS image_id, ['face', 'body', 'mixed', 'nonselective'][1 + p // 16] AS sel_type,
    (p % 16 // 4)::INT AS y, (p % 4)::INT AS x, embedding[p + 1]::DOUBLE AS value FROM embeddings, range(64) AS r(p))"""


def pixels(t):
    p = F.col("p")
    return t.embeddings.select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("p", "v")).select(
        "image_id", ad._pick(("face", "body", "mixed", "nonselective"), F.floor(p / 16)).alias("sel_type"),
        F.floor(p % 16 / 4).cast("int").alias("y"), (p % 4).cast("int").alias("x"), F.col("v").cast("double").alias("value"))


SCALED = f"""{PIXELS}, s AS (SELECT image_id, sel_type, min(value) AS lo, quantile_cont(value, 0.99) AS hi FROM px GROUP BY ALL),
  scaled AS (SELECT image_id, sel_type, y, x, least(greatest((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 0), 1) AS value
    FROM px JOIN s USING (image_id, sel_type))"""


@query("rescale_maps", f"WITH {SCALED} SELECT image_id, sel_type, y, x, {r6('value')} AS value FROM scaled")
def rescale_maps(t):
    return sc.rescale_maps(pixels(t))


@query("rescale_maps_joint", f"""WITH {PIXELS}, s AS (SELECT image_id, min(value) AS lo, max(value) AS hi FROM px GROUP BY ALL)
    SELECT image_id, sel_type, y, x, {r6("(value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END")} AS value FROM px JOIN s USING (image_id)""")
def rescale_maps_joint(t):
    return sc.rescale_maps(pixels(t), "joint")


@query("map_differences", f"""WITH {SCALED} SELECT f.image_id, f.y, f.x, 'face' AS a, 'body' AS b, {r6("f.value - g.value")} AS diff
    FROM scaled f JOIN scaled g ON (f.image_id, f.y, f.x) = (g.image_id, g.y, g.x) WHERE f.sel_type = 'face' AND g.sel_type = 'body'""")
def map_differences(t):
    return sc.map_differences(sc.rescale_maps(pixels(t)), [("face", "body")])


# Contrast maps of a localizer: z from a part's order lines, on its own scale per contrast.
CONTRAST_RULES = {
    "face>object": "avg(l_quantity - 25) / 3",
    "body>object": "avg(l_discount - 0.05) * 60",
    "place>object": "avg(l_tax - 0.045) * 60",
    "face>body": "avg(l_quantity - 25) / 3 - avg(l_discount - 0.05) * 60",
    "visual>baseline": "avg(l_quantity - 20) / 2",
}
CONTRASTS = f"""{V}, cw AS (SELECT l_partkey AS voxel_id, {", ".join(f'{r} AS "{c}"' for c, r in CONTRAST_RULES.items())}
    FROM lineitem GROUP BY l_partkey),
  cl AS (UNPIVOT cw ON {", ".join(f'"{c}"' for c in CONTRAST_RULES)} INTO NAME contrast VALUE z),
  zs AS (SELECT v.subject, voxel_id, contrast, cl.z, nc > 0.2 AS in_mask FROM cl JOIN voxels v USING (voxel_id)
    UNION ALL SELECT v.subject, voxel_id, 'body>face', -cl.z, nc > 0.2 FROM cl JOIN voxels v USING (voxel_id) WHERE contrast = 'face>body'),
  pr AS (SELECT subject, voxel_id, contrast, in_mask, CASE WHEN in_mask THEN {normal_sf("z")} END AS p FROM zs),
  pa AS ({step_up("pr", "subject, contrast", "subject, voxel_id, contrast, in_mask, p")}),
  pv AS (SELECT subject, voxel_id, contrast, in_mask, coalesce(p, 1) AS p_raw, coalesce(p_adj, 1) AS p FROM pa)"""


def contrast_maps(t):
    wide = t.lineitem.groupBy(F.col("l_partkey").alias("voxel_id")).agg(
        *[F.expr(r).alias(c) for c, r in CONTRAST_RULES.items()])
    subject = ad.voxels(t).select("subject", "voxel_id")
    return wide.unpivot(["voxel_id"], [f"`{c}`" for c in CONTRAST_RULES], "contrast", "z").join(subject, "voxel_id")


def pvalues(t):
    return ru.contrast_pvalues(contrast_maps(t), ad.voxels(t).filter("nc > 0.2"))


@query("contrast_pvalues", f"WITH {CONTRASTS} SELECT subject, voxel_id, contrast, in_mask, {r6('p_raw')} AS p_raw, {r6('p')} AS p FROM pv")
def contrast_pvalues(t):
    return pvalues(t)


LOCALIZED = f"""{CONTRASTS}, wd AS (SELECT subject, voxel_id,
    max(p) FILTER (contrast = 'face>object') < 0.05 AS fu, max(p) FILTER (contrast = 'body>object') < 0.05 AS bu,
    max(p) FILTER (contrast = 'face>body') < 0.05 AS fb, max(p) FILTER (contrast = 'body>face') < 0.05 AS bf,
    max(p) FILTER (contrast = 'place>object') >= 0.05 AS quiet, max(p) FILTER (contrast = 'visual>baseline') < 0.05 AS responsive
    FROM pv WHERE in_mask GROUP BY ALL),
  lv AS (SELECT subject, voxel_id, fu AND fb AND NOT bu AND quiet AS face, bu AND bf AND NOT fu AND quiet AS body,
    fu AND bu AND quiet AS mixed, NOT fu AND NOT bu AS non, responsive FROM wd),
  loc AS (SELECT *, NOT (face OR body OR mixed OR non) AS other FROM lv)"""


@query("localize_voxels", f"WITH {LOCALIZED} SELECT * FROM loc")
def localize_voxels(t):
    return ru.localize_voxels(pvalues(t))


@query("label_counts", f"""WITH {LOCALIZED} SELECT subject, {", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in ru.LABELS)},
    count(*) AS n_total FROM loc GROUP BY ALL""")
def label_counts(t):
    return ru.label_counts(ru.localize_voxels(pvalues(t)))


@query("raw_cutoffs", f"""WITH {CONTRASTS} SELECT subject, contrast, {r6("coalesce(max(p_raw) FILTER (p < 0.05), 0)")} AS cutoff
    FROM pv WHERE contrast IN ('face>object', 'body>object') GROUP BY ALL""")
def raw_cutoffs(t):
    return ru.raw_cutoffs(pvalues(t))


@query("fmri_totals", f"""WITH {LOCALIZED} SELECT count(DISTINCT subject) AS n_subjects, count(*) FILTER (face) AS face,
    count(*) FILTER (body) AS body, count(*) FILTER (mixed) AS mixed FROM loc""")
def fmri_totals(t):
    return ru.fmri_totals(ru.localize_voxels(pvalues(t)))


@query("ventral_mask", f"""WITH {M}, {STREAM} SELECT subject, voxel_id, voxel_id IN (SELECT voxel_id FROM members WHERE roi = 'V1') AS seed
    FROM sv WHERE stream_value IN (1, 2, 3) OR voxel_id IN (SELECT voxel_id FROM members WHERE roi = 'PPA')""")
def ventral_mask(t):
    streams = ro.stream_mask(stream_voxels(t), stream_labels(t), ro.VENTRAL_STREAMS)
    return ro.ventral_mask(streams, ad.roi_members(t))


@query("vox_align", f"""WITH {V}, {STREAM} SELECT subject, voxel_id, stream_value, {r6("d_norm")} AS d_norm
    FROM voxels JOIN sv USING (subject, voxel_id)""")
def vox_align(t):
    return ro.vox_align(stream_voxels(t).select("subject", "voxel_id", "stream_value"),
                        ad.voxels(t).select("subject", "voxel_id", "d_norm"))


@query("scan_voxel_labels", f"""WITH {L} SELECT subject, voxel_id, label FROM labels_of l WHERE label <> 'responsive'
    AND voxel_id IN (SELECT voxel_id FROM labels_of WHERE label = 'responsive')""")
def scan_voxel_labels(t):
    """Written as a wide CSV of 0/1 columns, read back long."""
    names = ("face", "body", "mixed", "non", "other", "responsive")
    path = folder(t, "labels")
    ad.voxel_labels(t).groupBy("subject", "voxel_id").agg(*[
        F.max((F.col("label") == n).cast("int")).alias(n) for n in names]).write.csv(path, header=True)
    labels = sn.scan_voxel_labels(t.spark, path, columns=names)
    return sn.select_labels(labels, names[:-1], responsive=True)


@query("fwe_threshold", f"""WITH {ad.TRIALS}, nm AS (SELECT subject, session * 100 + image_id AS perm_id, max(beta) AS null_max FROM trials GROUP BY ALL)
    SELECT subject, {r6("quantile_cont(null_max, 0.95)")} AS threshold FROM nm GROUP BY ALL""")
def fwe_threshold(t):
    nm = ad.trials(t).groupBy("subject", "session", "image_id").agg(F.max("beta").alias("null_max"))
    return inf.fwe_threshold(nm)


@query("sig_mask", f"""WITH {ad.TRIALS}, nm AS (SELECT subject, session, image_id, max(beta) AS null_max FROM trials GROUP BY ALL),
    th AS (SELECT subject, quantile_cont(null_max, 0.5) AS threshold FROM nm GROUP BY ALL)
    SELECT subject, trial_id FROM trials JOIN th USING (subject) WHERE beta > threshold""")
def sig_mask(t):
    tr = ad.trials(t)
    nm = tr.groupBy("subject", "session", "image_id").agg(F.max("beta").alias("null_max"))
    return inf.sig_mask(tr, inf.fwe_threshold(nm, alpha=0.5), value="beta").select("subject", "trial_id")


@query("permutation_p", f"""WITH {ad.TRIALS}, r AS (SELECT subject, voxel_id, avg(beta) AS real FROM trials GROUP BY ALL)
    SELECT subject, voxel_id, {r6("(1 + count(*) FILTER (beta >= real)) / (1 + count(*))")} AS p_perm
    FROM trials JOIN r USING (subject, voxel_id) GROUP BY ALL""")
def permutation_p(t):
    tr = ad.trials(t)
    real = tr.groupBy("subject", "voxel_id").agg(F.avg("beta").alias("r2"))
    return inf.permutation_p(tr.join(real, ["subject", "voxel_id"]), null="beta")


@query("winner_map", f"""WITH {MAPS}, r AS (SELECT *, row_number() OVER (PARTITION BY layer, subject, voxel_id ORDER BY value DESC,
      list_position(['f', 'b', 'm', 'ns'], block)) AS rn FROM maps WHERE value IS NOT NULL)
    SELECT layer, subject, voxel_id, block AS winner, {r6("value")} AS best FROM r WHERE rn = 1""")
def winner_map(t):
    rows = maps(t).filter("value IS NOT NULL")
    return co.winner_take_all(rows, ["f", "b", "m", "ns"], ("layer", "subject", "voxel_id"))
