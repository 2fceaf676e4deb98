"""Queries over ranked cohorts, layer curves and diet contrasts."""

from pyspark.sql import functions as F

from unimass.operators import cohorts as co
from unimass.operators import curves as cu
from unimass.operators import inference as inf
from unimass.operators import moments as mo
from unimass.plans import adapters as ad
from unimass.plans.registry import query, r6
from unimass.plans.sql import MOMENTS, dprime_cte, normal_sf, step_up, t_crit, t_sf
from unimass.plans.unit_queries import acts

TYPES = {"face": ["face"], "body": ["body"], "mixed": ["face", "body"]}
CUT = {"face": 0.25, "body": 0.2, "mixed": 0.3}
UNIT = "model, layer, unit_id"


def labelled(t):
    """Units selective by d' alone: a type holds where its d' is largest and above its cut."""
    d = mo.dprime(mo.unit_profiles(mo.unit_moments(acts(t))), TYPES)
    cut = F.coalesce(*[F.when(F.col("sel_type") == k, F.lit(v)) for k, v in CUT.items()])
    best = d.groupBy("model", "layer", "unit_id").agg(F.max("dval").alias("top"))
    return d.join(best, ["model", "layer", "unit_id"]).withColumn(
        "selected", (F.col("dval") == F.col("top")) & (F.col("dval") > cut)).drop("top")


_cut = " ".join(f"WHEN '{k}' THEN {v}" for k, v in CUT.items())
LABELLED = f"""{ad.ACTS}, {dprime_cte(TYPES)}, labelled AS (
  SELECT *, round(dval, 9) = round(max(dval) OVER (PARTITION BY {UNIT}), 9)
    AND dval > CASE sel_type {_cut} END AS selected FROM dvals)"""
GROUPS = f"""{LABELLED}, chosen AS (SELECT {UNIT}, sel_type, dval FROM labelled WHERE selected),
  groups_of AS (SELECT * FROM chosen UNION ALL
    SELECT {UNIT}, 'nonselective' AS sel_type, dval
    FROM (SELECT {UNIT}, dval FROM dvals WHERE sel_type = 'mixed') ANTI JOIN chosen USING ({UNIT})),
  placed AS (SELECT *, row_number() OVER (PARTITION BY model, layer, sel_type ORDER BY
      CASE WHEN sel_type = 'nonselective' THEN dval ELSE -dval END, unit_id) AS rank
    FROM groups_of)"""
COHORT = f"""{GROUPS}, sizes AS (SELECT model, layer, min(n) AS cut FROM (
      SELECT model, layer, sel_type, count(*) AS n FROM chosen GROUP BY ALL) GROUP BY ALL),
  cohort AS (SELECT placed.* FROM placed LEFT JOIN sizes USING (model, layer)
    WHERE cut IS NULL OR rank <= cut)"""


def groups(t):
    return co.unit_groups(labelled(t))


def cohort(t):
    return co.rank_units(groups(t), controlled=True)


@query("nonselective_units", f"WITH {GROUPS} SELECT {UNIT} FROM groups_of WHERE sel_type = 'nonselective'")
def nonselective_units(t):
    return co.nonselective_units(labelled(t))


@query("rank_units", f"WITH {COHORT} SELECT {UNIT}, sel_type, {r6('dval')} AS dval, rank FROM cohort")
def rank_units(t):
    return cohort(t)


@query("rank_units_top", f"""WITH {GROUPS} SELECT {UNIT}, sel_type, {r6('dval')} AS dval, rank
    FROM placed WHERE sel_type = 'nonselective' OR rank <= 3""")
def rank_units_top(t):
    return co.rank_units(groups(t), n_top=3)


@query("dprime_summary", f"""WITH {COHORT}, lm AS (SELECT model, layer, sel_type, avg(dval) AS m,
      count(*) AS n FROM cohort WHERE sel_type <> 'nonselective' GROUP BY ALL)
    SELECT model, sel_type, {r6("avg(m)")} AS mean,
      {r6("CASE WHEN count(*) > 1 THEN stddev_samp(m) ELSE 0 END")} AS sd,
      sum(n)::BIGINT AS n_units, count(*) AS n_layers FROM lm GROUP BY ALL""")
def dprime_summary(t):
    return co.dprime_summary(cohort(t))


@query("dprime_summary_units", f"""WITH {COHORT} SELECT model, sel_type, {r6("avg(dval)")} AS mean,
      {r6("CASE WHEN count(*) > 1 THEN stddev_samp(dval) ELSE 0 END")} AS sd,
      count(*) AS n_units, count(DISTINCT layer) AS n_layers
    FROM cohort WHERE sel_type <> 'nonselective' GROUP BY ALL""")
def dprime_summary_units(t):
    return co.dprime_summary(cohort(t), "units")


RESPONSE = f"""{COHORT}, responses AS (SELECT a.model, image_id, sel_type, avg(act) AS resp
  FROM acts a JOIN cohort USING (model, layer, unit_id) GROUP BY ALL)"""


@query("mean_type_response", f"WITH {RESPONSE} SELECT model, image_id, sel_type, {r6('resp')} AS resp FROM responses")
def mean_type_response(t):
    return co.mean_type_response(acts(t), cohort(t))


@query("top_images", f"""WITH {RESPONSE}, z AS (SELECT sel_type, image_id,
      (resp - avg(resp) OVER w) / stddev_pop(resp) OVER w AS z FROM responses
      WINDOW w AS (PARTITION BY model, sel_type)),
    s AS (SELECT sel_type, image_id, avg(z) AS score FROM z GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY sel_type ORDER BY score DESC, image_id)::INT AS rank FROM s)
    SELECT sel_type, image_id, {r6("score")} AS score, rank FROM r WHERE rank <= 10""")
def top_images(t):
    return co.top_images(co.mean_type_response(acts(t), cohort(t)), 10)


COUNTS = f"""{LABELLED}, counts AS (SELECT model, layer, sel_type,
  count(*) FILTER (selected) AS k, count(*) AS n FROM labelled GROUP BY ALL)"""
# grid of 10 over 4 layers at 0, 1/3, 2/3, 1
CURVES = f"""{COUNTS}, pts AS (SELECT model, sel_type, layer[5:]::INT - 1 AS o, 100.0 * k / n AS v FROM counts),
  curves AS (SELECT a.model, a.sel_type, g AS bin, g / 9.0 AS x,
      a.v + (b.v - a.v) * (g / 3.0 - least(g // 3, 2)) AS y
    FROM range(10) AS r(g) JOIN pts a ON a.o = least(g // 3, 2)
    JOIN pts b ON b.o = a.o + 1 AND (b.model, b.sel_type) = (a.model, a.sel_type))"""


def prevalence(t):
    counts = labelled(t).groupBy("model", "layer", "sel_type").agg(
        (100.0 * F.count_if("selected") / F.count("*")).alias("y"))
    return cu.interp_curve(counts.withColumn("layer_ord", F.substring("layer", 5, 3).cast("int")),
                           ["model", "sel_type"])


@query("interp_curve", f"WITH {CURVES} SELECT model, sel_type, bin::INT AS bin, {r6('x')} AS x, {r6('y')} AS y FROM curves")
def interp_curve(t):
    return prevalence(t)


@query("mean_sem", f"""WITH {CURVES} SELECT sel_type, bin::INT AS bin, count(y) AS n,
    {r6("avg(y)")} AS mean, {r6("stddev_samp(y) / sqrt(count(y))")} AS err FROM curves GROUP BY ALL""")
def mean_sem(t):
    return cu.mean_sem(prevalence(t), ["sel_type", "bin"])


MISSING = """weekly AS (SELECT subject, session, voxel_id, stddev_samp(beta) AS y FROM trials GROUP BY ALL)"""


@query("mean_sem_rows", f"""WITH {ad.TRIALS}, {MISSING} SELECT subject, session, count(*) AS n,
    {r6("avg(y)")} AS mean, {r6("stddev_samp(y) / sqrt(count(*))")} AS err FROM weekly GROUP BY ALL""")
def mean_sem_rows(t):
    weekly = ad.trials(t).groupBy("subject", "session", "voxel_id").agg(
        F.stddev_samp("beta").alias("y"))
    return cu.mean_sem_rows(weekly, ["subject", "session"])


DIET = f"""{CURVES}, dc AS (SELECT split_part(model, '_', 2) AS diet, split_part(model, '_', 1) AS arch,
    sel_type AS key, bin::INT AS bin, y FROM curves),
  both_modes AS (SELECT 'raw' AS mode, * FROM dc UNION ALL
    SELECT 'diff' AS mode, a.diet, a.arch, a.key, a.bin, a.y - b.y FROM dc a JOIN dc b
      USING (arch, key, bin) WHERE b.diet = 'imagenet' AND a.diet <> 'imagenet')"""


def diets(t):
    c = prevalence(t).select(
        F.substring_index("model", "_", -1).alias("diet"),
        F.substring_index("model", "_", 1).alias("arch"), F.col("sel_type").alias("key"), "bin", "y")
    return cu.diet_curves(c, "imagenet")


@query("diet_curves", f"WITH {DIET} SELECT mode, diet, arch, key, bin, {r6('y')} AS y FROM both_modes")
def diet_curves(t):
    return diets(t)


@query("diet_summary", f"""WITH {DIET} SELECT mode, diet, arch, key, {r6("avg(y)")} AS mean,
    {r6("arg_max(y, bin)")} AS deepest FROM both_modes GROUP BY ALL""")
def diet_summary(t):
    return cu.diet_summary(diets(t))


@query("layer_dprime_curves", f"""WITH {LABELLED}, lm AS (SELECT model, sel_type, layer[5:]::INT - 1 AS o,
      avg(dval) FILTER (selected) AS v FROM labelled GROUP BY ALL),
    ok AS (SELECT model, sel_type, o / 3.0 AS x, v, count(*) OVER (PARTITION BY model, sel_type) AS np
      FROM lm WHERE v IS NOT NULL),
    cells AS (SELECT DISTINCT model, sel_type, g, g / 9.0 AS x FROM lm, range(10) AS r(g)),
    near AS (SELECT c.model, c.sel_type, c.g, c.x, max(np) AS np,
      arg_max(k.x, k.x) FILTER (k.x <= c.x + 1e-12) AS x0, arg_max(k.v, k.x) FILTER (k.x <= c.x + 1e-12) AS v0,
      arg_min(k.x, k.x) FILTER (k.x >= c.x - 1e-12) AS x1, arg_min(k.v, k.x) FILTER (k.x >= c.x - 1e-12) AS v1
      FROM cells c LEFT JOIN ok k ON (k.model, k.sel_type) = (c.model, c.sel_type) GROUP BY ALL)
    SELECT model, sel_type, g::INT AS bin, {r6("x")} AS x, CASE WHEN np >= 2 THEN
      {r6("CASE WHEN x0 < x1 THEN v0 + (v1 - v0) * (x - x0) / (x1 - x0) ELSE coalesce(v0, v1) END")}
      END AS y FROM near""")
def layer_dprime_curves(t):
    units = labelled(t)
    dims = units.select("model", "layer").distinct().withColumn(
        "layer_ord", F.substring("layer", 5, 3).cast("int"))
    means = cu.layer_means(units.filter("selected"), dims)
    return cu.interp_curve(means, ["model", "sel_type"])


SPEARMAN = """ranked AS (SELECT entity, key, x, y,
    rank() OVER (PARTITION BY entity, key ORDER BY x) + (count(*) OVER (PARTITION BY entity, key, x) - 1) / 2 AS rx,
    rank() OVER (PARTITION BY entity, key ORDER BY y) + (count(*) OVER (PARTITION BY entity, key, y) - 1) / 2 AS ry
    FROM pts WHERE y IS NOT NULL),
  rho0 AS (SELECT entity, key, count(*) AS n, CASE WHEN count(*) >= 3 AND min(ry) < max(ry)
    AND min(rx) < max(rx) THEN round(corr(rx, ry), 14) END AS rho FROM ranked GROUP BY ALL),
  rho AS (SELECT entity, key, coalesce(n, 0) AS n, rho FROM (SELECT DISTINCT entity, key FROM pts)
    LEFT JOIN rho0 USING (entity, key))"""
YEARLY = """pts AS (SELECT o_custkey AS entity, o_orderpriority AS key, year(o_orderdate) AS x,
    round(avg(o_totalprice), 2) AS y FROM orders GROUP BY ALL)"""


def yearly(t):
    return t.orders.groupBy(
        F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("key"),
        F.year("o_orderdate").alias("x")).agg(F.round(F.avg("o_totalprice"), 2).alias("y"))


@query("spearman_curve", f"WITH {YEARLY}, {SPEARMAN} SELECT entity, key, n, {r6('rho')} AS rho FROM rho")
def spearman_curve(t):
    return inf.spearman_curve(yearly(t), ["entity", "key"])


@query("spearman_curve_p", f"""WITH pts AS (SELECT 0 AS entity, o_orderpriority AS key,
      month(o_orderdate) AS x, round(avg(o_totalprice), 2) AS y FROM orders GROUP BY ALL), {SPEARMAN},
    tt AS (SELECT *, CASE WHEN abs(rho) < 1 AND n > 2 THEN abs(rho) * sqrt((n - 2) / (1 - rho * rho)) END AS t FROM rho)
    SELECT key, n, {r6("rho")} AS rho, {r6("2 * " + t_sf("t", "(n - 2.0::DOUBLE)"))} AS p FROM tt""")
def spearman_curve_p(t):
    monthly = t.orders.groupBy(F.col("o_orderpriority").alias("key"),
                               F.month("o_orderdate").alias("x")).agg(
        F.round(F.avg("o_totalprice"), 2).alias("y"))
    return inf.spearman_curve(monthly, ["key"], with_p=True)


@query("average_rank", f"""WITH {ad.TRIALS} SELECT trial_id, {r6('''rank() OVER (PARTITION BY subject ORDER BY round(beta))
    + (count(*) OVER (PARTITION BY subject, round(beta)) - 1) / 2''')} AS avg_rank FROM trials""")
def average_rank(t):
    from unimass.operators.ordering import average_rank as rank

    whole = ad.trials(t).select("subject", "trial_id", F.round("beta").alias("v"))
    return rank(whole, ["subject"], "v").select("trial_id", "avg_rank")


@query("gradient_stats", f"""WITH {YEARLY}, {SPEARMAN},
    f AS (SELECT key, rho FROM rho WHERE rho IS NOT NULL),
    nz AS (SELECT key, rho, rank() OVER (PARTITION BY key ORDER BY abs(rho))
      + (count(*) OVER (PARTITION BY key, abs(rho)) - 1) / 2 AS ar,
      count(*) OVER (PARTITION BY key, abs(rho)) AS tie FROM f WHERE rho <> 0),
    s AS (SELECT key, count(*) AS n, sum(ar) FILTER (rho > 0) AS plus, sum(tie * tie - 1) AS ties FROM nz GROUP BY key),
    w AS (SELECT key, least(plus, n * (n + 1) / 2 - plus) AS w,
      (n * (n + 1) / 4 - least(plus, n * (n + 1) / 2 - plus))
        / sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48) AS z FROM s),
    base AS (SELECT key, count(rho) AS n, count(*) FILTER (rho > 0) AS n_pos, quantile_cont(rho, 0.5) AS median_r,
      min(rho) AS r_min, max(rho) AS r_max FROM rho GROUP BY key),
    raw AS (SELECT *, least(1, 2 * {normal_sf("z")}) AS p_raw FROM (SELECT base.*, w, z, ties, s.n AS n_rest FROM base JOIN w USING (key) JOIN s USING (key))),
    adjusted AS ({step_up("raw", "", "*", "p_raw", "bh", "p")})
    SELECT key, n, n_pos, {r6("median_r")} AS median_r, {r6("r_min")} AS r_min, {r6("r_max")} AS r_max, {r6("w")} AS w,
      {r6("p_raw")} AS p_raw, {r6("p")} AS p FROM adjusted""")
def gradient_stats(t):
    """Hundreds of entities with ties: the signed-rank test takes its normal limit."""
    out = inf.gradient_stats(yearly(t))
    return out.select("key", "n", "n_pos", "median_r", "r_min", "r_max", "w", "p_raw", "p")


DIMS = """dims(diet, position, model, layer, layer_ord)"""


@query("winner_take_all", f"""WITH {ad.TRIALS}, v AS (SELECT voxel_id, image_id, subject, round(avg(beta)) AS v FROM trials GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY voxel_id, image_id ORDER BY v DESC,
      list_position(['view', 'click', 'error', 'signup', 'purchase'], subject)) AS rn FROM v)
    SELECT voxel_id, image_id, subject AS winner, {r6("v")} AS best FROM r WHERE rn = 1""")
def winner_take_all(t):
    # a half is one whatever the order of its sum
    v = ad.trials(t).groupBy("voxel_id", "image_id", "subject").agg(
        F.round(F.round(F.avg("beta"), 9)).alias("value"))
    return co.winner_take_all(v, ["view", "click", "error", "signup", "purchase"],
                              ("voxel_id", "image_id"), "subject")


@query("within_subject_ci", f"""WITH RECURSIVE d AS (SELECT o_orderstatus AS roi, o_custkey AS subject,
      year(o_orderdate) AS condition, avg(o_totalprice) AS x FROM orders GROUP BY ALL),
    full_rows AS (SELECT *, count(*) OVER (PARTITION BY roi, subject) AS have,
      avg(x) OVER (PARTITION BY roi, subject) AS own FROM d),
    nc AS (SELECT roi, count(DISTINCT condition) AS c FROM d GROUP BY roi),
    k AS (SELECT roi, subject, condition, x, own, c, avg(x) OVER (PARTITION BY roi) AS grand
      FROM full_rows JOIN nc USING (roi) WHERE have = c),
    o AS (SELECT roi, condition, count(*) AS n, avg(x) AS mean, greatest(count(*) - 1, 1)::DOUBLE AS df,
      stddev_samp(x - own + grand) / sqrt(count(*)) * sqrt(max(c) / (max(c) - 1)) AS se FROM k GROUP BY ALL), {t_crit("o")}
    SELECT roi, condition, n, {r6("mean")} AS mean, {r6("crit * se")} AS ci_half FROM o JOIN crit USING (df)""")
def within_subject_ci(t):
    d = t.orders.groupBy(
        F.col("o_orderstatus").alias("roi"), F.col("o_custkey").alias("subject"),
        F.year("o_orderdate").cast("bigint").alias("condition")
    ).agg(F.avg("o_totalprice").alias("score"))
    return cu.within_subject_ci(d, ["roi"])


def _fold_size(n, k, i):
    """Size of fold i of k when the first n % k folds hold one more."""
    return f"({n} // {k} + CASE WHEN {i} < {n} % {k} THEN 1 ELSE 0 END)"


@query("fold_cells", f"""WITH n AS (SELECT event_type AS subject, count(*) AS n FROM events GROUP BY ALL),
    o AS (SELECT subject, o, {_fold_size("n", 10, "o")} AS w FROM n, range(10) AS r(o))
    SELECT subject, o::INT AS outer_fold, i::INT AS inner_fold, {_fold_size("w", 5, "i")} AS n_images
    FROM o, range(5) AS r(i)""")
def fold_cells(t):
    """Cell sizes: which image falls into which cell is the seeded shuffle's business."""
    cells = co.fold_cells(ad.trials(t).select("subject", F.col("trial_id").alias("image_id")))
    return cells.groupBy("subject", "outer_fold", "inner_fold").agg(
        F.count("*").alias("n_images"))


@query("stratified_split", """WITH n AS (SELECT label AS category, count(*) AS n FROM embeddings GROUP BY ALL),
    s AS (SELECT category, n, round_even(n * 0.6, 0)::BIGINT AS train, round_even(n * 0.2, 0)::BIGINT AS val FROM n)
    SELECT category, 'train' AS split, train AS n_images FROM s UNION ALL
    SELECT category, 'val', val FROM s UNION ALL SELECT category, 'test', n - train - val FROM s""")
def stratified_split(t):
    images = t.embeddings.select(F.col("vec_id").alias("image_id"), F.col("label").alias("category"))
    return co.stratified_split(images).groupBy("category", "split").agg(
        F.count("*").alias("n_images"))


@query("match_diets", """WITH m AS (SELECT DISTINCT vec_id % 4 AS g, CASE WHEN vec_id % 4 = 1 AND p = 2 THEN 'pool' ELSE 'conv' || (1 + p) END AS layer,
      p AS layer_ord FROM embeddings, range(4) AS r(p) WHERE NOT (vec_id % 4 = 3 AND p = 0)),
    d AS (SELECT g % 2 AS diet, g // 2 AS position, layer, layer_ord FROM m)
    SELECT position, layer_ord::INT AS layer_ord, count(DISTINCT diet) AS n_diets, count(DISTINCT layer) AS n_names
    FROM d GROUP BY ALL HAVING count(DISTINCT diet) < 2 OR count(DISTINCT layer) > 1""")
def match_diets(t):
    models = ad.activation_blocks(t).select("model", "layer").distinct().select(
        F.substring_index("model", "_", -1).alias("diet"),
        F.when(F.col("model").startswith("alexnet"), F.lit(0).cast("bigint")).otherwise(1).alias("position"),
        "model", "layer", (F.substring("layer", 5, 3).cast("int") - 1).alias("layer_ord"))
    # one diet lacks a layer and names another one otherwise
    other, first = F.col("diet") != "imagenet", F.col("position") == 0
    models = models.filter(~(other & ~first & (F.col("layer_ord") == 0))).withColumn(
        "layer", F.when(other & first & (F.col("layer_ord") == 2), "pool").otherwise(F.col("layer")))
    return cu.match_diets(models, "imagenet")
