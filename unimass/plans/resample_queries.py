"""Bootstraps over flags, hierarchies and scores.

The draws are random: the SQL states observed means, counts and effect sizes, and that every drawn
figure is where its limit puts it. `width_ok`: half the interval is its standard error in closed
form times the normal quantile, within a quarter; `p_ok`: p is that of the normal limit, within
0.05; `centred`: the mean of the draws is the observed one, within a tenth of the standard error.
No row is left out. The tests compare the intervals with naive resampling.
"""

from pyspark.sql import functions as F

from unimass.functions import special as sp
from unimass.operators import resample as rs
from unimass.plans import adapters as ad
from unimass.plans.registry import query, r6
from unimass.plans.roi_queries import REGIONS, SCORES, parts, scores

CONDITIONS = ("face", "body", "mixed", "nonselective")
N_ITER = 10_000


def patterns(t):
    """0/1 outcomes of each order line under every condition."""
    flags = [F.expr(rule).cast("int").cast("double").alias(c) for c, rule in ad.FLAG_RULES.items()]
    return t.lineitem.select(F.col("l_returnflag").alias("task"), F.col("l_linenumber").alias("repeat"), *flags)


PATTERNS = "pat AS (SELECT l_returnflag AS task, l_linenumber AS repeat, " + ", ".join(
    f"({rule})::INT AS {c}" for c, rule in ad.FLAG_RULES.items()) + " FROM lineitem)"
DROPS = f"{PATTERNS}, dl AS (" + " UNION ALL ".join(
    f"SELECT task, repeat, '{c}' AS condition, baseline AS base, {c} AS les FROM pat" for c in CONDITIONS) + ")"


@query("flag_patterns", f"""WITH {PATTERNS} SELECT task, repeat, baseline::DOUBLE AS baseline,
    {", ".join(f"{c}::DOUBLE AS {c}" for c in CONDITIONS)}, count(*) AS n FROM pat GROUP BY ALL""")
def flag_patterns(t):
    wide = rs.flag_patterns(ad.flags(t), CONDITIONS)
    return wide.groupBy("task", "repeat", "baseline", *CONDITIONS).agg(F.count("*").alias("n"))


Z = 1.959963985


def width_ok(half, se):
    """No spread has no width; else the half width is near its limit."""
    return F.when(se > 1e-12, F.abs(half / (Z * se) - 1) < 0.25).otherwise(half < 1e-9).alias("width_ok")


def p_ok(p, mean, se):
    tail = 2 * sp.normal_sf(F.abs(mean) / F.when(se > 1e-12, se))
    return F.when(se > 1e-12, F.abs(F.least(p, F.lit(1.0)) - tail) < 0.05).otherwise(True).alias("p_ok")


def centred(drawn, mean, se):
    return (F.abs(drawn - mean) <= 0.1 * se + 1e-9).alias("centred")


HALF = "(ci_high - ci_low) / 2"


@query("boot_mean_ci", f"SELECT o_orderpriority, count(*) AS n, {r6('avg(o_totalprice)')} AS mean, true AS width_ok FROM orders GROUP BY ALL")
def boot_mean_ci(t):
    out = rs.boot_mean_ci(t.orders, ["o_orderpriority"], "o_totalprice", N_ITER)
    return out.select("o_orderpriority", "n", "mean", width_ok(F.expr(HALF), F.col("sd") * F.sqrt(F.col("n") - 1) / F.col("n")))


@query("boot_mean_halfwidth", f"""WITH {SCORES} SELECT model, layer, roi, measure, count(*) AS n, {r6("avg(score)")} AS mean, true AS width_ok
    FROM scores GROUP BY ALL""")
def boot_mean_halfwidth(t):
    own = scores(t)
    keys = ["model", "layer", "roi", "measure"]
    se = own.groupBy(*keys).agg((F.stddev_pop("score") / F.sqrt(F.count("score"))).alias("se"))
    out = rs.boot_mean_halfwidth(own, keys[:3], n_iter=N_ITER).join(se, keys)
    return out.select(*keys, "n", "mean", width_ok(F.col("ci_half"), F.col("se")))


@query("nc_band", f"""WITH {REGIONS}, s AS (SELECT roi, r.subject, avg(nc) AS nc FROM regions r JOIN voxels USING (subject, voxel_id) GROUP BY ALL)
    SELECT roi, count(*) AS n, {r6("avg(nc)")} AS mean, true AS width_ok FROM s GROUP BY ALL""")
def nc_band(t):
    nc = parts(t)[1]
    se = nc.groupBy("roi", "subject").agg(F.avg("nc").alias("nc")).groupBy("roi").agg(
        (F.stddev_pop("nc") / F.sqrt(F.count("nc"))).alias("se"))
    return rs.nc_band(nc, N_ITER).join(se, "roi").select("roi", "n", "mean", width_ok(F.col("ci_half"), F.col("se")))


def drops_of(t):
    """(task, repeat, condition, v): the drop of every image."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), (F.col("baseline") - F.col(c)).alias("v"))
                               for c in CONDITIONS])).alias("e")
    return patterns(t).select("task", "repeat", "baseline", each).select("task", "repeat", "baseline", "e.*")


def pairs_of(t):
    """(task, repeat, a, b, v): the difference of two drops of every image."""
    each = F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.col(b) - F.col(a)).alias("v"))
        for i, a in enumerate(CONDITIONS) for b in CONDITIONS[i + 1:]])).alias("e")
    return patterns(t).select("task", "repeat", "baseline", each).select("task", "repeat", "baseline", "e.*")


def flat_error(rows, keys):
    return rows.groupBy(*keys).agg(F.avg("v").alias("seen"), (F.stddev_pop("v") / F.sqrt(F.count("v"))).alias("se"))


def nested_error(rows, keys):
    """Mean of split means and its error when splits and then images are drawn, absolute and relative."""
    split = rows.groupBy("task", "repeat", *keys).agg(
        F.avg("v").alias("m"), (F.var_pop("v") / F.count("v")).alias("w"), F.avg("baseline").alias("acc"))
    both = F.explode(F.array(F.struct(F.lit("abs").alias("scale"), F.lit(1.0).alias("by")),
                             F.struct(F.lit("rel").alias("scale"), F.col("acc").alias("by")))).alias("s")
    scaled = split.select("task", *keys, "m", "w", both).select(
        "task", *keys, "s.scale", (F.col("m") / F.col("s.by")).alias("m"), (F.col("w") / F.col("s.by") ** 2).alias("w"))
    return scaled.groupBy("task", "scale", *keys).agg(
        F.avg("m").alias("seen"), F.sqrt((F.var_pop("m") + F.avg("w")) / F.count("m")).alias("se"))


@query("boot_drop_ci", f"""WITH {DROPS} SELECT task, repeat, condition, count(*) AS n, {r6("avg(base)")} AS baseline,
    {r6("avg(les)")} AS lesioned, {r6("avg(base) - avg(les)")} AS drop_point, true AS centred, true AS width_ok FROM dl GROUP BY ALL""")
def boot_drop_ci(t):
    keys = ["task", "repeat", "condition"]
    out = rs.boot_drop_ci(patterns(t), CONDITIONS, n_iter=N_ITER).join(flat_error(drops_of(t), keys), keys)
    return out.select(*keys, "n", "baseline", "lesioned", "drop_point", centred(F.col("drop"), F.col("seen"), F.col("se")),
                      width_ok(F.expr(HALF), F.col("se")))


PAIRS = f"{PATTERNS}, pl AS (" + " UNION ALL ".join(
    f"SELECT task, repeat, '{a}' AS a, '{b}' AS b, baseline AS base, {a} AS les_a, {b} AS les_b FROM pat"
    for i, a in enumerate(CONDITIONS) for b in CONDITIONS[i + 1:]) + ")"


@query("boot_paired_diff", f"""WITH {PAIRS} SELECT task, repeat, a, b, {r6("avg(les_b) - avg(les_a)")} AS diff_point,
    true AS centred, true AS width_ok, true AS p_ok FROM pl GROUP BY ALL""")
def boot_paired_diff(t):
    keys = ["task", "repeat", "a", "b"]
    out = rs.boot_paired_diff(patterns(t), CONDITIONS, n_iter=N_ITER).join(flat_error(pairs_of(t), keys), keys)
    return out.select(*keys, "diff_point", centred(F.col("mean_diff"), F.col("seen"), F.col("se")),
                      width_ok(F.expr(HALF), F.col("se")), p_ok(F.col("p"), F.col("seen"), F.col("se")))


@query("boot_hier_drop", f"""WITH {DROPS}, acc AS (SELECT task, repeat, avg(baseline) AS acc FROM pat GROUP BY ALL),
    own AS (SELECT task, repeat, condition, avg(base) - avg(les) AS s FROM dl GROUP BY ALL),
    sc AS (SELECT task, 'abs' AS scale, condition, s FROM own UNION ALL SELECT task, 'rel', condition, s / acc FROM own JOIN acc USING (task, repeat))
    SELECT task, scale, condition, count(*) AS n_splits, {r6("avg(s)")} AS observed, true AS centred, true AS width_ok, true AS p_ok FROM sc GROUP BY ALL""")
def boot_hier_drop(t):
    keys = ["task", "scale", "condition"]
    out = rs.boot_hier_drop(patterns(t), CONDITIONS, n_iter=N_ITER).join(nested_error(drops_of(t), ["condition"]), keys)
    return out.select(*keys, "n_splits", F.col("seen").alias("observed"), centred(F.col("mean_drop"), F.col("seen"), F.col("se")),
                      width_ok(F.expr(HALF), F.col("se")), p_ok(F.col("p"), F.col("seen"), F.col("se")))


@query("boot_hier_paired", f"""WITH {PAIRS}, acc AS (SELECT task, repeat, avg(baseline) AS acc FROM pat GROUP BY ALL),
    own AS (SELECT task, repeat, a, b, avg(les_b) - avg(les_a) AS s FROM pl GROUP BY ALL),
    sc AS (SELECT task, 'abs' AS scale, a, b, s FROM own UNION ALL
      SELECT task, 'rel', a, b, s / acc FROM own JOIN acc USING (task, repeat))
    SELECT task, scale, a, b, count(*) AS n_splits, {r6("avg(s) / stddev_samp(s)")} AS cohens_d, {r6("avg(s)")} AS observed,
      true AS centred, true AS width_ok, true AS p_ok FROM sc GROUP BY ALL""")
def boot_hier_paired(t):
    keys = ["task", "scale", "a", "b"]
    out = rs.boot_hier_paired(patterns(t), CONDITIONS, n_iter=N_ITER).join(nested_error(pairs_of(t), ["a", "b"]), keys)
    return out.select(*keys, "n_splits", "cohens_d", F.col("seen").alias("observed"),
                      centred(F.col("mean_diff"), F.col("seen"), F.col("se")),
                      width_ok(F.expr(HALF), F.col("se")), p_ok(F.col("p"), F.col("seen"), F.col("se")))


@query("boot_hier_units", f"""WITH {ad.HIERARCHY} SELECT sel_type, {r6("avg(face_d)")} AS mean, count(*) AS n, true AS inside FROM units GROUP BY ALL""")
def boot_hier_units(t):
    out = rs.boot_hier_units(ad.hierarchy(t), ["sel_type"], "face_d", N_ITER)
    return out.select("sel_type", "mean", "n", F.col("mean").between(F.col("ci_low"), F.col("ci_high")).alias("inside"))


@query("dprime_report", f"""WITH {ad.HIERARCHY}, u AS (SELECT sel_type, 'face' AS metric, face_d AS v FROM units
      UNION ALL SELECT sel_type, 'body', body_d FROM units)
    SELECT sel_type, metric, {r6("avg(v)")} AS mean, count(*) AS n, true AS inside FROM u GROUP BY ALL""")
def dprime_report(t):
    out = rs.dprime_report(ad.hierarchy(t), N_ITER)
    return out.select("sel_type", "metric", "mean", "n", F.col("mean").between(F.col("ci_low"), F.col("ci_high")).alias("inside"))


SEGMENT = {"face": "FURNITURE", "body": "MACHINERY", "mixed": "BUILDING", "nonselective": "AUTOMOBILE"}


@query("boot_dprime_contrasts", f"""WITH {ad.HIERARCHY}, m AS (SELECT
      {", ".join(f"avg({k}_d) FILTER (sel_type = '{v}') AS {s}_{k}" for s, v in SEGMENT.items() for k in ("face", "body"))} FROM units),
    c AS ({" UNION ALL ".join("SELECT '" + n.replace("'", "''") + f"' AS contrast, {e} AS value FROM m" for n, e in
          {**rs.CONTRASTS, **rs.EXTRA_CONTRASTS, **{f"{s}_{k}": f"{s}_{k}" for s in SEGMENT for k in ("face", "body")}}.items())})
    SELECT contrast, {r6("value")} AS value, true AS p_given FROM c""")
def boot_dprime_contrasts(t):
    renamed = F.coalesce(*[F.when(F.col("sel_type") == v, F.lit(s)) for s, v in SEGMENT.items()], F.lit("other"))
    out = rs.boot_dprime_contrasts(ad.hierarchy(t).withColumn("sel_type", renamed), n_iter=N_ITER)
    return out.select("contrast", "value", F.col("p").between(0, 2).alias("p_given"))
