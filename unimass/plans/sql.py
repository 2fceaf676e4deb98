"""SQL pieces shared by the oracles: closed forms of what the operators compute."""

from unimass.plans.adapters import ACTS, CATEGORIES
from unimass.plans.registry import r6

MOMENTS = """moments AS (
  SELECT model, layer, unit_id, category, count(*) AS n, avg(act) AS mean, var_samp(act) AS var
  FROM acts GROUP BY ALL)"""


def beta_series(a: str, b: str, x: str, terms: int = 400) -> str:
    """I_x(a, b) as its power series, for x below the mean of the distribution."""
    lead = (f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) + lgamma({a} + {b})"
            f" - lgamma({a}) - lgamma({b}))")
    term = (f"exp(lgamma({a} + 1) + lgamma({a} + {b} + k + 1) - lgamma({a} + {b})"
            f" - lgamma({a} + k + 2) + (k + 1) * ln({x}))")
    return f"({lead} * (1 + list_sum(list_transform(range(0, {terms}), lambda k: {term}))))"


def t_sf(t: str, df: str, most: str | None = None) -> str:
    """P(T > t) for any t, from whichever of the two series converges fast.

    The second series is taken up to the square `most`; its own choice keeps more digits of small
    tails, df keeps the first series short where df is large.
    """
    sq = f"({t} * {t})"
    far = beta_series(f"({df} / 2)", "0.5", f"({df} / ({df} + {sq}))")
    near = beta_series("0.5", f"({df} / 2)", f"({sq} / ({df} + {sq}))")
    two = f"(CASE WHEN {t} = 0 THEN 1.0 WHEN {sq} > {most or f"3 * {df} / ({df} + 2)"} THEN {far} ELSE 1 - {near} END)"
    return f"(CASE WHEN {t} >= 0 THEN {two} / 2 ELSE 1 - {two} / 2 END)"


def t_crit(source: str) -> str:
    """crit(df, crit): two-sided 5 % points for every df of a relation, by bisection (needs WITH RECURSIVE)."""
    middle = "((lo + hi) / 2)"
    return f"""bisect(df, lo, hi, i) AS (SELECT DISTINCT df::DOUBLE, 0.0::DOUBLE, 1000.0::DOUBLE, 0 FROM {source} WHERE df > 0
    UNION ALL SELECT df, CASE WHEN sf > 0.025 THEN mid ELSE lo END, CASE WHEN sf > 0.025 THEN hi ELSE mid END, i + 1
    FROM (SELECT df, lo, hi, i, {middle} AS mid, {t_sf(middle, "df", "df")} AS sf FROM bisect WHERE i < 50)),
  crit AS (SELECT df, (lo + hi) / 2 AS crit FROM bisect WHERE i = 50)"""


def t_test(source: str, keys: str) -> str:
    """tested(keys, n, mean, t, df, d, p, ci_low, ci_high) of the diffs of a relation (needs WITH RECURSIVE)."""
    return f"""stat AS (SELECT {keys}, count(*) AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, (count(*) - 1)::DOUBLE AS df
      FROM {source} GROUP BY ALL), {t_crit("stat")},
  sized AS (SELECT *, mean / sd * sqrt(n) AS t, mean / sd AS d, sd / sqrt(n) AS se FROM stat JOIN crit USING (df)),
  tested AS (SELECT {keys}, n, mean, t, df, d, 2 * {t_sf("abs(t)", "df")} AS p, mean - crit * se AS ci_low,
    mean + crit * se AS ci_high FROM sized)"""


def normal_sf(z: str, terms: int = 120) -> str:
    """P(Z > z) from the positive series of the normal distribution function."""
    term = f"exp((2 * k + 1) * ln(abs({z})) - k * ln(2.0) - lgamma(k + 1.5) + lgamma(0.5) - ln(2.0))"
    half = (f"(exp(-{z} * {z} / 2) / sqrt(2 * pi()) * "
            f"list_sum(list_transform(range(0, {terms}), lambda k: {term})))")
    return (f"(CASE WHEN {z} = 0 THEN 0.5 WHEN {z} > 8 THEN 0.0 WHEN {z} < -8 THEN 1.0 "
            f"WHEN {z} > 0 THEN 0.5 - {half} ELSE 0.5 + {half} END)")


def step_up(source: str, family: str, keep: str, p: str = "p", method: str = "bh",
            out: str = "p_adj") -> str:
    """Adjusted p within `family` (missing p left out) as a SELECT over `source`."""
    part = f"PARTITION BY {family}" if family else ""
    factor = "m" if method == "bh" else "m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i))"
    return f"""SELECT {keep}, CASE WHEN {p} IS NOT NULL THEN least(1.0, min({p} * ({factor}) / rk)
      OVER ({part} ORDER BY {p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS {out}
    FROM (SELECT *, count({p}) OVER ({part}) AS m,
                 row_number() OVER ({part} ORDER BY {p} NULLS LAST) AS rk FROM {source})"""


def dprime_cte(targets: dict, baseline: str | None = None, source: str = "acts") -> str:
    """dvals(model, layer, unit_id, sel_type, dval) straight from the responses."""
    one = lambda name, cats: f"""SELECT model, layer, unit_id, '{name}' AS sel_type,
        (avg(act) FILTER (inside) - avg(act) FILTER (outside)) / sqrt(
          (coalesce(var_samp(act) FILTER (inside), 0) * (count(*) FILTER (inside) - 1)
           + coalesce(var_samp(act) FILTER (outside), 0) * (count(*) FILTER (outside) - 1))
          / greatest(count(*) FILTER (inside) + count(*) FILTER (outside) - 2, 1) + 1e-10) AS dval
      FROM (SELECT *, category IN ({", ".join(f"'{c}'" for c in cats)}) AS inside,
            {f"category = '{baseline}'" if baseline else
             "category NOT IN (" + ", ".join(f"'{c}'" for c in cats) + ")"} AS outside
            FROM {source}) GROUP BY model, layer, unit_id"""
    return "dvals AS (" + " UNION ALL ".join(one(k, v) for k, v in targets.items()) + ")"


def welch_cte(pairs, method: str = "by") -> str:
    """tests(model, layer, unit_id, a, b, t, df, p, p_adj) for the pairs."""
    listed = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    return f"""pairs(a, b) AS (VALUES {listed}),
  sided AS (
    SELECT x.model, x.layer, x.unit_id, a, b, x.var > 1e-10 AND y.var > 1e-10 AS valid,
      (x.mean - y.mean) / sqrt(x.var / x.n + y.var / y.n) AS t0,
      pow(x.var / x.n + y.var / y.n, 2) / (pow(x.var / x.n, 2) / (x.n - 1)
        + pow(y.var / y.n, 2) / (y.n - 1)) AS df0
    FROM pairs JOIN moments x ON x.category = a
    JOIN moments y ON y.category = b AND (y.model, y.layer, y.unit_id) = (x.model, x.layer, x.unit_id)),
  raw_tests AS (
    SELECT model, layer, unit_id, a, b, CASE WHEN valid THEN t0 ELSE 0 END AS t,
      CASE WHEN valid THEN df0 END AS df,
      CASE WHEN valid THEN {t_sf("t0", "df0")} ELSE 1 END AS p FROM sided),
  tests AS ({step_up("raw_tests", "model, layer, a, b", "*", "p", method)})"""
