"""Selectivity rules over corrected tests: units of a network and voxels of a localizer."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unimass.functions import special as sp
from unimass.operators.inference import fdr_adjust, welch_onesided
from unimass.operators.moments import UNIT, dprime, unit_profiles
from unimass.session import materialize


@dataclass(frozen=True)
class UnitSpec:
    """Which categories are tested, and how strictly."""

    categories: tuple
    single: tuple = ()
    mixed: tuple = ()
    solo: tuple = ()
    baseline: str = "object"
    scrambled: str = "scrambled"
    method: str = "by"
    alpha_pos: float = 0.001
    alpha_neg: float = 0.05
    singles: tuple = field(init=False)
    pairs: tuple = field(init=False)

    def __post_init__(self):
        singles = tuple(self.single) or tuple(c for c in self.categories if c != self.baseline)
        pairs = tuple(self.mixed) or tuple(combinations(singles, 2))
        object.__setattr__(self, "singles", singles)
        object.__setattr__(self, "pairs", pairs)
        # every category that a role names, by role
        roles = {"baseline": {self.baseline}, "scrambled": {self.scrambled}, "single": set(singles),
                 "solo": set(self.solo), "mixed": {c for pair in pairs for c in pair}}
        wrong = {role: sorted(named - set(self.categories)) for role, named in roles.items()}
        wrong["solo and another role"] = sorted(
            roles["solo"] & (roles["single"] | roles["baseline"] | roles["scrambled"]))
        wrong["not two categories"] = [pair for pair in pairs if len(pair) != 2]
        wrong = {role: named for role, named in wrong.items() if named}
        if wrong:
            raise ValueError(f"categories that do not fit their roles: {wrong}")

    def mixed_name(self, pair) -> str:
        return "mixed" if len(self.pairs) == 1 else "&".join(pair)

    def rival(self, target):
        """The other single category, tested only when there are exactly two."""
        if target in self.singles and len(self.singles) == 2:
            return self.singles[1 - self.singles.index(target)]
        return None

    def rules(self) -> dict:
        """Type -> (pairs that must be significant, pairs that must not)."""
        out = {}
        for t in (*self.singles, *self.solo):
            above = [(t, self.baseline), (t, self.scrambled)]
            if self.rival(t):
                above.append((t, self.rival(t)))
            out[t] = (above, self._others({t}))
        for pair in self.pairs:
            above = [(c, ref) for c in pair for ref in (self.baseline, self.scrambled)]
            out[self.mixed_name(pair)] = (above, self._others(set(pair)))
        return out

    def _others(self, own):
        skip = own | {self.baseline, self.scrambled}
        return [(c, self.baseline) for c in self.categories if c not in skip]

    def targets(self) -> dict:
        """Type -> categories whose d' against the rest describes it."""
        out = {t: [t] for t in (*self.singles, *self.solo)}
        out.update({self.mixed_name(p): list(p) for p in self.pairs})
        return out


def _passes(spec: UnitSpec, above, below):
    """One aggregate per rule: every required test significant, no other one."""
    is_pair = lambda pair: (F.col("a") == pair[0]) & (F.col("b") == pair[1])
    hits = [F.bool_or(is_pair(p) & (F.col("p_adj") <= spec.alpha_pos) & (F.col("t") > 0))
            for p in above]
    clear = [F.bool_or(is_pair(p) & (F.col("p_adj") >= spec.alpha_neg)) for p in below]
    return reduce(lambda x, y: x & y, hits + clear)


def needed_pairs(rules: dict) -> list:
    return sorted({p for above, below in rules.values() for p in (*above, *below)})


def apply_rules(tests: DataFrame, spec: UnitSpec, rules: dict | None = None, keys=UNIT):
    """Long (unit, sel_type, selected) from the corrected tests of all needed pairs.

    An adjusted p does not depend on the level it is compared with, so that each pair is
    tested once for the positive and the negative criteria of every rule.
    """
    rules = spec.rules() if rules is None else rules
    flags = tests.groupBy(*keys).agg(*[
        _passes(spec, above, below).alias(f"is_{i}")
        for i, (above, below) in enumerate(rules.values())])
    pairs = F.explode(F.array(*[
        F.struct(F.lit(name).alias("sel_type"),
                 F.coalesce(F.col(f"is_{i}"), F.lit(False)).alias("selected"))
        for i, name in enumerate(rules)]))
    return flags.select(*keys, pairs.alias("r")).select(*keys, "r.sel_type", "r.selected")


def select_pure(tests: DataFrame, spec: UnitSpec, target: str, keys=UNIT) -> DataFrame:
    """Units selective for one category alone."""
    rule = spec.rules()[target]
    return apply_rules(tests, spec, {target: rule}, keys).filter("selected").drop("selected")


def select_mixed(tests: DataFrame, spec: UnitSpec, pair: tuple, keys=UNIT) -> DataFrame:
    """Units selective for both categories of a pair."""
    name = spec.mixed_name(pair)
    return apply_rules(tests, spec, {name: spec.rules()[name]}, keys).filter("selected").drop(
        "selected")


def select_units(moments: DataFrame, spec: UnitSpec, keys=UNIT) -> DataFrame:
    """All rules at once: (unit, sel_type, dval, selected)."""
    profiles = unit_profiles(materialize(moments, "moments"), keys)
    tests = welch_onesided(profiles, needed_pairs(spec.rules()), spec.method, spec.alpha_pos, keys)
    return apply_rules(tests, spec, keys=keys).join(
        dprime(profiles, spec.targets(), keys=keys), [*keys, "sel_type"])


def exclusivity_check(selected: DataFrame, keys=UNIT) -> DataFrame:
    """Pairs of types that share units within a layer, with their overlap; empty if exclusive."""
    group = [k for k in keys if k != "unit_id"]
    per_unit = selected.filter("selected").groupBy(*keys).agg(
        F.array_sort(F.collect_set("sel_type")).alias("types")).filter(F.size("types") > 1)
    pairs = F.explode(F.flatten(F.transform("types", lambda a: F.transform(
        F.filter("types", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    return per_unit.select(*keys, pairs.alias("p")).groupBy(
        *group, F.col("p.a").alias("type_a"), F.col("p.b").alias("type_b")
    ).agg(F.count("*").alias("n_overlap"))


def selective_counts(selected: DataFrame, keys=("model", "layer"), of="sel_type") -> DataFrame:
    """Per layer and type: selective units, all units and their percentage."""
    return selected.groupBy(*keys, of).agg(
        F.count_if("selected").alias("n_selective"), F.count("*").alias("n_units"),
        (100.0 * F.count_if("selected") / F.count("*")).alias("percent"))


# Contrasts of the voxel localizer and the label each domain goes by.
FACE, BODY, FACE_BODY, BODY_FACE = "face>object", "body>object", "face>body", "body>face"
VISUAL = "visual>baseline"


# The contrast that must be quiet for a domain to count as not responding.
QUIET = {"faces": FACE, "bodies": BODY, "places": "place>object", "characters": "character>object"}

# Each label as terms (contrast, whether it is significant); quiet domains are added to the first three.
LABEL_TERMS = {
    "face": ((FACE, True), (FACE_BODY, True), (BODY, False)),
    "body": ((BODY, True), (BODY_FACE, True), (FACE, False)),
    "mixed": ((FACE, True), (BODY, True)),
    "non": ((FACE, None), (BODY, None)),
    "responsive": ((VISUAL, True),),
}


def contrast_pvalues(maps: DataFrame, mask: DataFrame, method: str | None = "bh") -> DataFrame:
    """One-sided p of z per contrast, corrected inside the mask; outside it p = 1.

    `maps` is (subject, voxel_id, contrast, z); the reverse of face>body is added.
    """
    z = maps.select("subject", "voxel_id", "contrast", "z")
    flip = F.explode(F.when(
        F.col("contrast") == FACE_BODY,
        F.array(F.struct(F.lit(FACE_BODY).alias("contrast"), F.col("z").alias("z")),
                F.struct(F.lit(BODY_FACE).alias("contrast"), (-F.col("z")).alias("z")))
    ).otherwise(F.array(F.struct("contrast", "z"))))
    z = z.select("subject", "voxel_id", flip.alias("c")).select("subject", "voxel_id", "c.*")
    flagged = z.join(
        mask.select("subject", "voxel_id").distinct().withColumn("in_mask", F.lit(True)),
        ["subject", "voxel_id"], "left")
    raw = flagged.withColumn("in_mask", F.coalesce("in_mask", F.lit(False))).withColumn(
        "_inside", sp.normal_sf(F.when(F.col("in_mask"), F.col("z"))))
    if method is None:
        corrected = raw.withColumn("_adj", F.col("_inside"))
    else:
        corrected = fdr_adjust(raw, ["subject", "contrast"], "_inside", method, "_adj", "voxel_id")
    return corrected.select(
        "subject", "voxel_id", "contrast", "in_mask",
        F.coalesce("_inside", F.lit(1.0)).alias("p_raw"),
        F.coalesce("_adj", F.lit(1.0)).alias("p"))


def localize_voxels(pvalues: DataFrame, p_pos: float = 0.05, p_neg: float = 0.05,
                    neg_domains=("places",)) -> DataFrame:
    """face, body, mixed, non, other and responsive labels of the voxels in the mask."""
    silent = tuple((QUIET[d], False) for d in neg_domains)
    terms = {name: own + (silent if name in ("face", "body", "mixed") else ())
             for name, own in LABEL_TERMS.items()}
    # conditional aggregates rather than a pivot: the names are known beforehand
    names = sorted({contrast for own in terms.values() for contrast, _ in own})
    wide = pvalues.filter("in_mask").groupBy("subject", "voxel_id").agg(
        *[F.max(F.when(F.col("contrast") == n, F.col("p"))).alias(f"p{i}")
          for i, n in enumerate(names)])

    def holds(contrast, significant):
        """Significant, clearly not (by p_neg), or merely not significant (None)."""
        p = F.col(f"p{names.index(contrast)}")
        return p < p_pos if significant else p >= (p_neg if significant is False else p_pos)

    flags = {name: reduce(lambda a, b: a & b, [holds(*term) for term in own])
             for name, own in terms.items()}
    flags["responsive"] = F.coalesce(flags["responsive"], F.lit(False))
    out = wide.select("subject", "voxel_id", *[flag.alias(name) for name, flag in flags.items()])
    return out.withColumn("other", ~reduce(
        lambda a, b: a | b, [F.col(name) for name in ("face", "body", "mixed", "non")]))


def raw_cutoffs(pvalues: DataFrame, p_pos: float = 0.05) -> DataFrame:
    """Largest raw p that still passes, for the two localizer contrasts (0 if none does)."""
    return pvalues.filter(F.col("contrast").isin(FACE, BODY)).groupBy("subject", "contrast").agg(
        F.coalesce(F.max(F.when(F.col("p") < p_pos, F.col("p_raw"))), F.lit(0.0)).alias("cutoff"))


LABELS = ("face", "body", "mixed", "non", "other", "responsive")


def label_counts(voxels: DataFrame, keys=("subject",)) -> DataFrame:
    """Number of voxels per label and in the mask."""
    return voxels.groupBy(*keys).agg(
        *[F.count_if(c).alias(f"n_{c}") for c in LABELS], F.count("*").alias("n_total"))


def fmri_totals(voxels: DataFrame) -> DataFrame:
    """Selective voxels over all subjects."""
    return voxels.agg(F.countDistinct("subject").alias("n_subjects"),
                      *[F.count_if(c).alias(c) for c in ("face", "body", "mixed")])
