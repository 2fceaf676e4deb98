"""Named queries over the driver's tables."""

from unimass.plans import (  # noqa: F401
    cohort_queries, model_queries, resample_queries, roi_queries, unit_queries)
from unimass.plans.registry import ORACLES, QUERIES  # noqa: F401
