"""QUERIES: name to (spark, sf_dir) -> DataFrame. ORACLES: name to DuckDB SQL over the same tables."""

from sparsefold.plans import corpus, ingestion, more, slices, statistics  # noqa: F401  each files its queries
from sparsefold.plans.registry import ORACLES, QUERIES  # noqa: F401
