"""Query catalogue: each registered query is (spark, sf_dir) -> DataFrame plus a DuckDB twin."""

from comparo.plans.registry import all_queries, all_oracles  # noqa: F401
