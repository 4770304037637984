"""comparo — causal comparable-sales pricing analytics on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a
function returning a small result DataFrame) built from the DataFrame /
SQL API, so Catalyst sees one lazy plan per query.
"""

from comparo.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
