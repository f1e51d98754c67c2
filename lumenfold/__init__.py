"""Hybrid retrieval analytics on Spark DataFrames."""

from __future__ import annotations

import os


def reachable(spark) -> None:
    """Lets Python workers import this package from where the driver has it. A cluster has it installed; a session that was
    started from another folder of the same machine may not have it on its path."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
