"""A session with the settings that the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "chronopix", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, Arrow, one BLAS thread per Python worker. partitions sets the shuffle's."""
    for key in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(key, "1")
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.showConsoleProgress": "false",
        "spark.executorEnv.OMP_NUM_THREADS": "1", "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
    }
    if partitions:
        base["spark.sql.shuffle.partitions"] = str(partitions)
    return b.config(map=base | conf).getOrCreate()
