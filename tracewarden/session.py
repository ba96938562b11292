"""Session settings used by the tests, the bench and the examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "tracewarden", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, RE2-style ANSI off).

    Cluster settings win: only values that the submitter left unset are filled in,
    so shuffle partitions, memory and ``spark.checkpoint.dir`` stay the cluster's own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "false",
        # plain JVM case mapping: the same on ASCII, several times faster on other text
        "spark.sql.icu.caseMappings.enabled": "false",
        "spark.ui.enabled": "false",
    }
    if master and master.startswith("local"):
        defaults["spark.sql.shuffle.partitions"] = str(os.cpu_count() or 8)
        defaults["spark.driver.memory"] = "8g"
        defaults["spark.ui.showConsoleProgress"] = "false"
    defaults.update(conf)
    for key, value in defaults.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; ``fallback`` only where unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or fallback
