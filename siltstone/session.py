"""A session with the settings that the engine assumes. On a cluster, settings given by the launcher win."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "siltstone", cpus: int | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("SILTSTONE_DRIVER_MEMORY", "8g"))
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if cpus and "spark.checkpoint.dir" not in extra:
        conf["spark.checkpoint.dir"] = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=conf | extra).getOrCreate()
