"""Session settings and the shared folder used for durable intermediate data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "hearsay", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every job here assumes.

    Partition counts are left to adaptive execution: start wide, let it coalesce small
    partitions and split skewed ones from measured sizes.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Where the setting is missing, a folder in the warehouse is used, which all executors share.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
