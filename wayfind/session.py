"""Session settings shared by the batch jobs, the bench and the tests."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime settings the plans rely on.  They are all dynamic, so they can be
#: applied to a session the caller already owns.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "wayfind", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; everything can be overridden through ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def is_local(master: str) -> bool:
    """Whether driver and executors are one process (``local-cluster`` is not)."""
    return master == "local" or master.startswith("local[")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` wins.  Where it is unset, only a local master gets
    a temporary folder, because there is one machine then; on a cluster the files
    would lie on the disks of single executors, so that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured and not is_local(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = configured or tempfile.mkdtemp(prefix="wayfind-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives lost executors), used between rounds of iterative jobs."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
