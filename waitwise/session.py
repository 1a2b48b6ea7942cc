"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "waitwise", cpus: str | int | None = None,
              shuffle_partitions: int | None = None) -> SparkSession:
    """Local session with the settings every test and the bench use.

    A session that exists already is returned as it is: none of its settings are touched.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = cpus or os.environ.get("BENCH_CPUS") or "*"
    parts = shuffle_partitions or int(os.environ.get("WAITWISE_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("WAITWISE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # report bundles re-run the same plans every cycle: keep their generated code
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


#: Scratch folders of local sessions without a setting, by application.
_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only a local-mode session without one gets a
    fresh scratch folder (tests, bench); a cluster session without the setting is an
    error, because a machine-local folder does not survive the loss of an executor.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder for this cluster")
        # the setting cannot be changed in a running session, so the folder is remembered here
        path = _LOCAL_DIRS.get(context.applicationId) or _LOCAL_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="waitwise-ckpt-"))
    context.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
