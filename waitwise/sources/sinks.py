"""Sinks and retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwise.session import cut_lineage


def retain_recent(df: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Rows no older than ``days`` before the newest row (a scalar subquery, so the
    filter is a plain predicate; on a table partitioned by date it prunes partitions)."""
    newest = df.select(F.max(ts)).scalar()
    return df.filter(F.col(ts) >= newest - F.expr(f"INTERVAL {days} DAYS"))


def write_by_day(df: DataFrame, path: str, ts: str = "ts", day: str = "day") -> None:
    """Write rows into a table of one folder a day; days that ``df`` holds are replaced, others stay
    (dynamic partition mode). A day that holds most rows is written by several tasks."""
    (df.withColumn(day, F.to_date(ts)).hint("rebalance", day).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path))


@dataclass(frozen=True)
class Retained:
    """What a retention run did: the days it dropped whole and the day it rewrote, if any."""

    dropped: tuple[dt.date, ...]
    rewritten: dt.date | None


def retain_table(spark: SparkSession, path: str, days: int, ts: str = "ts", day: str = "day") -> Retained:
    """A14 on a stored table (``write_by_day``): rows no older than ``days`` before the newest row stay.

    Only folder names and the newest day are read to find the edge. Older days go as folders, the edge day
    is the only one whose rows are read and rewritten, later days are not touched. A run that dies half way
    is finished by the next one.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    prefix = f"{day}="
    found = {dt.date.fromisoformat(s.getPath().getName()[len(prefix):]): s.getPath()
             for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith(prefix)
             and not s.getPath().getName().endswith("__HIVE_DEFAULT_PARTITION__")}
    if not found:
        return Retained((), None)

    def rows(of: dt.date) -> DataFrame:
        return spark.read.option("basePath", path).parquet(found[of].toString())
    newest = rows(max(found)).agg(F.max(ts).alias("m")).first()["m"]
    edge = newest - dt.timedelta(days=days)
    gone = tuple(sorted(d for d in found if d < edge.date()))
    for d in gone:
        fs.delete(found[d], True)
    if edge.date() not in found:
        return Retained(gone, None)
    cut = F.lit(str(edge)).cast("timestamp_ntz")
    old = rows(edge.date())
    if old.filter(F.col(ts) < cut).isEmpty():
        return Retained(gone, None)
    kept = cut_lineage(old.filter(F.col(ts) >= cut))   # read in full before its folder is replaced
    if kept.isEmpty():
        fs.delete(found[edge.date()], True)
    else:
        write_by_day(kept.drop(day), path, ts, day)
    return Retained(gone, edge.date())


def write_report(df: DataFrame, path: str, report: str, interval: str, fmt: str = "csv",
                 partition_cols: Sequence[str] = (), only_partitions: bool = False) -> None:
    """Write one report (spreadsheet-friendly CSV with header, or parquet) to
    ``path/report=<report>/interval=<interval>/`` (Hive-style folders, so reading ``path``
    discovers both as columns). Re-running a report replaces its folder, which keeps
    retries idempotent; an empty report still gets its folder. Extra partition columns
    (e.g. ``device``) give one file set per device from a single job, not a loop; with
    ``only_partitions`` just the partitions that ``df`` holds are replaced."""
    target = f"{path.rstrip('/')}/report={report}/interval={interval}"
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
        if only_partitions:
            w = w.option("partitionOverwriteMode", "dynamic")
    if fmt == "csv":
        w.option("header", True).csv(target)
    else:
        w.format(fmt).save(target)


def settings_snapshot_filter(settings: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Settings rows not pending a restart and not in the exclude list."""
    return settings.filter(~F.col("pending_restart") & ~F.col("name").isin(list(exclude))).select(
        "host", "name", "setting")


def kernel_params_unpivot(df: DataFrame, id_cols: Sequence[str] = ("test_id", "pass_counter")) -> DataFrame:
    """P10: one row per (test, vm.* parameter)."""
    params = [c for c in df.columns if c.startswith("vm_")]
    return df.unpivot(list(id_cols), params, "name", "value")
