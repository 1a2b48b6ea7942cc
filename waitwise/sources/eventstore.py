"""A partitioned event store whose batches are published by a manifest.

    <root>/data/batch=<id>/attempt=<uuid>/day=<date>/part-*.parquet
    <root>/manifest/m-<id>-<version>/part-*.parquet      one row per imported source file

A batch writes its rows into a folder of its own attempt, then its manifest beside the others under a hidden
name, and renames that into place: one rename publishes it, and a reader sees the batch whole or not at all. Folders
that no manifest names (of a batch that died) are never read. A batch that is imported again writes a new attempt
and a higher version, which replaces its earlier one. The high-water mark of an import is the newest event of
all other batches.

All reading and writing goes through Spark and its file system layer, so the store can lie wherever Spark can write.
The driver holds one row per batch and the names of imported files, as a scan of them would.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "batch_id long, version long, path string, n_rows long, first_ts timestamp_ntz, hwm timestamp_ntz, file string"
EPOCH = "1970-01-01 00:00:00"


@dataclass(frozen=True)
class Published:
    """What an import left: the rows it added, and the mark that later imports start from."""

    batch_id: int
    version: int
    path: str
    n_rows: int


class EventStore:
    """Events of one schema (``schema`` has the timestamp column ``ts``) under ``root``."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, ts: str = "curr_timestamp"):
        self._spark, self._root, self._schema, self._ts = spark, root.rstrip("/"), schema, ts
        path = spark._jvm.org.apache.hadoop.fs.Path(self._root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._spark._jvm.org.apache.hadoop.fs.Path("/".join([self._root, *parts]))

    def manifest(self) -> DataFrame:
        """The newest manifest of each batch, one row per imported file (``file`` is null if there was none)."""
        if not self._fs.exists(self._path("manifest")):
            return self._spark.createDataFrame([], MANIFEST)
        rows = self._spark.read.schema(MANIFEST).parquet(f"{self._root}/manifest/*")
        newest = F.max("version").over(Window.partitionBy("batch_id"))
        return rows.withColumn("_newest", newest).filter(F.col("version") == F.col("_newest")).drop("_newest")

    def mark(self, but: int | None = None) -> Column:
        """The newest stored timestamp (of all batches but one), 1970 in an empty store."""
        rows = self.manifest()
        if but is not None:
            rows = rows.filter(F.col("batch_id") != but)
        newest = rows.agg(F.max("hwm").alias("m")).first()["m"]
        return F.lit(str(newest) if newest is not None else EPOCH).cast("timestamp_ntz")

    def imported_files(self, but: int | None = None) -> list[str]:
        """Names of the source files that published batches have read."""
        rows = self.manifest().filter(F.col("file").isNotNull())
        if but is not None:
            rows = rows.filter(F.col("batch_id") != but)
        return sorted(r["file"] for r in rows.select("file").distinct().collect())

    def read(self) -> DataFrame:
        """All published events, with their ``day`` (a partition column: filters on it prune folders)."""
        paths = [r["path"] for r in self.manifest().select("path").distinct().collect()]
        cols = [*self._schema.fieldNames(), "day"]
        if not paths:
            return self._spark.createDataFrame([], self._schema).withColumn("day", F.lit(None).cast("date")).select(*cols)
        read = self._spark.read.option("basePath", f"{self._root}/data").schema(StructType(self._schema.fields).add("day", "date"))
        return read.parquet(*paths).select(*cols)

    def import_batch(self, batch_id: int, events: DataFrame, files: Sequence[str] = ()) -> Published:
        """Store the events later than every other batch's newest one, as batch ``batch_id``.

        Importing the same batch again replaces what it stored.
        """
        new = events.filter(F.col(self._ts) > self.mark(but=batch_id)).select(*self._schema.fieldNames())
        path = f"{self._root}/data/batch={batch_id}/attempt={uuid.uuid4().hex}"
        # a day's rows side by side in few files; a day that holds most rows is split
        new.withColumn("day", F.to_date(self._ts)).hint("rebalance", "day").write.partitionBy("day").parquet(path)
        return self._publish(batch_id, path, files)

    def _publish(self, batch_id: int, path: str, files: Sequence[str]) -> Published:
        # statistics of what was written, not of what was meant to be
        written = self._spark.read.schema(self._schema).parquet(path)
        got = written.agg(F.count(F.lit(1)).alias("n"), F.min(self._ts).alias("lo"), F.max(self._ts).alias("hi")).first()
        version = (self.manifest().filter(F.col("batch_id") == batch_id).agg(F.max("version").alias("v")).first()["v"] or 0) + 1
        rows = [(batch_id, version, path, got["n"], got["lo"], got["hi"], f) for f in (files or [None])]
        hidden = f"_pending-{uuid.uuid4().hex}"
        self._spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{self._root}/{hidden}")
        self._fs.mkdirs(self._path("manifest"))
        if not self._fs.rename(self._path(hidden), self._path("manifest", f"m-{batch_id}-{version}")):
            raise RuntimeError(f"manifest of batch {batch_id} could not be published")
        return Published(batch_id, version, path, got["n"])
