"""OS collector text sources: vmstat, iostat and dirty-page logs.

Each reader takes lines (file, chunk, pos, line) as the splits of a text source give them. vmstat and dirty-page
samples are one line each: a projection. iostat reports are several lines: the segmented scan of
``waitwise.sources.segments`` puts them together, and the report time and block number are carried from chunk
to chunk, so no task holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waitwise.sources import segments
from waitwise.sources.bindings import table
from waitwise.sources.serverlog import read_log_lines

# Vmstat -S M -t column order (optional "gu" column on newer procps).
VMSTAT_COLS = ["r", "b", "swpd", "free", "buff", "cache", "si", "so", "bi", "bo", "in", "cs", "us", "sy", "id",
               "wa", "st"]
DIRTY_COLS = ["dirty_kb", "dirty_pct", "dirty_bg_pct", "avail_mb"]


# Iostat -x -t line forms (report time, section header, CPU section).
IO_TS, IO_HEADER, IO_CPU = r"^\s*\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", r"^\s*Device", r"^\s*avg-cpu"


def _tokens(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def parse_vmstat(lines: DataFrame) -> DataFrame:
    """A1: data lines of ``vmstat -t`` with the 4 dirty-page medians appended.

    Whitespace is squeezed, header lines (not starting with a digit) dropped and the
    fields cast by position; a trailing ``gu`` column is recognised by the field count.
    """
    t = lines.filter(F.col("line").rlike(r"^\s*\d")).select(_tokens(F.col("line")).alias("t"))
    n = F.size("t")
    gu = (n == F.lit(len(VMSTAT_COLS) + 7)).cast("int")  # 17 + gu + date + time + 4
    date_i = F.lit(len(VMSTAT_COLS)) + gu
    ts = F.to_timestamp_ntz(F.concat_ws(" ", F.get("t", date_i), F.get("t", date_i + 1)))
    cols = [F.get("t", F.lit(i)).cast("bigint").alias(c) for i, c in enumerate(VMSTAT_COLS)]
    dirty = [F.get("t", date_i + 2 + i).cast("double").alias(c) for i, c in enumerate(DIRTY_COLS)]
    return t.select(ts.alias("ts"), *cols, *dirty)


def read_vmstat(spark: SparkSession, path: str) -> DataFrame:
    """A1 from text files."""
    return parse_vmstat(spark.read.text(path).withColumnRenamed("value", "line"))


def parse_iostat(lines: DataFrame, latest_only: bool = False) -> DataFrame:
    """A2: ``iostat -x -t`` device blocks → (file, block, ts, device, metrics map by header name).

    A block is a ``Device`` header line and the rows after it up to a blank line; ``block`` numbers
    the blocks of a file from 1. Columns are taken by the names of each block's own header, so versions
    may differ within a file. ``ts`` is that of the latest report time line before the block (NULL if
    there is none). Every block is kept; ``latest_only=True`` keeps the last block of each file.
    ``pos`` is a struct of the chunk ``c`` and the place ``r`` in it.
    """
    v = F.col("line")
    recs = segments.records(lines, v.rlike(IO_TS) | v.rlike(IO_HEADER))
    time = F.to_timestamp_ntz(F.substring(F.trim(F.split("record", "\n")[0]), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    is_block = F.col("record").rlike(IO_HEADER)
    r = recs.select("file", F.col("rec_pos.c").alias("_c"), "rec_pos", F.when(~is_block, time).alias("_ts"), is_block.cast("int").alias("_is"),
                    F.when(is_block, F.col("record")).alias("record"))
    inside = Window.partitionBy("file", "_c").orderBy("rec_pos").rowsBetween(Window.unboundedPreceding, 0)
    here = r.select("*", F.last("_ts", ignorenulls=True).over(inside).alias("_here"), F.sum("_is").over(inside).alias("_no")).filter("_is = 1")
    # one row a chunk: its last report time and its number of blocks, carried to the chunks after it
    per = r.groupBy("file", "_c").agg(F.max_by("_ts", F.when(F.col("_ts").isNotNull(), F.col("rec_pos"))).alias("_t"), F.sum("_is").alias("_n"))
    before = Window.partitionBy("file").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select("file", "_c", F.last("_t", ignorenulls=True).over(before).alias("_carried"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    blocks = here.join(carry, ["file", "_c"]).select(
        "file", (F.col("_base") + F.col("_no")).alias("block"), F.coalesce("_here", "_carried").alias("ts"), F.split("record", "\n").alias("_lines"))
    body = F.slice("_lines", F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(0)))
    ends = F.array_position(F.transform(body, lambda x: x.rlike(r"^\s*$") | x.rlike(IO_CPU)), F.lit(True))
    rows = F.when(ends > 0, F.slice(body, F.lit(1), (ends - 1).cast("int"))).otherwise(body)
    named = blocks.select("file", "block", "ts", _tokens(F.col("_lines")[0]).alias("_names"), F.explode(rows).alias("_row"))
    vals = named.select("file", "block", "ts", "_names", _tokens(F.col("_row")).alias("_vals"))
    n = F.least(F.size("_names"), F.size("_vals")) - 1            # a short row has the first columns only
    out = vals.select("file", "block", "ts", F.get("_vals", F.lit(0)).alias("device"), F.map_from_arrays(
        F.slice("_names", F.lit(2), n), F.transform(F.slice("_vals", F.lit(2), n), lambda x: x.try_cast("double"))).alias("metrics"))
    if latest_only:
        last = out.groupBy("file").agg(F.max("block").alias("block"))
        out = out.join(last, ["file", "block"], "left_semi")
    return out


def read_iostat(spark: SparkSession, path: str, latest_only: bool = False) -> DataFrame:
    """A2 from text files."""
    return parse_iostat(read_log_lines(spark, path), latest_only)


def parse_dirty_samples(lines: DataFrame) -> DataFrame:
    """A3: ``dd-MM-yyyy HH:mm:ss | kb | pct | bg_pct | avail_mb`` lines; others are dropped."""
    t = lines.select(F.split("line", r"\|").alias("p")).filter(F.size("p") == 5)
    ts = F.try_to_timestamp(F.trim(F.get("p", F.lit(0))), F.lit("dd-MM-yyyy HH:mm:ss")).cast("timestamp_ntz")
    return t.select(ts.alias("ts"), *[F.trim(F.get("p", F.lit(i + 1))).cast("bigint").alias(c)
                                      for i, c in enumerate(DIRTY_COLS)]).filter(F.col("ts").isNotNull())


def read_dirty_samples(spark: SparkSession, path: str) -> DataFrame:
    """A3 from text files."""
    return parse_dirty_samples(spark.read.text(path).withColumnRenamed("value", "line"))


# ---------------------------------------------------------------- fixtures: collector lines from events
def _rendered(spark: SparkSession, sf_dir: str, name: str, lines: list[Column]) -> DataFrame:
    """(file, chunk, pos, line): the lines of each event (NULL: none), one file per day, in the order of events."""
    ev = table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.file_block_start").cast("string")).alias("chunk"),
        "event_id", "ts", "user_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    out = ev.select("chunk", "ts", "event_id", F.posexplode(F.array(*lines)).alias("k", "line")).filter(F.col("line").isNotNull())
    no = F.col("event_id") * len(lines) + F.col("k")
    return out.select(F.concat(F.lit(f"{name}-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".log")).alias("file"), "chunk",
                      F.struct(F.floor(no / 65536).alias("c"), no.alias("r")).alias("pos"), "line")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def vmstat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vmstat line per event, headers before every fifth; files of odd days have a ``gu`` column."""
    u, e, c = F.col("user_id"), F.col("event_id"), F.col("cents")
    values = [u % 7, u % 3, F.lit(0), e % 50000, u, e % 9999, u % 2, u % 4, F.expr("cents div 100"), c % 100, u * 10, e % 100000,
              u % 60, u % 30, 100 - u % 60 - u % 30, u % 5, F.lit(0)]
    data = F.concat(F.concat_ws("  ", *[v.cast("string") for v in values]),
                    F.when(F.dayofmonth("ts") % 2 == 1, F.lit("  0")).otherwise(F.lit("")),
                    F.lit(" "), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), _text(" ", c, ".25 ", u % 100, ".50 ", u % 50, ".00 ", e % 16000, ".75"))
    header = F.when(e % 5 == 0, F.lit("procs -----------memory---------- ---swap-- -----io---- -system-- ------cpu-----"))
    names = F.when(e % 5 == 0, F.lit(" r  b   swpd   free   buff  cache   si   so    bi    bo   in   cs us sy id wa st"))
    return _rendered(spark, sf_dir, "vmstat", [header, names, F.concat(F.lit(" "), data)])


def iostat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One iostat report per event: two devices; the columns and their order depend on the version (user_id % 2)."""
    u, e, c = F.col("user_id"), F.col("event_id"), F.col("cents")
    new = u % 2 == 0
    header = F.when(new, F.lit("Device            r/s     w/s     rkB/s   %util")).otherwise(F.lit("Device:  %util   w/s r/s"))

    def row(k: int) -> Column:
        return F.when(new, _text(f"dev{k}    ", e % 500 + k, ".50   ", u % 90, ".00  ", c, ".25 ", u % 100, ".00")).otherwise(
            _text(f"dev{k}  ", u % 100, ".00 ", u % 90, ".00  ", e % 500 + k, ".50"))
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("+0000"))
    return _rendered(spark, sf_dir, "iostat", [
        stamp, F.lit("avg-cpu:  %user   %nice %system %iowait  %steal   %idle"), F.lit("           1.00    0.00    0.50    0.10    0.00   98.40"),
        F.lit(""), header, row(0), row(1), F.lit("")])


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty-page line per event, after every tenth a line that is none."""
    u, e, c = F.col("user_id"), F.col("event_id"), F.col("cents")
    data = F.concat(F.date_format("ts", "dd-MM-yyyy HH:mm:ss"), _text(" | ", c, " | ", u % 100, " | ", u % 50, " | ", e % 16000))
    return _rendered(spark, sf_dir, "vm_dirty", [data, F.when(e % 10 == 0, F.lit(" "))])
