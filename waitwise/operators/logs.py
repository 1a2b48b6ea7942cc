"""Log analytics over assembled records.

Each parser is a projection with ``regexp_extract`` over the record text followed by
a global or grouped aggregation, so it is one pass with map-side partial sums.
Russian and English message forms are alternatives of the same expression.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.sources.bindings import bucket

# Message patterns of the server log (Russian first, then English, as the
# reference tries them), each with one capture group.
AV_TABLE = [r'автоматическая очистка таблицы "([^"]+)"', r'automatic vacuum of table "([^"]+)"']
AV_ELAPSED = [r"прошло:\s*([0-9.]+)\s*с", r"elapsed:\s*([0-9.]+)\s*s"]
AV_SCANS = [r"сканирований индекса:\s*([0-9]+)", r"index scans:\s*([0-9]+)"]
AV_REMOVED = [r"страниц удалено:\s*([0-9]+)", r"pages:\s*([0-9]+)\s+removed"]
AV_REMAIN = [r"осталось:\s*([0-9]+)", r"removed,\s*([0-9]+)\s+remain"]
AV_MARK = r"автоматическая очистка таблицы|automatic vacuum of table"      # plain texts, no other regex signs

CK_MARK_RU, CK_MARK_EN = "контрольная точка завершена", "checkpoint complete:"
CK_RU = {"buffers": r"записано буферов: ([0-9]+)", "wal_added": r"добавлено файлов WAL ([0-9]+)",
         "wal_removed": r"удалено: ([0-9]+)", "wal_recycled": r"переработано: ([0-9]+)",
         "write_s": r"запись=([0-9.]+) сек\.", "sync_s": r"синхр\.=([0-9.]+) сек\.",
         "sync_files": r"синхронизировано_файлов=([0-9]+)"}
CK_EN = {"buffers": r"wrote ([0-9]+) buffers", "wal_added": r"([0-9]+) WAL file\(s\) added",
         "wal_removed": r"([0-9]+) removed", "wal_recycled": r"([0-9]+) recycled",
         "write_s": r"write=([0-9.]+) s", "sync_s": r"sync=([0-9.]+) s", "sync_files": r"sync files=([0-9]+)"}

TEMP_MARK = r"temporary file:|временный файл:"
TEMP_SIZE = r"(size|размер) ([0-9]+)"

SEVERITY = r"ERROR|ОШИБКА|FATAL|ВАЖНО|ПАНИКА|PANIC"
# Our classes of repeated warnings (the reference names them in prose).
WARNING_CLASSES = [("cannot write log", r"could not write"),
                   ("checkpoints too frequent", r"checkpoints are occurring too frequently"),
                   ("temp file limit exceeded", r"temp_file_limit|temporary file size exceeds")]


def is_autovacuum(text: Column) -> Column:
    """Whether ``AV_MARK`` occurs: its texts are sought in the bytes, no regex runs on every line of a log."""
    ru, en = AV_MARK.split("|")
    return text.contains(ru) | text.contains(en)


def _first(text: Column, patterns: list[str]) -> Column:
    """First capture of the alternatives (none captures an empty text), else NULL. A regex runs, once, only where
    the plain text that it begins with occurs."""
    def capture(p: str) -> Column:
        begins = re.split(r"[\\(\[]", p)[0]
        return F.when(text.contains(begins), F.get(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(0)))
    return F.coalesce(*[capture(p) for p in patterns])


def autovacuum_events(records: DataFrame) -> DataFrame:
    """L1: one row per autovacuum record: ts, database, schema, table, duration_ms,
    index_scans, pages_removed, pages_remain (NULL when the field is missing).

    A two-part name ``a.b`` is read as database ``a``, schema ``public``, table ``b``.
    """
    r = F.col("record")
    found = records.filter(is_autovacuum(r)).select("ts", F.split(_first(r, AV_TABLE), r"\.").alias("parts"), "record")
    parts = F.col("parts")
    three = F.size(parts) >= 3
    secs = _first(r, AV_ELAPSED)
    # whole seconds from the text form: filters on it reach the records, where each mention of ``ts`` is parsed anew
    second = F.substring_index(F.col("ts").cast("string"), ".", 1).cast("timestamp_ntz")
    return found.filter(parts.isNotNull()).select(
        second.alias("curr_timestamp"),
        F.get(parts, 0).alias("database_name"),
        F.when(three, F.get(parts, 1)).otherwise(F.lit("public")).alias("schema_name"),
        F.when(three, F.get(parts, 2)).otherwise(F.get(parts, 1)).alias("table_name"),
        F.round(secs.cast("decimal(18,6)") * 1000).cast("bigint").alias("duration_ms"),
        _first(r, AV_SCANS).cast("bigint").alias("index_scans"),
        _first(r, AV_REMOVED).cast("bigint").alias("pages_removed"),
        _first(r, AV_REMAIN).cast("bigint").alias("pages_remain"))


def autovacuum_summary(events: DataFrame) -> DataFrame:
    """L2: count and sums of the autovacuum events; missing fields count 0."""
    def s(c: str) -> Column:
        return F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("bigint")
    return events.agg(F.count(F.lit(1)).alias("n"), s("duration_ms").alias("duration_ms"),
                      s("index_scans").alias("index_scans"), s("pages_removed").alias("pages_removed"),
                      s("pages_remain").alias("pages_remain"))


def checkpoint_summary(records: DataFrame, col: str = "record") -> DataFrame:
    """L3: checkpoint-complete messages (either language): count and sums; seconds to 3
    decimals. Always one row (zeros when there are none). ``col`` is the text column:
    physical lines (what the message patterns match, no shuffle needed) or records."""
    r = F.col(col)
    ru, en = r.contains(CK_MARK_RU), r.contains(CK_MARK_EN)
    ck = records.filter(ru | en)

    def field(k: str, dec: bool) -> Column:
        t = "decimal(18,3)" if dec else "bigint"
        v = F.when(F.col(col).contains(CK_MARK_RU), F.regexp_extract(col, CK_RU[k], 1)).otherwise(
            F.regexp_extract(col, CK_EN[k], 1))
        return F.coalesce(F.sum(F.nullif(v, F.lit("")).cast(t)), F.lit(0).cast(t))

    return ck.agg(F.count(F.lit(1)).alias("n"),
                  *[field(k, False).alias(k) for k in ("buffers", "wal_added", "wal_removed", "wal_recycled")],
                  *[field(k, True).cast("double").alias(k) for k in ("write_s", "sync_s")],
                  field("sync_files", False).alias("sync_files"))


def temp_file_summary(records: DataFrame, col: str = "record") -> DataFrame:
    """L4: temporary files: count and total MB (2 decimals); one row of zeros when none."""
    t = records.filter(F.col(col).rlike(TEMP_MARK))
    size = F.nullif(F.regexp_extract(col, TEMP_SIZE, 2), F.lit("")).cast("bigint")
    return t.agg(F.count(F.lit(1)).alias("n"),
                 F.round(F.coalesce(F.sum(size), F.lit(0)) / F.lit(1048576.0), 2).alias("mb"))


def known_errors(fields: DataFrame, dim: DataFrame) -> DataFrame:
    """Records whose SQLSTATE is a known, non-success code, with the condition name.
    The SQLSTATE dictionary has a few hundred rows at most: broadcast is bounded."""
    d = dim.select("code", "condition", "ord")
    f = fields.filter(F.col("sqlstate") != "00000")
    return f.join(d, f.sqlstate == d.code).drop("code")


def error_counts(lines: DataFrame, dim: DataFrame, strict: bool = False) -> DataFrame:
    """Physical lines mentioning a severity keyword → field 7 (SQLSTATE) → count per known
    code other than 00000, listed in dictionary order.

    ``strict=False`` follows the reference (keyword anywhere in the line);
    ``strict=True`` requires the message itself to start with the severity.
    """
    line = F.col("line")
    if strict:
        sel = lines.filter(F.get(F.split(line, r"\|", 8), 7).rlike(rf"^\s*({SEVERITY})"))
    else:
        sel = lines.filter(line.rlike(SEVERITY))
    codes = sel.select(F.trim(F.get(F.split(line, r"\|"), 6)).alias("code")).filter(F.col("code") != "00000")
    cnt = codes.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    d = dim.select("code", "condition", "ord")
    return cnt.join(d, "code").select("code", "condition", "n", "ord")


def warning_counts(records: DataFrame, min_count: int = 2, col: str = "record") -> DataFrame:
    """Repeated warning classes (count >= min_count) over lines or records."""
    cls = None
    for name, pat in WARNING_CLASSES:
        cls = (F.when(F.col(col).rlike(pat), F.lit(name)) if cls is None
               else cls.when(F.col(col).rlike(pat), F.lit(name)))
    w = records.filter(F.col(col).rlike("WARNING|ПРЕДУПРЕЖДЕНИЕ")).select(cls.alias("class"))
    return w.filter(F.col("class").isNotNull()).groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") >= min_count)


def newer_than(events: DataFrame, mark: Column, ts: str = "curr_timestamp") -> DataFrame:
    """The events strictly later than a high-water mark (e.g. ``EventStore.mark()``)."""
    return events.filter(F.col(ts) > mark)


def incremental_import(new: DataFrame, existing: DataFrame, ts: str = "curr_timestamp") -> DataFrame:
    """A12 against a frame: rows of ``new`` strictly later than the newest row of ``existing`` (1970 if empty).
    The high-water mark is a scalar subquery, so the filter runs on every partition."""
    return newer_than(new, F.coalesce(existing.select(F.max(ts)).scalar(), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")), ts)
