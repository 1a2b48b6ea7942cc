"""Catalogue: server-log sources and parsers."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from waitwise.operators import logs as L
from waitwise.plans.duck import with_bindings
from waitwise.plans.registry import register
from waitwise.session import checkpoint_dir
from waitwise.sources import serverlog as S
from waitwise.sources.eventstore import EventStore

SLICE_S, SLICE_F = "2024-01-10 00:00", "2024-01-12 23:59"
STORED_UNTIL = "2024-01-15 00:00:00"


def _records(spark, sf, start_filter: str | None = None):
    return S.assemble_records(S.log_lines(spark, sf), start_filter)


def _dim_values() -> str:
    rows = []
    for i, t in enumerate(S.SQLSTATE_TEXT.splitlines()):
        m = re.match(r"^([0-9A-Z]{5})\s+([A-Za-z_][A-Za-z_0-9]*)", t)
        if m:
            rows.append(f"('{m.group(1)}', '{m.group(2)}', {i})")
    return "(VALUES " + ", ".join(rows) + ") d(code, condition, ord)"


def _first_sql(patterns: list[str]) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(record, '{p}', 1), '')" for p in patterns) + ")"


@register("log_records", "A8", with_bindings("SELECT * FROM log_records", "log_records"))
def q_log_records(spark, sf):
    """Physical log lines assembled into multi-line records (segmented scan)."""
    return _records(spark, sf)


_FIELDS_SQL = """SELECT file, rec_pos, ts, trim(split_part(record, '|', 2)) AS db, trim(split_part(record, '|', 3)) AS app,
       trim(split_part(record, '|', 4)) AS usr, trim(split_part(record, '|', 5)) AS host,
       trim(split_part(record, '|', 6)) AS pid, trim(split_part(record, '|', 7)) AS sqlstate,
       regexp_extract(record, '(?s)^(?:[^|]*\\|){7}\\s*(.*)$', 1) AS message
FROM log_records"""


@register("log_prefix_fields", "A9", with_bindings(_FIELDS_SQL, "log_records"))
def q_log_prefix_fields(spark, sf):
    """The seven prefix fields and the message of every record."""
    return S.log_prefix_fields(_records(spark, sf))


@register("log_time_slice", "A10", with_bindings(
    f"SELECT * FROM log_records WHERE date_trunc('minute', ts) BETWEEN TIMESTAMP '{SLICE_S}' AND TIMESTAMP '{SLICE_F}'",
    "log_records"))
def q_log_time_slice(spark, sf):
    """Records of one report interval, minute-inclusive on both ends (the slice is the feature)."""
    return S.records_in_slice(S.log_lines(spark, sf), SLICE_S, SLICE_F)


@register("log_files_for_date", "A11", with_bindings(
    "SELECT file, CAST(substr(arg_min(line, pos), 1, 19) AS TIMESTAMP) AS first_ts FROM log_lines GROUP BY file",
    "log_lines"))
def q_log_files_for_date(spark, sf):
    """Every log file with the timestamp of its first line (all days at once)."""
    return S.log_files_for_date(S.log_lines(spark, sf))


_AV_SQL = f"""
SELECT date_trunc('second', ts) AS curr_timestamp, split_part(name, '.', 1) AS database_name,
       CASE WHEN len(string_split(name, '.')) >= 3 THEN split_part(name, '.', 2) ELSE 'public' END AS schema_name,
       CASE WHEN len(string_split(name, '.')) >= 3 THEN split_part(name, '.', 3) ELSE split_part(name, '.', 2) END
         AS table_name,
       CAST(round(CAST(secs AS DECIMAL(18, 6)) * 1000) AS BIGINT) AS duration_ms,
       CAST(scans AS BIGINT) AS index_scans, CAST(removed AS BIGINT) AS pages_removed,
       CAST(remain AS BIGINT) AS pages_remain
FROM (SELECT ts, {_first_sql(L.AV_TABLE)} AS name, {_first_sql(L.AV_ELAPSED)} AS secs,
             {_first_sql(L.AV_SCANS)} AS scans, {_first_sql(L.AV_REMOVED)} AS removed,
             {_first_sql(L.AV_REMAIN)} AS remain
      FROM log_records WHERE regexp_matches(record, '{L.AV_MARK}')) a
WHERE name IS NOT NULL"""


@register("autovacuum_events", "L1", with_bindings(_AV_SQL, "log_records"))
def q_autovacuum_events(spark, sf):
    """Autovacuum records (English and Russian) parsed into event rows."""
    return L.autovacuum_events(_records(spark, sf, L.is_autovacuum(F.col("line"))))


@register("autovacuum_summary", "L2", with_bindings(f"""
SELECT count(*) AS n, CAST(coalesce(sum(coalesce(duration_ms, 0)), 0) AS BIGINT) AS duration_ms,
       CAST(coalesce(sum(coalesce(index_scans, 0)), 0) AS BIGINT) AS index_scans,
       CAST(coalesce(sum(coalesce(pages_removed, 0)), 0) AS BIGINT) AS pages_removed,
       CAST(coalesce(sum(coalesce(pages_remain, 0)), 0) AS BIGINT) AS pages_remain
FROM ({_AV_SQL}) e""", "log_records"))
def q_autovacuum_summary(spark, sf):
    """Autovacuum totals: operations, duration, index scans, pages removed / remaining."""
    return L.autovacuum_summary(L.autovacuum_events(_records(spark, sf, L.is_autovacuum(F.col("line")))))


def _ck_field(k: str, dec: bool) -> str:
    t = "DECIMAL(18, 3)" if dec else "BIGINT"
    v = (f"nullif(CASE WHEN contains(line, '{L.CK_MARK_RU}') THEN regexp_extract(line, '{L.CK_RU[k]}', 1) "
         f"ELSE regexp_extract(line, '{L.CK_EN[k]}', 1) END, '')")
    out = f"coalesce(sum(CAST({v} AS {t})), CAST(0 AS {t}))"
    return f"CAST({out} AS DOUBLE) AS {k}" if dec else f"{out} AS {k}"


@register("checkpoint_summary", "L3", with_bindings(f"""
SELECT count(*) AS n, {', '.join(_ck_field(k, False) for k in ('buffers', 'wal_added', 'wal_removed', 'wal_recycled'))},
       {_ck_field('write_s', True)}, {_ck_field('sync_s', True)}, {_ck_field('sync_files', False)}
FROM log_lines WHERE contains(line, '{L.CK_MARK_RU}') OR contains(line, '{L.CK_MARK_EN}')""", "log_lines"))
def q_checkpoint_summary(spark, sf):
    """Checkpoint totals in both log languages (per physical line: no record shuffle)."""
    return L.checkpoint_summary(S.log_lines(spark, sf), col="line")


@register("temp_file_summary", "L4", with_bindings(f"""
SELECT count(*) AS n,
       round(coalesce(sum(CAST(nullif(regexp_extract(line, '{L.TEMP_SIZE}', 2), '') AS BIGINT)), 0) / 1048576.0, 2)
         AS mb
FROM log_lines WHERE regexp_matches(line, '{L.TEMP_MARK}')""", "log_lines"))
def q_temp_file_summary(spark, sf):
    """Temporary files: count and total MB (per physical line)."""
    return L.temp_file_summary(S.log_lines(spark, sf), col="line")


@register("known_errors", "J6", with_bindings(f"""
SELECT f.*, d.condition, d.ord FROM ({_FIELDS_SQL}) f JOIN {_dim_values()} ON f.sqlstate = d.code
WHERE f.sqlstate <> '00000'""", "log_records"))
def q_known_errors(spark, sf):
    """Records carrying a known non-success SQLSTATE, with the condition name."""
    return L.known_errors(S.log_prefix_fields(_records(spark, sf)), S.sqlstate_dim(spark))


@register("error_counts", "L5", with_bindings(f"""
SELECT c.code, d.condition, c.n, d.ord
FROM (SELECT trim(split_part(line, '|', 7)) AS code, count(*) AS n FROM log_lines
      WHERE regexp_matches(line, '{L.SEVERITY}') AND trim(split_part(line, '|', 7)) <> '00000' GROUP BY 1) c
JOIN {_dim_values()} ON c.code = d.code""", "log_lines"))
def q_error_counts(spark, sf):
    """Error lines per known SQLSTATE (ERROR / FATAL / PANIC and Russian forms)."""
    return L.error_counts(S.log_lines(spark, sf), S.sqlstate_dim(spark))


def _warn_case() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in L.WARNING_CLASSES) + " END"


@register("warning_counts", "L6", with_bindings(f"""
SELECT class, count(*) AS n FROM (SELECT {_warn_case()} AS class FROM log_lines
                                  WHERE regexp_matches(line, 'WARNING|ПРЕДУПРЕЖДЕНИЕ')) w
WHERE class IS NOT NULL GROUP BY class HAVING count(*) >= 2""", "log_lines"))
def q_warning_counts(spark, sf):
    """Repeated warning classes (per physical line)."""
    return L.warning_counts(S.log_lines(spark, sf), col="line")


@register("incremental_import", "A12", with_bindings(f"""
SELECT * FROM ({_AV_SQL}) e
WHERE curr_timestamp > coalesce((SELECT max(curr_timestamp) FROM ({_AV_SQL}) s
                                 WHERE curr_timestamp < TIMESTAMP '{STORED_UNTIL}'), TIMESTAMP '1970-01-01')""",
    "log_records"))
def q_incremental_import(spark, sf):
    """Autovacuum events newer than the stored high-water mark: the files of the days before a cut-over are
    imported into an event store, then only files that its manifest does not name are read."""
    lines = S.log_lines(spark, sf)
    cut = F.lit(STORED_UNTIL).cast("timestamp_ntz")
    old = [r["file"] for r in S.log_files_for_date(lines).filter(F.col("first_ts") < cut).collect()]
    schema = L.autovacuum_events(S.assemble_records(lines)).schema
    store = EventStore(spark, f"{checkpoint_dir(spark)}/autovacuum-{uuid.uuid4().hex}", schema)
    store.import_batch(1, L.autovacuum_events(S.assemble_records(lines.filter(F.col("file").isin(old)), L.is_autovacuum(F.col("line")))), old)
    rest = lines.filter(~F.col("file").isin(store.imported_files()))
    return L.newer_than(L.autovacuum_events(S.assemble_records(rest, L.is_autovacuum(F.col("line")))), store.mark())
