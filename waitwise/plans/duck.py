"""DuckDB text of the input bindings, so each oracle query is self-contained SQL over
the pre-registered driver views. Keep each definition in step with
``waitwise.sources.bindings`` (same rule, written independently in SQL)."""

from __future__ import annotations

from waitwise.sources.bindings import WAIT_TYPES

_WAIT_TYPE_CASE = ("CASE event_type WHEN 'click' THEN 'IO' WHEN 'view' THEN 'LWLock' "
                   "WHEN 'purchase' THEN 'Lock' WHEN 'signup' THEN 'IPC' ELSE 'Timeout' END")


def _s(x: str) -> str:
    return f"CAST({x} AS VARCHAR)"


BINDINGS: dict[str, str] = {}

BINDINGS["wait_samples"] = f"""
SELECT event_id, ts, 'pg' || {_s('user_id % 3')} AS cluster, user_id AS queryid,
       'db' || {_s('user_id % 5')} AS dbname, 'role' || {_s('user_id % 2')} AS rolname,
       {_WAIT_TYPE_CASE} AS wait_event_type,
       event_type || '_' || {_s('user_id % 3')} AS wait_event, event_type,
       CAST(round(value * 100) AS BIGINT) AS cents
FROM events"""


def cluster_series_sql(grain: str) -> str:
    by_type = ", ".join(f"count(*) FILTER (WHERE wait_event_type = '{t}') AS waits_{t}" for t in WAIT_TYPES)
    return f"""
SELECT cluster, ts, calls, nrows, waits, {', '.join('waits_' + t for t in WAIT_TYPES)}, calls + nrows AS speed
FROM (SELECT cluster, date_trunc('{grain}', ts) AS ts, count(DISTINCT queryid) AS calls,
             sum(cents) // 100 AS nrows, count(*) AS waits, {by_type}
      FROM wait_samples GROUP BY 1, 2) q"""


def vmstat_series_sql(grain: str) -> str:
    return f"""
SELECT cluster, ts, r, b, us, sy, greatest(0, 100 - us - sy) AS id, 100 * b // r AS wa, cs, bi, bo, swpd, free, buff, cache, si, so, intr
FROM (SELECT cluster, date_trunc('{grain}', ts) AS ts, count(*) AS r,
             count(*) FILTER (WHERE event_type = 'error') AS b,
             least(100, sum(cents) // (100 * count(*))) AS us,
             least(100, 5 * count(*) FILTER (WHERE event_type = 'click')) AS sy,
             100000 * count(DISTINCT queryid) AS cs,
             coalesce(sum(cents) FILTER (WHERE event_type = 'view') // 100, 0) AS bi,
             coalesce(sum(cents) FILTER (WHERE event_type = 'purchase') // 100, 0) AS bo,
             CAST(sum(queryid) % 4096 AS BIGINT) AS swpd, CAST(16384 - sum(event_id) % 8192 AS BIGINT) AS free,
             64 + max(cents) % 512 AS buff, CAST(4096 + (sum(cents) // 100) % 4096 AS BIGINT) AS cache,
             count(*) FILTER (WHERE event_type = 'error') * (1 + max(queryid) % 5) AS si,
             count(*) FILTER (WHERE event_type IN ('error', 'purchase')) AS so, 100 * count(*) + min(queryid) % 100 AS intr
      FROM wait_samples GROUP BY 1, 2) q"""


def iostat_series_sql(grain: str) -> str:
    return f"""
SELECT cluster, 'dev' || {_s('queryid % 4')} AS device, date_trunc('{grain}', ts) AS ts,
       count(*) FILTER (WHERE event_type = 'view') AS r_s,
       count(*) FILTER (WHERE event_type = 'purchase') AS w_s,
       max(cents) AS await_ms, least(100, sum(cents) // (100 * count(*))) AS util
FROM wait_samples GROUP BY 1, 2, 3"""


BINDINGS["cluster_series"] = cluster_series_sql("hour")
BINDINGS["vmstat_series"] = vmstat_series_sql("hour")
BINDINGS["iostat_series"] = iostat_series_sql("hour")

BINDINGS["resource_series"] = """
SELECT cluster, ts, numbackends, CAST(sum(temp) OVER w AS BIGINT) AS temp_bytes, CAST(512 + sum(rss) OVER w AS BIGINT) AS rss_mb, prepared
FROM (SELECT cluster, date_trunc('hour', ts) AS ts, count(DISTINCT queryid) AS numbackends,
             coalesce(sum(cents) FILTER (WHERE event_type = 'view'), 0) * 1024 AS temp,
             count(*) FILTER (WHERE event_type = 'purchase') AS rss, count(*) FILTER (WHERE event_type = 'signup') AS prepared
      FROM wait_samples GROUP BY 1, 2) q
WINDOW w AS (PARTITION BY cluster ORDER BY ts ROWS UNBOUNDED PRECEDING)"""

BINDINGS["host_tables"] = f"""
SELECT l_suppkey AS host, 't' || {_s('l_partkey % 10')} AS table_name, CAST(sum(CAST(l_quantity AS BIGINT)) * 8 AS BIGINT) AS size_mb
FROM lineitem GROUP BY 1, 2"""

BINDINGS["order_speed"] = """
SELECT date_trunc('month', o_orderdate) AS ts, count(*) + count(DISTINCT o_custkey) AS speed FROM orders GROUP BY 1"""

BINDINGS["dirty_samples"] = f"""
SELECT ts, 'pg' || {_s('user_id % 3')} AS cluster, CAST(round(value * 100) AS BIGINT) AS nr_dirty,
       (user_id % 3) * 10 AS dirty_ratio,
       CAST(CASE WHEN user_id % 5 = 0 THEN 268435456 ELSE 0 END AS BIGINT) AS dirty_bytes,
       (user_id % 2) * 10 AS dirty_bg_ratio,
       CAST(CASE WHEN user_id % 7 = 0 THEN 134217728 ELSE 0 END AS BIGINT) AS dirty_bg_bytes,
       CAST(CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id + 1000000 END AS BIGINT) AS mem_available_kb,
       event_id + 300000 AS mem_free_kb, event_id + 500000 AS cached_kb
FROM events"""

BINDINGS["accounts"] = "SELECT c_custkey AS aid, c_nationkey AS bid, c_acctbal AS abalance FROM customer"
BINDINGS["branches"] = "SELECT n_nationkey AS bid FROM nation"
BINDINGS["tellers"] = "SELECT s_suppkey AS tid, s_nationkey AS bid FROM supplier"
BINDINGS["history"] = """
SELECT c.c_nationkey AS bid, o.o_custkey AS aid, o.o_totalprice AS delta, o.o_orderdate AS mtime
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

BINDINGS["buffer_series"] = """
SELECT date_trunc('month', l_shipdate) AS ts, sum(CAST(l_quantity AS BIGINT)) AS blks_hit,
       count(*) FILTER (WHERE l_returnflag = 'R') AS blks_read,
       count(*) FILTER (WHERE l_linestatus = 'O') AS blks_dirtied,
       count(*) FILTER (WHERE l_discount >= 0.05) AS blks_written
FROM lineitem GROUP BY 1"""

BINDINGS["load_passes"] = """
SELECT 1 AS test_id, CAST(date_diff('day', (SELECT min(date_trunc('day', ts)) FROM events), start_ts) + 1 AS INTEGER) AS pass_counter, start_ts,
       start_ts + INTERVAL 23 HOUR AS finish_ts, load
FROM (SELECT date_trunc('day', ts) AS start_ts, count(DISTINCT user_id) AS load FROM events GROUP BY 1) d"""

BINDINGS["query_texts"] = f"""
SELECT ts, user_id AS queryid,
       CASE WHEN user_id % 10 = 0
            THEN 'select scenario' || {_s('user_id % 3 + 1')} || '() /* ' || event_type || ' */'
            ELSE 'SELECT * FROM t' || {_s('user_id')} || ' WHERE kind = ''' || event_type || '''' END AS query
FROM events"""

BINDINGS["settings"] = """
SELECT host, name, setting, (name = 'shared_buffers_mb' AND host % 11 = 0) AS pending_restart
FROM (SELECT s_suppkey AS host,
             CASE WHEN s_suppkey % 3 = 0 THEN 4.0 ELSE 1.1 END::DOUBLE AS random_page_cost,
             CASE WHEN s_suppkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS is_ssd,
             round(s_acctbal * 10)::DOUBLE AS effective_cache_size_mb,
             8192.0::DOUBLE AS free_mb, 4096.0::DOUBLE AS shared_buffers_mb,
             ((s_suppkey % 8) * 4 + 4)::DOUBLE AS work_mem_mb,
             CASE WHEN s_suppkey % 5 = 0 THEN 0.2 ELSE 0.05 END::DOUBLE AS autovacuum_vacuum_scale_factor
      FROM supplier) w
UNPIVOT (setting FOR name IN (random_page_cost, is_ssd, effective_cache_size_mb, free_mb,
                              shared_buffers_mb, work_mem_mb, autovacuum_vacuum_scale_factor))"""

BINDINGS["kernel_params"] = """
SELECT test_id, pass_counter, load % 40 + 10 AS vm_dirty_ratio, load % 10 + 5 AS vm_dirty_background_ratio,
       60 AS vm_swappiness, pass_counter * 100 AS vm_dirty_expire_centisecs
FROM load_passes"""

# dependencies between bindings (a binding's CTE must come after those it reads)
DEPENDS = {
    "cluster_series": ["wait_samples"], "vmstat_series": ["wait_samples"], "iostat_series": ["wait_samples"],
    "resource_series": ["wait_samples"],
    "kernel_params": ["load_passes"],
}


def with_bindings(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with the CTEs of the named bindings (and their dependencies)."""
    ordered: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, []):
            visit(d)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        visit(n)
    ordered += [n for n in (extra or {}) if n not in ordered]
    defs = {**BINDINGS, **(extra or {})}
    ctes = ",\n".join(f"{n} AS ({defs[n]})" for n in ordered)
    return f"WITH {ctes}\n{sql}" if ctes else sql


def rounded(sql: str, cols: list[str], digits: int = 9) -> str:
    """Round double columns of a query (both engines round outputs to 9 digits)."""
    rep = ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({sql}) rq"


# Server-log lines derived from events (see waitwise.sources.serverlog.log_lines).
_V = "CAST(cents // 100 AS VARCHAR) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')"
_MS3 = "lpad(CAST(user_id % 1000 AS VARCHAR), 3, '0')"
_NAME = ("CASE WHEN user_id % 4 = 0 THEN 'public.t' || CAST(user_id % 20 AS VARCHAR) "
         "ELSE 'db' || CAST(user_id % 5 AS VARCHAR) || '.public.t' || CAST(user_id % 20 AS VARCHAR) END")
BINDINGS["log_lines"] = f"""
SELECT 'postgresql-' || strftime(ts, '%Y-%m-%d') || '.log' AS file, CAST(floor(line_no / 4096) AS BIGINT) AS chunk,
       line_no AS pos, line_no, line
FROM (
  SELECT ts, event_id * 4 + k AS line_no,
    CASE
      WHEN kind = 2 AND k = 0 THEN prefix || 'LOG:  automatic vacuum of table "' || {_NAME} || '": index scans: '
                                   || CAST(user_id % 3 AS VARCHAR)
      WHEN kind = 2 AND k = 1 THEN chr(9) || 'pages: ' || CAST(user_id % 7 AS VARCHAR) || ' removed, '
                                   || CAST(user_id * 5 AS VARCHAR) || ' remain, 0 skipped due to pins, 0 skipped frozen'
      WHEN kind = 2 AND k = 2 THEN chr(9) || 'system usage: CPU: user: 0.01 s, system: 0.00 s, elapsed: ' || {_V} || ' s'
      WHEN kind = 3 AND k = 0 THEN prefix || 'СООБЩЕНИЕ:  автоматическая очистка таблицы "' || {_NAME}
                                   || '": сканирований индекса: ' || CAST(user_id % 3 AS VARCHAR)
      WHEN kind = 3 AND k = 1 THEN chr(9) || 'страниц удалено: ' || CAST(user_id % 7 AS VARCHAR) || ', осталось: '
                                   || CAST(user_id * 5 AS VARCHAR) || ', пропущено закреплённых: 0, пропущено замороженных: 0'
      WHEN kind = 3 AND k = 2 THEN chr(9) || 'использование системы: ЦП: пользов.: 0.01 с, система: 0.00 с, прошло: '
                                   || {_V} || ' с'
      WHEN kind = 0 THEN prefix || 'LOG:  checkpoint complete: wrote ' || CAST(user_id * 3 AS VARCHAR)
           || ' buffers (0.1%); ' || CAST(user_id % 2 AS VARCHAR) || ' WAL file(s) added, '
           || CAST(user_id % 4 AS VARCHAR) || ' removed, ' || CAST(user_id % 5 AS VARCHAR) || ' recycled; write='
           || {_V} || ' s, sync=0.' || {_MS3} || ' s, total=' || {_V} || ' s; sync files=' || CAST(user_id % 9 AS VARCHAR)
           || ', longest=0.001 s, average=0.001 s; distance=' || CAST(user_id AS VARCHAR) || ' kB, estimate='
           || CAST(user_id AS VARCHAR) || ' kB'
      WHEN kind = 1 THEN prefix || 'СООБЩЕНИЕ:  контрольная точка завершена: записано буферов: '
           || CAST(user_id * 3 AS VARCHAR) || ' (0.1%); добавлено файлов WAL ' || CAST(user_id % 2 AS VARCHAR)
           || ', удалено: ' || CAST(user_id % 4 AS VARCHAR) || ', переработано: ' || CAST(user_id % 5 AS VARCHAR)
           || '; запись=' || {_V} || ' сек., синхр.=0.' || {_MS3} || ' сек., всего=' || {_V}
           || ' сек.; синхронизировано_файлов=' || CAST(user_id % 9 AS VARCHAR)
           || ', самая_долгая_синхр.=0.001 сек., средняя=0.001 сек.; расстояние=' || CAST(user_id AS VARCHAR)
           || ' kB, ожидалось=' || CAST(user_id AS VARCHAR) || ' kB'
      WHEN kind = 4 AND user_id % 2 = 0 THEN prefix || 'LOG:  temporary file: path "base/pgsql_tmp/pgsql_tmp'
           || CAST(user_id + 1000 AS VARCHAR) || '.0", size ' || CAST(user_id * 1048576 AS VARCHAR)
      WHEN kind = 4 THEN prefix || 'СООБЩЕНИЕ:  временный файл: путь "base/pgsql_tmp/pgsql_tmp'
           || CAST(user_id + 1000 AS VARCHAR) || '.0", размер ' || CAST(user_id * 1048576 AS VARCHAR)
      WHEN user_id % 6 = 0 THEN prefix || 'ERROR:  deadlock detected'
      WHEN user_id % 6 = 1 THEN prefix || 'ERROR:  duplicate key value violates unique constraint "t'
           || CAST(user_id AS VARCHAR) || '_pkey"'
      WHEN user_id % 6 = 2 THEN prefix || 'ОШИБКА:  отношение "t' || CAST(user_id AS VARCHAR) || '" не существует'
      WHEN user_id % 6 = 3 THEN prefix || 'FATAL:  terminating connection due to administrator command'
      WHEN user_id % 6 = 4 THEN prefix || 'WARNING:  checkpoints are occurring too frequently ('
           || CAST(user_id % 30 + 1 AS VARCHAR) || ' seconds apart)'
      WHEN event_id % 12 = 5 THEN prefix || 'WARNING:  could not write to log file: No space left on device'
      ELSE prefix || 'WARNING:  temporary file size exceeds temp_file_limit (1024kB)'
    END AS line
  FROM (SELECT *, event_id % 6 AS kind, CAST(round(value * 100) AS BIGINT) AS cents,
               strftime(ts, '%Y-%m-%d %H:%M:%S') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || ' UTC| db'
               || CAST(user_id % 5 AS VARCHAR) || '| psql| role' || CAST(user_id % 2 AS VARCHAR) || '| 10.0.'
               || CAST(user_id % 8 AS VARCHAR) || '.' || CAST(user_id % 250 AS VARCHAR) || '| '
               || CAST(user_id + 1000 AS VARCHAR) || '| '
               || CASE WHEN event_id % 6 <> 5 THEN '00000' WHEN user_id % 6 = 0 THEN '40P01'
                       WHEN user_id % 6 = 1 THEN '23505' WHEN user_id % 6 = 2 THEN '42P01'
                       WHEN user_id % 6 = 3 THEN '57P01' WHEN user_id % 6 = 4 THEN '01000'
                       WHEN event_id % 12 = 5 THEN '53100' ELSE '53400' END || '| ' AS prefix
        FROM events) e
  CROSS JOIN range(0, 3) r(k)
  WHERE k = 0 OR kind IN (2, 3)) q"""

# Records assembled from log_lines by an independent window formulation.
BINDINGS["log_records"] = """
SELECT file, rec_pos, CAST(substr(string_agg(line, chr(10) ORDER BY pos), 1, 19) AS TIMESTAMP) AS ts,
       string_agg(line, chr(10) ORDER BY pos) AS record, count(*) AS n_lines
FROM (SELECT *, max(CASE WHEN regexp_matches(line, '^\\s*\\d{4}-\\d{2}-\\d{2}\\s+\\d{2}:\\d{2}:\\d{2}\\.\\d+') THEN pos END)
                  OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS rec_pos
      FROM log_lines) l
WHERE rec_pos IS NOT NULL
GROUP BY file, rec_pos"""
DEPENDS["log_records"] = ["log_lines"]


def round_double_outputs(sqls: dict[str, str], sample_dir: str, digits: int = 9) -> dict[str, str]:
    """Wrap each oracle so its DOUBLE output columns are rounded like the Spark side
    (round to ``digits``, then + 0.0 to fold -0.0). Column types come from DuckDB's
    DESCRIBE of the query over the views of ``sample_dir``; an oracle that cannot be
    described is an error."""
    import duckdb

    con = duckdb.connect()
    for t in ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]:
        try:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sample_dir}/{t}.parquet')")
        except Exception:  # noqa: BLE001 - a missing table only matters to oracles that read it
            pass
    out = {}
    for name, sql in sqls.items():
        cols = [(r[0], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()]
        dbl = [c for c, t in cols if t in ("DOUBLE", "FLOAT")]
        if not dbl:
            out[name] = sql
            continue
        rep = ", ".join(f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in dbl)
        out[name] = f"SELECT * REPLACE ({rep}) FROM ({sql}) oracle_q"
    con.close()
    return out
