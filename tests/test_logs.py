"""Server-log reader and parsers on literal English and Russian lines."""

import datetime as dt
import os

from pyspark.sql import functions as F

from waitwise.operators import logs as L
from waitwise.sources import serverlog as S

P = "2024-03-01 10:{m}:{s}.123 UTC| db1| psql| alice| 10.0.0.1| 4242| {code}| "

LOG = "\n".join([
    "orphan continuation before any record",
    P.format(m="00", s="01", code="00000") + 'LOG:  automatic vacuum of table "shop.public.orders": index scans: 1',
    "\tpages: 0 removed, 45 remain, 0 skipped due to pins, 0 skipped frozen",
    "\tsystem usage: CPU: user: 0.01 s, system: 0.00 s, elapsed: 1.50 s",
    P.format(m="01", s="00", code="00000") + 'СООБЩЕНИЕ:  автоматическая очистка таблицы "public.items": '
    "сканирований индекса: 2",
    "\tстраниц удалено: 7, осталось: 1000, пропущено закреплённых: 0",
    "\tиспользование системы: ЦП: пользов.: 0.01 с, система: 0.00 с, прошло: 0.25 с",
    P.format(m="02", s="00", code="00000") + "LOG:  checkpoint complete: wrote 30 buffers (0.1%); 1 WAL file(s) added, "
    "2 removed, 3 recycled; write=1.500 s, sync=0.010 s, total=1.6 s; sync files=4, longest=0.001 s",
    P.format(m="03", s="00", code="00000") + "СООБЩЕНИЕ:  контрольная точка завершена: записано буферов: 10 (0.1%); "
    "добавлено файлов WAL 0, удалено: 1, переработано: 1; запись=0.250 сек., синхр.=0.005 сек., всего=0.3 сек.; "
    "синхронизировано_файлов=2",
    P.format(m="04", s="00", code="00000") + 'LOG:  temporary file: path "base/pgsql_tmp/x.0", size 2097152',
    P.format(m="05", s="00", code="00000") + 'СООБЩЕНИЕ:  временный файл: путь "base/pgsql_tmp/y.0", размер 1048576',
    P.format(m="06", s="00", code="40P01") + "ERROR:  deadlock detected",
    "\tDETAIL:  Process 1 waits for ShareLock; blocked by process 2.",
    P.format(m="07", s="00", code="57P01") + "FATAL:  terminating connection due to administrator command",
    P.format(m="08", s="00", code="42P01") + 'ОШИБКА:  отношение "t" не существует',
    P.format(m="09", s="00", code="ZZ999") + "ERROR:  unknown code is ignored",
    P.format(m="10", s="00", code="00000") + "ERROR:  success code is ignored",
    P.format(m="11", s="00", code="01000") + "WARNING:  checkpoints are occurring too frequently (9 seconds apart)",
    P.format(m="12", s="00", code="01000") + "WARNING:  checkpoints are occurring too frequently (8 seconds apart)",
    P.format(m="13", s="00", code="53100") + "WARNING:  could not write to log file",
])


def _write(tmpdir_path, text, name="postgresql-2024-03-01.log"):
    p = os.path.join(tmpdir_path, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text + "\n")
    return p


def test_records_from_text(spark, tmpdir_path):
    recs = S.read_server_log(spark, _write(tmpdir_path, LOG)).orderBy("ts").collect()
    assert len(recs) == 14                     # orphan line dropped
    assert recs[0]["n_lines"] == 3 and "elapsed: 1.50 s" in recs[0]["record"]
    assert str(recs[0]["ts"]) == "2024-03-01 10:00:01"
    assert recs[6]["n_lines"] == 2             # DETAIL continues the deadlock record


def test_autovacuum_events(spark, tmpdir_path):
    recs = S.read_server_log(spark, _write(tmpdir_path, LOG))
    ev = {r["table_name"]: r for r in L.autovacuum_events(recs).collect()}
    en, ru = ev["orders"], ev["items"]
    assert (en["database_name"], en["schema_name"], en["duration_ms"], en["index_scans"]) == ("shop", "public", 1500, 1)
    assert (en["pages_removed"], en["pages_remain"]) == (0, 45)     # the English offset defect is fixed
    assert (ru["database_name"], ru["schema_name"]) == ("public", "public")   # two-part name rule kept
    assert (ru["duration_ms"], ru["index_scans"], ru["pages_removed"], ru["pages_remain"]) == (250, 2, 7, 1000)
    s = L.autovacuum_summary(L.autovacuum_events(recs)).collect()[0]
    assert tuple(s) == (2, 1750, 3, 7, 1045)


def test_checkpoint_and_temp(spark, tmpdir_path):
    recs = S.read_server_log(spark, _write(tmpdir_path, LOG))
    c = L.checkpoint_summary(recs).collect()[0].asDict()
    assert c == {"n": 2, "buffers": 40, "wal_added": 1, "wal_removed": 3, "wal_recycled": 4, "write_s": 1.75,
                 "sync_s": 0.015, "sync_files": 6}
    t = L.temp_file_summary(recs).collect()[0]
    assert (t["n"], t["mb"]) == (2, 3.0)


def test_empty_summaries_give_one_row(spark, tmpdir_path):
    recs = S.read_server_log(spark, _write(tmpdir_path, P.format(m="00", s="00", code="00000") + "LOG:  hello"))
    assert tuple(L.checkpoint_summary(recs).collect()[0]) == (0, 0, 0, 0, 0, 0.0, 0.0, 0)
    assert tuple(L.temp_file_summary(recs).collect()[0]) == (0, 0.0)


def test_error_counts(spark, tmpdir_path):
    lines = S.read_log_lines(spark, _write(tmpdir_path, LOG))
    got = {(r["code"], r["condition"], r["n"]) for r in L.error_counts(lines, S.sqlstate_dim(spark)).collect()}
    assert got == {("40P01", "deadlock_detected", 1), ("57P01", "admin_shutdown", 1), ("42P01", "undefined_table", 1)}


def test_warning_counts(spark, tmpdir_path):
    recs = S.read_server_log(spark, _write(tmpdir_path, LOG))
    got = {r["class"]: r["n"] for r in L.warning_counts(recs).collect()}
    assert got == {"checkpoints too frequent": 2}        # the single "could not write" is not repeated


def test_time_slice_and_files(spark, tmpdir_path):
    path = _write(tmpdir_path, LOG)
    recs = S.read_server_log(spark, path)
    sl = S.log_time_slice(recs, "2024-03-01 10:00", "2024-03-01 10:01").collect()
    assert len(sl) == 2 and all(r["n_lines"] == 3 for r in sl)   # continuation lines follow their record
    _write(tmpdir_path, P.format(m="00", s="00", code="00000").replace("03-01", "03-02") + "LOG: x",
           "postgresql-2024-03-02.log")
    files = S.log_files_for_date(S.read_log_lines(spark, tmpdir_path), ["2024-03-02"]).collect()
    assert [os.path.basename(r["file"]) for r in files] == ["postgresql-2024-03-02.log"]


def test_records_across_chunks(spark):
    """Records split across chunk boundaries are reassembled (chunk windows + carry)."""
    rows = [("f", i // 2, i, line) for i, line in enumerate(LOG.splitlines())]
    lines = spark.createDataFrame(rows, "file string, chunk int, pos int, line string")
    recs = S.assemble_records(lines).orderBy("rec_pos").collect()
    assert len(recs) == 14 and [r["n_lines"] for r in recs][:3] == [3, 3, 1]


def test_segmented_scan_against_a_plain_loop(spark):
    """Any mix of files, splits and record lengths, in any spread over partitions and Arrow batches."""
    import random
    rng = random.Random(7)
    lines, want = [], []
    for f in ("a", "b", "c"):
        chunk, current = 0, None
        for i in range(400):
            if rng.random() < 0.05:
                chunk += 1
            start = rng.random() < (0.02 if f == "c" else 0.4)
            text = (f"2024-01-01 00:00:{i % 60:02d}.5 r{i}" if start else rng.choice(["", "  more", "é строка", "2024 not a start"])) + str(i % 7)
            lines.append((f, chunk, i, text))
            if start:
                current = [f, i, [text]]
                want.append(current)
            elif current:
                current[2].append(text)
    # one partition a (file, split) at least: splits of a file in any order, files side by side
    by_split = {}
    for row in lines:
        by_split.setdefault(row[:2], []).append(row)
    parts = list(by_split.values())
    rng.shuffle(parts)
    tasks = [[] for _ in range(6)]
    for k, p in enumerate(parts):
        tasks[k % 6].append(p)
    dealt = []
    for t in tasks:                                   # interleave the files of a task, each split in its own order
        queues = [list(p) for p in t]
        rows = []
        while any(queues):
            rows.append(rng.choice([q for q in queues if q]).pop(0))
        dealt.append(rows)
    sc = spark.sparkContext
    df = spark.createDataFrame(sc.parallelize(dealt, 6).flatMap(lambda r: r), "file string, chunk int, pos int, line string")
    exp = sorted((f, i, "\n".join(t), len(t)) for f, i, t in want)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("7", "100000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = S.assemble_records(df).select("file", "rec_pos", "record", "n_lines").collect()
            assert sorted(map(tuple, got)) == exp
            kept = S.assemble_records(df, r"r\d*[05]\d?$").select("file", "rec_pos", "record", "n_lines").collect()
            import re
            assert sorted(map(tuple, kept)) == [x for x in exp if re.search(r"r\d*[05]\d?$", x[2].split("\n")[0])]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_record_text_is_not_sorted_windowed_or_joined(spark):
    from tests.conftest import SF001
    df = S.assemble_records(S.log_lines(spark, SF001))
    plan = df._jdf.queryExecution().executedPlan().toString()
    whole = plan.split("Union")[1]
    whole = whole[:whole.index("HashAggregate") if "HashAggregate" in whole else whole.index("ObjectHashAggregate")]
    assert "Exchange" not in whole and "Sort" not in whole and "Join" not in plan


def test_slice_from_lines_and_first_splits(spark, tmpdir_path):
    path = _write(tmpdir_path, LOG)
    args = "2024-03-01 10:00", "2024-03-01 10:06"
    want = sorted(map(tuple, S.log_time_slice(S.read_server_log(spark, path), *args).collect()))
    lines = S.read_log_lines(spark, path)
    assert sorted(map(tuple, S.records_in_slice(lines, *args).collect())) == want and len(want) == 7
    assert S.records_in_slice(lines, *args, files=[]).count() == 0
    _write(tmpdir_path, P.format(m="00", s="00", code="00000").replace("03-01", "03-02") + "LOG: x", "postgresql-2024-03-02.log")
    got = S.log_files_for_date(S.first_split_lines(spark, tmpdir_path), ["2024-03-02"]).collect()
    assert [os.path.basename(r["file"]) for r in got] == ["postgresql-2024-03-02.log"]


def _events(spark, days, n=4):
    from pyspark.sql import functions as F
    rows = [(f"2024-03-{d:02d} 10:0{i}:00", f"t{d}-{i}") for d in days for i in range(n)]
    return spark.createDataFrame(rows, "t string, table_name string").select(F.to_timestamp_ntz("t").alias("curr_timestamp"), "table_name")


def test_event_store_imports_only_what_is_newer(spark, tmpdir_path):
    from waitwise.sources.eventstore import EventStore
    ev = _events(spark, [1])
    store = EventStore(spark, tmpdir_path + "/store", ev.schema)
    assert store.read().count() == 0 and store.imported_files() == []
    assert store.import_batch(1, ev, ["a.log"]).n_rows == 4
    assert store.import_batch(2, _events(spark, [1, 2]), ["a.log", "b.log"]).n_rows == 4     # day 1 is not stored twice
    assert store.import_batch(3, _events(spark, [1, 2])).n_rows == 0                          # an empty batch keeps the mark
    assert store.import_batch(4, _events(spark, [3])).n_rows == 4
    assert sorted(r["table_name"] for r in store.read().collect()) == [f"t{d}-{i}" for d in (1, 2, 3) for i in range(4)]
    assert store.imported_files() == ["a.log", "b.log"]
    pruned = store.read().filter("day = DATE'2024-03-02'")
    assert pruned.count() == 4 and "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()


def test_batch_killed_half_way_is_not_seen_and_repeats(spark, tmpdir_path, monkeypatch):
    import pytest
    from pyspark.sql import functions as F

    from waitwise.sources.eventstore import EventStore
    ev = _events(spark, [1, 2, 3]).repartition(4)
    store = EventStore(spark, tmpdir_path + "/store", ev.schema)
    store.import_batch(1, _events(spark, [1]))
    # a task dies while rows are written
    dying = ev.withColumn("table_name", F.when(F.col("table_name") == "t3-2", F.raise_error(F.lit("lost"))).otherwise(F.col("table_name")))
    with pytest.raises(Exception, match="lost"):
        store.import_batch(2, dying)
    assert store.read().count() == 4
    # the driver dies between the rows and the manifest
    with monkeypatch.context() as m:
        m.setattr(EventStore, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            store.import_batch(2, ev)
    assert store.read().count() == 4
    assert store.import_batch(2, ev).n_rows == 8
    assert store.read().count() == 12
    # the same batch again, though published: it replaces itself and its own mark does not hide its rows
    again = store.import_batch(2, ev)
    assert (again.n_rows, again.version) == (8, 2)
    assert sorted(r["table_name"] for r in store.read().collect()) == [f"t{d}-{i}" for d in (1, 2, 3) for i in range(4)]


def test_sqlstate_dim_from_file(spark, tmpdir_path):
    p = _write(tmpdir_path, "Class 00 — Successful Completion\n00000    successful_completion\n"
                            "40P01    deadlock_detected  some comment\nbad line", "codes.txt")
    got = [(r["code"], r["condition"]) for r in S.sqlstate_dim(spark, p).orderBy("ord").collect()]
    assert got == [("00000", "successful_completion"), ("40P01", "deadlock_detected")]


def test_error_counts_strict(spark, tmpdir_path):
    text = LOG + "\n" + P.format(m="14", s="00", code="40P01") + "STATEMENT:  select 'ERROR' from t"
    lines = S.read_log_lines(spark, _write(tmpdir_path, text))
    loose = {r["code"]: r["n"] for r in L.error_counts(lines, S.sqlstate_dim(spark)).collect()}
    strict = {r["code"]: r["n"] for r in L.error_counts(lines, S.sqlstate_dim(spark), strict=True).collect()}
    assert loose["40P01"] == 2 and strict["40P01"] == 1    # keyword inside a statement counts only loosely


def test_records_independent_of_chunking(spark):
    """Any chunking of the same lines assembles the same records (boundary fragments joined)."""
    from pyspark.sql import functions as F
    from tests.conftest import SF001
    lines = S.log_lines(spark, SF001).select("file", "pos", "line")
    ref = sorted(map(tuple, S.assemble_records(lines.withColumn("chunk", F.lit(0)))
                 .select("file", "rec_pos", "record").collect()))
    for k in (1, 2, 5, 97):
        got = sorted(map(tuple, S.assemble_records(lines.withColumn("chunk", F.floor(F.col("pos") / k)))
                     .select("file", "rec_pos", "record").collect()))
        assert got == ref


def test_files_for_date_newest_fallback(spark, tmpdir_path):
    _write(tmpdir_path, LOG.split("\n", 1)[1])     # first line is a record start
    _write(tmpdir_path, P.format(m="00", s="00", code="00000").replace("03-01", "03-02") + "LOG: x",
           "postgresql-2024-03-02.log")
    lines = S.read_log_lines(spark, tmpdir_path)
    assert S.log_files_for_date(lines, ["2024-05-01"]).count() == 0
    got = S.log_files_for_date(lines, ["2024-05-01"], fallback_newest=True).collect()
    assert [os.path.basename(r["file"]) for r in got] == ["postgresql-2024-03-02.log"]
    got = S.log_files_for_date(lines, ["2024-03-01"], fallback_newest=True).collect()
    assert [os.path.basename(r["file"]) for r in got] == ["postgresql-2024-03-01.log"]


def test_errors_of_the_whole_appendix_are_counted(spark, tmpdir_path):
    codes = ["42883", "22007", "25006", "55006", "23505", "22001"]
    text = "".join(f"2024-03-01 10:00:0{i}.000 MSK| u| app| d| h| 10| {c}| ERROR:  failed\n" for i, c in enumerate(codes))
    lines = S.read_log_lines(spark, _write(tmpdir_path, text))
    assert {r["code"]: r["n"] for r in L.error_counts(lines, S.sqlstate_dim(spark)).collect()} == dict.fromkeys(codes, 1)
    fields = S.log_prefix_fields(S.assemble_records(lines))
    assert sorted(r["sqlstate"] for r in L.known_errors(fields, S.sqlstate_dim(spark)).collect()) == sorted(codes)


def test_generated_code_of_logs_is_compiled(spark):
    # the JVM interprets methods of more than 8000 bytes: every line of a log then takes several times as long
    from tests.conftest import SF001
    lines = S.log_lines(spark, SF001)
    events = L.autovacuum_events(S.assemble_records(lines, L.is_autovacuum(F.col("line"))))
    newer = L.newer_than(events, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (lines, S.assemble_records(lines), newer):
            parts = df._jdf.queryExecution().debug().codegenToSeq().iterator()
            while parts.hasNext():
                assert parts.next()._3().maxMethodCodeSize() <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_autovacuum_fields_take_the_first_form_that_matches(spark):
    # a Russian text that does not match leaves the field to the English one; a missing field is null
    rec = 'автоматическая очистка таблицы "a.s.t": прошло: ? elapsed: 1.5 s, elapsed: 2 s, сканирований индекса: 3, index scans: 4'
    rows = [("f", dt.datetime(2024, 3, 1, 1, 2, 3, 900000), rec), ("f", None, 'automatic vacuum of table "d.t"'), ("f", None, "automatic vacuum of table x")]
    got = L.autovacuum_events(spark.createDataFrame(rows, "file string, ts timestamp_ntz, record string")).collect()
    assert sorted([tuple(r) for r in got], key=str) == sorted(
        [(dt.datetime(2024, 3, 1, 1, 2, 3), "a", "s", "t", 1500, 3, None, None), (None, "d", "public", "t", None, None, None, None)], key=str)
