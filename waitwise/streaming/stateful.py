"""Streaming operators on arbitrary keyed state.

All three use ``transformWithStateInPandas`` with event-time timers, which needs the RocksDB state store
(``use_rocksdb``): state lives on executor disk with its changelog in the query's checkpoint folder, so it is
bounded by disk, not heap, and a lost executor reloads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from waitwise.sources import segments
from waitwise.sources import serverlog as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of queries started from now on in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


# --------------------------------------------------------------------------- F4: transitions

class _Transitions(StatefulProcessor):
    """Rows wait until the watermark has passed them, then leave in order of time."""

    def __init__(self, ttl_ms: int):
        self._ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "ts timestamp, state int")
        self._waiting = handle.getMapState("waiting", "ts timestamp", "state int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self._last.get()
        for pdf in rows:
            for ts, state in zip(pdf["ts"], pdf["state"]):
                # of rows with one timestamp the smallest state counts, whatever the order of arrival
                if last is None or ts > last[0]:
                    held = self._waiting.getValue((ts,))
                    if held is None or int(state) < held[0]:
                        self._waiting.updateValue((ts,), (int(state),))
        yield from self._leave(key, timerValues, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self._last.get()
        # the built-in time to live counts processing time, so silence in event time is a timer of its own
        if last is not None and _ms(last[0]) + self._ttl_ms <= expiredTimerInfo.getExpiryTimeInMs() and not self._waiting.exists():
            self._last.clear()
            return
        yield from self._leave(key, timerValues, last)

    def _leave(self, key, timers, last) -> Iterator[pd.DataFrame]:
        passed = timers.getCurrentWatermarkInMs()
        waiting = sorted((k[0], v[0]) for k, v in self._waiting.iterator())
        out = []
        for ts, state in waiting:
            if _ms(ts) > passed:
                self._handle.registerTimer(_ms(ts))
                break
            if last is not None:
                out.append((key[0], ts, last[1], state))
            last = (ts, state)
            self._waiting.removeKey((ts,))
        if last is not None:
            self._last.update(last)
            self._handle.registerTimer(_ms(last[0]) + self._ttl_ms)
        if out:
            yield pd.DataFrame(out, columns=["cluster", "ts", "from_state", "to_state"]).astype({"from_state": "int32", "to_state": "int32"})


def stream_transitions_ordered(states: DataFrame, delay: str = "2 hours", ttl_days: int = 30) -> DataFrame:
    """(cluster, ts, from_state, to_state) of consecutive states (M3), from rows in any order within ``delay``.

    A row is held until the watermark (latest time seen less ``delay``) has passed it; rows later than that are
    dropped, as the watermark promises. A cluster that stays silent for ``ttl_days`` loses its state: its next
    row opens a new chain.
    """
    s = states.select("cluster", F.col("ts").cast("timestamp").alias("ts"), F.col("state").cast("int").alias("state")).withWatermark("ts", delay)
    return s.groupBy("cluster").transformWithStateInPandas(
        _Transitions(ttl_days * DAY_MS), "cluster string, ts timestamp, from_state int, to_state int", "append", "EventTime")


# --------------------------------------------------------------------------- F2: rolling medians by panes

class _Panes(StatefulProcessor):
    """Each pane (a slide) is held once as value -> count; a window is the merge of its panes."""

    def __init__(self, length_ms: int, slide_ms: int):
        self._length, self._slide = length_ms, slide_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._counts = handle.getMapState("panes", "pane long, value double", "n long")
        self._next = handle.getValueState("next", "at long")       # end of the first window not given out yet

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        following = self._next.get()
        for pdf in rows:
            at = (pdf["ts"].to_numpy().astype("datetime64[ms]").astype(np.int64) // self._slide) * self._slide
            for (pane, value), n in pdf.groupby([at, pdf["value"].to_numpy()]).size().items():
                k = (int(pane), float(value))
                held = self._counts.getValue(k)
                self._counts.updateValue(k, (int(n) + (held[0] if held else 0),))
            first = int(at.min()) + self._slide
            if following is None or first < following[0]:
                following = (first,)
        if following is not None:
            self._next.update(following)
        yield from self._close(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._close(key, timerValues)

    def _close(self, key, timers) -> Iterator[pd.DataFrame]:
        passed, following = timers.getCurrentWatermarkInMs(), self._next.get()
        if following is None:
            return
        held = sorted((k[0], k[1], v[0]) for k, v in self._counts.iterator())
        if not held:
            return
        pane, value, n = (np.array(x) for x in zip(*held))
        end, out = following[0], []
        last = int(pane[-1]) + self._length           # beyond it every window is empty
        while end <= min(passed, last):
            inside = (pane >= end - self._length) & (pane < end)
            if inside.any():
                out.append((key[0], pd.Timestamp(end - self._length, unit="ms"), pd.Timestamp(end, unit="ms"), _median(value[inside], n[inside]), int(n[inside].sum())))
                end += self._slide
            else:                                     # a gap: on to the first window of the next pane
                later = pane[pane >= end]
                end = int(later[0]) + self._slide if len(later) else last + self._slide
        for k in sorted({int(p) for p in pane if p < end - self._length}):
            for v in value[pane == k]:
                self._counts.removeKey((k, float(v)))
        self._next.update((end,))
        if end <= last:
            self._handle.registerTimer(end)
        if out:
            yield pd.DataFrame(out, columns=["cluster", "start", "end", "med", "n"])


def _median(value: np.ndarray, n: np.ndarray) -> float:
    """Exact median of a multiset: the mean of the middle two when the count is even."""
    order = np.argsort(value)
    value, upto = value[order], np.cumsum(n[order])
    total = int(upto[-1])
    low, high = (value[np.searchsorted(upto, k, "right")] for k in ((total - 1) // 2, total // 2))
    return (float(low) + float(high)) / 2


def _span_ms(text: str) -> int:
    return int(pd.Timedelta(text).total_seconds() * 1000)


def stream_rolling_median_panes(samples: DataFrame, length: str = "60 minutes", slide: str = "1 minute", delay: str = "2 minutes") -> DataFrame:
    """the median of the samples in [end - length, end), given out at each slide once the watermark has passed ``end``.

    ``samples`` has cluster, ts, value. A sample is in state once, as one count of its value in its pane, whatever
    length / slide is. On a minute series (one value a cluster and minute) the window that ends a minute after t is
    the trailing median at t over the last ``length`` less one slide (B1).
    """
    s = samples.select("cluster", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).withWatermark("ts", delay)
    return s.groupBy("cluster").transformWithStateInPandas(
        _Panes(_span_ms(length), _span_ms(slide)), "cluster string, start timestamp, end timestamp, med double, n long", "append", "EventTime")


# --------------------------------------------------------------------------- F5: log import

def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits with their place: the split's start and the number of the line inside it."""
    seen: dict[tuple, int] = {}
    for b in batches:
        file, chunk = b.column("file").dictionary_encode(), np.asarray(b.column("chunk"), np.int64)
        names = np.asarray(file.indices, np.int64)
        run = np.flatnonzero(np.concatenate([[True], (names[1:] != names[:-1]) | (chunk[1:] != chunk[:-1])])) if len(b) else np.zeros(0, np.int64)
        number = np.arange(len(b))
        for lo, hi in zip(run.tolist(), [*run[1:].tolist(), len(b)]):
            key = (file.dictionary[int(names[lo])].as_py(), int(chunk[lo]))
            number[lo:hi] += seen.get(key, 0) - lo
            seen[key] = int(number[hi - 1]) + 1
        pos = pa.StructArray.from_arrays([pa.array(chunk), pa.array(number)], names=["c", "r"])
        yield pa.RecordBatch.from_arrays([*b.columns, pos], names=[*b.schema.names, "pos"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return segments.complete(_numbered(batches))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return segments.boundary(_numbered(batches))


class _OpenRecord(StatefulProcessor):
    """The unfinished record of a log, across files and micro-batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "name string, arrived timestamp, text string")
        self._files = handle.getMapState("files", "name string", "arrived timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pieces = pd.concat(list(rows), ignore_index=True)          # at most two a split of the files that have arrived
        known = {n for n in pieces["name"].unique() if self._files.containsKey((n,))}
        for name, arrived in list(self._files.iterator()):         # too old to come again
            if _ms(arrived[0]) < timerValues.getCurrentWatermarkInMs():
                self._files.removeKey(name)
        pieces = pieces[~pieces["name"].isin(known)]
        # a file that has come twice at once counts by its first path
        pieces = pieces[pieces["file"] == pieces.groupby("name")["file"].transform("min")]
        held, out = self._open.get(), []
        for p in pieces.sort_values(["name", "chunk", "kind"]).itertuples(index=False):
            if held is not None and p.name < held[0]:              # a file older than the open record: its own end closes its records
                if p.kind == segments.TAIL:
                    out.append((key[0], p.name, p.arrived, p.text))
            elif p.kind == segments.TAIL:
                if held is not None:
                    out.append((key[0], held[0], p.arrived, held[2]))
                held = (p.name, p.arrived, p.text)
            elif held is not None:
                held = (p.name, p.arrived, held[2] + p.text)
        for p in pieces.drop_duplicates("name").itertuples(index=False):
            self._files.updateValue((p.name,), (p.arrived,))
        if held is not None:
            self._open.update(held)
            self._handle.registerTimer(_ms(held[1]))
        yield from self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, passed = self._open.get(), timerValues.getCurrentWatermarkInMs()
        if held is not None and _ms(held[1]) <= passed:            # nothing has followed for long: the record is complete
            self._open.clear()
            yield from self._rows([(key[0], held[0], pd.Timestamp(passed + 1, unit="ms"), held[2])])

    @staticmethod
    def _rows(out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["log", "name", "arrived", "text"])


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of log files arriving under ``path`` (all folders): file, chunk (split), arrived (modification time), line."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true")
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("chunk"),
                                    F.col("_metadata.file_modification_time").alias("arrived"), F.col("value").alias("line"))


def stream_log_records(lines: DataFrame, repeat: str = "7 days", log: Column | None = None) -> DataFrame:
    """(log, name, arrived, ts, record) of the records of arriving log files, each once.

    ``lines`` is like ``stream_lines``. Files of one ``log`` (a Column of ``file``; by default the folder) follow
    each other by name, as rotated files do. Records inside a split are assembled where they are read; a record that
    is cut between splits, files or micro-batches is put together in the state of its log, which gets two pieces a
    split at most. The last record of a log comes out when the next one starts, or once files newer by ``repeat``
    have arrived. A file that is delivered again (under its name, in any folder of its log) within ``repeat`` adds
    nothing; records of a log that are equal to the last character (they carry their time and process) count once in
    that span. Lines before the first record of a log are dropped.
    """
    log = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1) if log is None else log
    marked = segments.prepared(lines.withColumn("pos", F.lit(0)), F.col("line").rlike(S.START_RE), arrived=True).drop("pos")
    place = "struct<c:bigint,r:bigint>"

    def read(fn, schema: str) -> DataFrame:
        rows = marked.mapInArrow(fn, schema)
        rows = rows.withColumn("path", F.regexp_extract("file", r"^(.*)\|\d+$", 1)).withColumn(
            "arrived", F.timestamp_micros(F.regexp_extract("file", r"\|(\d+)$", 1).cast("long")))
        return rows.withColumn("log", log).withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withWatermark("arrived", repeat)

    whole = read(_whole, f"file string, rec_pos {place}, text string, n_lines long").select("log", "name", "arrived", "text")
    pieces = read(_pieces, f"file string, seg_pos {place}, rec_pos {place}, text string, n_lines long, kind int, keep boolean")
    cut = pieces.select("log", "name", F.col("path").alias("file"), F.col("seg_pos.c").alias("chunk"), "kind", "arrived", "text").groupBy("log").transformWithStateInPandas(
        _OpenRecord(), "log string, name string, arrived timestamp, text string", "append", "EventTime", eventTimeColumnName="arrived")
    rows = whole.unionByName(cut).withColumn("digest", F.sha2("text", 256)).dropDuplicatesWithinWatermark(["log", "digest"])
    record = F.substr(F.col("text"), F.lit(2))
    return rows.select("log", "name", "arrived", S.line_ts(record).alias("ts"), record.alias("record"))
