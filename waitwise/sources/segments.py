"""Segmented scan: lines to multi-line records without sorting or windowing the text.

Lines come as (file, chunk, pos, line), a chunk being a file split: inside a partition the lines of a
(file, chunk) stand in file order. Each task walks its lines once and knows, per segment (the lines of one
(file, chunk) in the task), where records start. Every record that another start of the same segment closes is
complete and leaves the task as it is: its lines are one slice of the Arrow buffer. Two pieces a segment are open:
the continuation lines before its first start, and its last record. Only these boundary pieces are shuffled; a
running "last start" over the pieces of a file (at most two rows a segment) tells each leading piece its record.

Two passes over the lines, neither of which moves text between machines but for boundary pieces: one emits the
complete records, one the boundary pieces. Memory of a task: one Arrow batch and the open records of its segments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAD, TAIL = 0, 1


class _Open:
    """The open piece of a segment: the lines since its last start, or since its first line."""

    __slots__ = ("first", "keep", "lines", "parts", "pos", "started")

    def __init__(self, pos):
        self.first, self.pos, self.started, self.keep, self.lines, self.parts = pos, pos, False, True, 0, []

    def extend(self, data: np.ndarray, lines: int) -> None:
        self.parts.append(data.tobytes())
        self.lines += lines

    def reopen(self, pos, keep: bool) -> None:
        self.pos, self.started, self.keep, self.lines, self.parts = pos, True, keep, 0, []


def _walk(batches: Iterator[pa.RecordBatch], boundaries: bool) -> Iterator[pa.RecordBatch]:
    """Complete records, or the boundary pieces, of one task's lines.

    Columns in: file, chunk, pos, text (a line break and the line), start, keep.
    """
    segments: dict[tuple, _Open] = {}
    leads: list[tuple] = []
    schema = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        schema = batch.schema
        file, chunk = (batch.column(c).dictionary_encode() for c in ("file", "chunk"))
        code = np.asarray(file.indices, np.int64) * len(chunk.dictionary) + np.asarray(chunk.indices.fill_null(-1), np.int64) + 1
        if (code[1:] < code[:-1]).any():              # lines of several files side by side: group them, in order
            order = np.argsort(code, kind="stable")
            batch, code = batch.take(pa.array(order)), code[order]
        text = batch.column("text").cast(pa.large_binary())
        offs = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
        start, keep = (np.asarray(batch.column(c).fill_null(False)) for c in ("start", "keep"))
        run = np.concatenate([[True], code[1:] != code[:-1]])
        cut = np.flatnonzero(start | run)
        end = np.append(cut[1:], n)
        closed = np.append(~run[cut[1:]], False)      # the next piece is of the same segment, so a start closes this one
        done_first, done_text, done_lines = [], [], []
        for p in np.flatnonzero(run[cut] | ~closed):  # first and last piece of each segment in this batch
            lo, hi = int(cut[p]), int(end[p])
            key = (batch.column("file")[lo].as_py(), batch.column("chunk")[lo].as_py())
            piece = data[offs[lo]:offs[hi]]
            if run[lo]:
                now = segments.get(key)
                if now is None:
                    now = segments[key] = _Open(batch.column("pos").slice(lo, 1))
                if start[lo]:                         # closes what was open
                    if now.started and now.keep and not boundaries:
                        done_first.append((key[0], now.pos))
                        done_text.append(b"".join(now.parts))
                        done_lines.append(now.lines)
                    elif not now.started and now.lines and boundaries:
                        leads.append((key[0], now.first, now.pos, b"".join(now.parts), now.lines, LEAD, True))
                    now.reopen(batch.column("pos").slice(lo, 1), bool(keep[lo]))
                    if closed[p]:                     # and is closed itself: among the complete pieces below
                        continue
                    now.extend(piece, hi - lo)
                else:
                    now.extend(piece, hi - lo)
                    if closed[p]:
                        if now.started and now.keep and not boundaries:
                            done_first.append((key[0], now.pos))
                            done_text.append(b"".join(now.parts))
                            done_lines.append(now.lines)
                        elif not now.started and boundaries:
                            leads.append((key[0], now.first, now.pos, b"".join(now.parts), now.lines, LEAD, True))
            else:                                     # the last piece: a record that stays open
                now = segments[key]
                now.reopen(batch.column("pos").slice(lo, 1), bool(keep[lo]))
                now.extend(piece, hi - lo)
        if boundaries:
            continue
        whole = closed & start[cut] & keep[cut]
        if whole.any() or done_text:
            bounds = np.append(offs[cut], offs[n]) - offs[0]
            pieces = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(bounds), pa.py_buffer(data[offs[0]:offs[n]])])
            at = pa.array(cut[whole])
            yield _rows(schema, pa.concat_arrays([batch.column("file").take(at), pa.array([f for f, _ in done_first], batch.column("file").type)]),
                        pa.concat_arrays([batch.column("pos").take(at), *[p for _, p in done_first]]),
                        pa.concat_arrays([pieces.filter(pa.array(whole)), pa.array(done_text, pa.large_binary())]),
                        np.concatenate([(end - cut)[whole], np.array(done_lines, np.int64)]))
    if boundaries and schema is not None:
        leads += [(file, s.first, s.pos, b"".join(s.parts), s.lines, TAIL if s.started else LEAD, s.keep)
                  for (file, _), s in segments.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in leads], schema.field("file").type), pa.concat_arrays([x[1] for x in leads]), pa.concat_arrays([x[2] for x in leads]),
             pa.array([x[3] for x in leads], pa.binary()).cast(pa.string()), pa.array([x[4] for x in leads], pa.int64()),
             pa.array([x[5] for x in leads], pa.int32()), pa.array([x[6] for x in leads], pa.bool_())],
            names=["file", "seg_pos", "rec_pos", "text", "n_lines", "kind", "keep"])


def _rows(schema: pa.Schema, file: pa.Array, pos: pa.Array, text: pa.Array, lines: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([file, pos, text.cast(pa.large_string()).cast(pa.string()), pa.array(lines.astype(np.int64))],
                                      names=["file", "rec_pos", "text", "n_lines"])


def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, rec_pos, text, n_lines) of the records that a task sees whole."""
    return _walk(batches, False)


def boundary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, seg_pos, rec_pos, text, n_lines, kind, keep) of the pieces that other segments may complete."""
    return _walk(batches, True)


def prepared(lines: DataFrame, is_start: Column, keep: Column | None = None, arrived: bool = False) -> DataFrame:
    """(file, chunk, pos, text, start, keep): what a task walks. Lines that open a record which is not kept lose
    their text before they leave the JVM. With ``arrived`` the file's name is followed by a bar and its time of
    arrival in microseconds."""
    keep = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    gone = is_start & ~keep
    text = F.when(gone, F.lit("")).otherwise(F.concat(F.lit("\n"), F.coalesce(F.col("line"), F.lit(""))))
    file = F.format_string("%s|%d", "file", F.unix_micros("arrived")).alias("file") if arrived else F.col("file")
    return lines.select(file, "chunk", "pos", text.alias("text"), is_start.alias("start"), keep.alias("keep"))


def boundary_pieces(marked: DataFrame) -> DataFrame:
    """At most two rows a segment: (file, seg_pos, rec_pos, text, n_lines, kind, keep)."""
    pos = marked.schema["pos"].dataType.simpleString()
    return marked.mapInArrow(boundary, f"file string, seg_pos {pos}, rec_pos {pos}, text string, n_lines long, kind int, keep boolean")


def stitched(pieces: DataFrame) -> DataFrame:
    """Records from boundary pieces: each leading piece goes to the last record started before it in its file;
    pieces before any start belong to no record."""
    # two rows a split of the file, whatever the length of the records
    before = Window.partitionBy("file").orderBy("seg_pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owned = pieces.withColumn("own", F.last(F.when(F.col("kind") == TAIL, F.struct("rec_pos", "keep")), ignorenulls=True).over(before))
    owned = owned.filter("own.keep").select("file", F.col("own.rec_pos").alias("rec_pos"), "seg_pos", "kind", "text", "n_lines")
    return owned.groupBy("file", "rec_pos").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "kind", "text"))), lambda x: x["text"]), "").alias("text"),
        F.sum("n_lines").alias("n_lines"))


def records(lines: DataFrame, is_start: Column, keep: Column | None = None) -> DataFrame:
    """(file, rec_pos, record, n_lines): lines from one for which ``is_start`` holds to the next, joined by line
    breaks; only records whose first line satisfies ``keep``. Lines before the first start of a file are dropped."""
    marked = prepared(lines, is_start, keep)
    pos = marked.schema["pos"].dataType.simpleString()
    whole = marked.mapInArrow(complete, f"file string, rec_pos {pos}, text string, n_lines long")
    both = whole.unionByName(stitched(boundary_pieces(marked)))
    return both.select("file", "rec_pos", F.substr(F.col("text"), F.lit(2)).alias("record"), "n_lines")
