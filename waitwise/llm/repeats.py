"""Removal of repeated byte strings by sparse, distributed prefix doubling.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the corpus
(matches never cross documents). Prefix doubling over every byte would sort one row a byte and round; here the
sorted positions are anchors: the smallest hash of 16 bytes in each window of 64 (about one position in 32).
Each start of a ``LENGTH``-byte string belongs to the anchor of its first 64 bytes, and equal strings have equal
anchors at equal distances, so no repeat is missed.

Rounds over anchors, in one sort by rank pairs at growing offsets: (1) the rank of the first 68 bytes; positions
unique so far are dropped; (2) pairs with the rank of the next 68 bytes, dropped if unique; (3) pairs with the whole
context of all starts of the anchor. A context that occurs twice settles all its starts. Where a class still holds
unsettled members, the single starts (past the threshold now) are ranked by all their ``LENGTH`` bytes.
Ranks are named by 64-bit hashes of the bytes, so no global numbering is needed.

Equal texts are one text with a count: a text of at least ``LENGTH`` bytes that occurs twice goes as a whole.

Edge cases: null and empty texts have no bytes; shorter texts than ``LENGTH`` keep all; repeated rows count as
copies; texts are read whole; an empty table gives an empty result; extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitwise.llm.common import SubstringHash, maybe_in, stored, text_blocks, without_ids

LENGTH = 200
GRAM, REACH, HALF = 16, 64, 68          # anchor hash, anchor window, offset of the rank pair
_PLACE_BITS = 28                        # places in a block below the hash bits of an anchor key


def starts_of(offs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """All positions at which a string of ``length`` bytes fits into its text."""
    count = np.maximum(np.diff(offs) - length + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64)
    begin = np.cumsum(count) - count
    return np.repeat(offs[:-1] - begin, count) + np.arange(count.sum())


def anchors(buf: np.ndarray, offs: np.ndarray, hashed: SubstringHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start) of every run of starts that share an anchor."""
    starts = starts_of(offs)
    if not len(starts):
        return starts, starts, starts
    at = np.arange(len(buf) - GRAM + 1)
    key = (hashed(at, at + GRAM) >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | at.astype(np.uint64)
    width = 1
    while width < REACH:                                   # sliding minimum over REACH places
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    place = (key[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = np.append(cut[1:], len(starts)) - 1
    return place[cut], starts[cut], starts[last]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text_ids = b.column("tid").to_numpy()
        for i, j, buf, offs in text_blocks(b.column("text")):
            hashed = SubstringHash(buf)
            place, lo, hi = anchors(buf, offs, hashed)
            row = np.searchsorted(offs, lo, "right") - 1
            start = lo - offs[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(text_ids[i:j][row]), pa.array(hashed(place, place + HALF).view(np.int64)),
                pa.array((hashed(place + HALF, place + 2 * HALF) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                pa.array(hashed(lo, hi + LENGTH).view(np.int64)), pa.array((start << 6) | (hi - lo))],
                names=["tid", "first", "second", "context", "place"])


def _start_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank of LENGTH bytes, tid, start * 2 + 1 if its status is asked for) of the published runs."""
    for b in batches:
        text_ids, places, asked = b.column("tid").to_numpy(), b.column("places"), b.column("asked")
        for i, j, buf, offs in text_blocks(b.column("text")):
            hashed = SubstringHash(buf)
            for r in range(i, j):
                p, ask = places[r].values.to_numpy(), asked[r].values.to_numpy(zero_copy_only=False)
                lo, n = p >> 6, (p & 63) + 1
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                here = at + offs[r - i]
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashed(here, here + LENGTH).view(np.int64)), pa.array(np.full(len(at), text_ids[r])),
                    pa.array(at * 2 + np.repeat(ask, n))], names=["rank", "tid", "place"])


def _with_tid(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tid"))


def text_classes(docs: DataFrame) -> DataFrame:
    """(tid, n_bytes, crc) of the distinct texts with their count; equal texts are told by all three."""
    return (_with_tid(docs).select("doc_id", "tid", F.octet_length("text").cast("long").alias("n_bytes"), F.crc32("text").alias("crc"))
            .groupBy("tid", "n_bytes", "crc").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("owner")))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tid, spans) of the texts that share strings of LENGTH bytes, spans as start and end pairs of bytes that
    may overlap; and the text classes."""
    classes = stored(text_classes(docs), "repeat-classes")
    # one row of each text takes part; which ones do not is known by the hash of id and text
    named = _with_tid(docs).withColumn("row", F.xxhash64("doc_id", "text"))
    again = classes.filter("n > 1").select("tid", "owner")
    copies = (named.select("doc_id", "tid", "row").filter(maybe_in(again, "tid", F.col("tid"))).join(again, "tid")
              .filter(F.col("doc_id") != F.col("owner")).select("row").distinct())
    texts = without_ids(named, stored(copies, "repeat-copies"), "row").select("tid", "text")

    rows = texts.mapInArrow(_anchor_rows, "tid long, first long, second int, context long, place long")
    first, second, context = W.partitionBy("first"), W.partitionBy("first", "second"), W.partitionBy("first", "second", "context")
    one = F.count(F.lit(1))
    ranked = (rows.repartition("first").sortWithinPartitions("first", "second", "context", "tid", "place")
              .withColumn("n", one.over(first)).filter("n > 1")
              .withColumn("n", one.over(second)).filter("n > 1")
              .withColumn("n", one.over(context)).withColumn("settled", F.col("n") > 1)
              .withColumn("k", F.row_number().over(context.orderBy("tid", "place")))
              .withColumn("open", ~F.min("settled").over(second)))
    # of settled members with one context, one speaks for all to the unsettled ones
    marks = stored(ranked.select("tid", "place", "settled", (~F.col("settled") | (F.col("open") & (F.col("k") == 1))).alias("speaks")), "repeat-marks")

    published = (marks.filter("speaks").groupBy("tid")
                 .agg(F.collect_list(F.struct("place", (~F.col("settled")).alias("asked"))).alias("m"))
                 .select("tid", F.col("m.place").alias("places"), F.col("m.asked").alias("asked")))
    published = stored(published, "repeat-published")
    involved = texts.filter(maybe_in(published, "tid", F.col("tid"))).join(published, "tid").select("tid", "text", "places", "asked")
    starts = stored(involved.mapInArrow(_start_rows, "rank long, tid long, place long"), "repeat-starts")
    twice = starts.groupBy("rank").agg(one.alias("n")).filter("n > 1").select("rank")
    found = starts.filter("place % 2 = 1").join(twice, "rank").select("tid", F.expr("place div 2").alias("s"), F.expr(f"place div 2 + {LENGTH}").alias("e"))
    whole = marks.filter("settled").select("tid", F.shiftright("place", 6).alias("s"), (F.shiftright("place", 6) + F.col("place").bitwiseAND(F.lit(63)) + LENGTH).alias("e"))
    spans = found.unionByName(whole).groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    return spans, classes


def merged(spans) -> list[tuple[int, int]]:
    """Sorted (start, end) pairs as maximal runs."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed runs as arrays [start, end)), kept (the bytes left) of every row.

    Only texts that may lose bytes are shuffled to their spans; the others keep everything where they lie.
    """
    spans, classes = find_repeats(docs)
    spans = stored(spans, "repeat-spans")
    gone = classes.filter(f"n > 1 AND n_bytes >= {LENGTH}").select("tid", "n_bytes", "crc", F.lit(True).alias("gone"))
    named = _with_tid(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    hit = maybe_in(spans.select("tid").unionByName(gone.select("tid")), "tid", F.col("tid"))
    no_span = F.array().cast("array<array<long>>")
    sure = named.filter(~hit).select("doc_id", "n_bytes", no_span.alias("spans"), F.col("text").cast("binary").alias("kept"))
    joined = (named.filter(hit).withColumn("crc", F.crc32("text")).join(gone, ["tid", "n_bytes", "crc"], "left")
              .join(spans, "tid", "left").select("doc_id", "n_bytes", F.when(F.col("gone"), F.lit("")).otherwise(F.col("text")).alias("text"), "gone", "spans"))
    unsure = joined.mapInArrow(_cut, "doc_id long, n_bytes long, spans array<array<long>>, kept binary")
    return sure.unionByName(unsure)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            piece = b.slice(i, 256)
            runs, kept = [], []
            for n, text, gone, spans in zip(*(piece.column(c) for c in ("n_bytes", "text", "gone", "spans"))):
                if gone.as_py():
                    runs.append([(0, n.as_py())])
                    kept.append(b"")
                    continue
                raw = text.as_buffer().to_pybytes()
                cut = []
                if spans.is_valid:
                    v = spans.values
                    cut = merged(zip(v.field("s").to_pylist(), v.field("e").to_pylist()))
                ends = [0, *(x for run in cut for x in run), len(raw)]
                runs.append(cut)
                kept.append(b"".join(raw[s:e] for s, e in zip(ends[::2], ends[1::2])))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), pa.array(runs, pa.list_(pa.list_(pa.int64()))),
                                              pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def removal_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (F.element_at(s, 2) - F.element_at(s, 1)))
    return remove_repeats(docs).select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                                       F.sha2("kept", 256).alias("kept_sha256"))
