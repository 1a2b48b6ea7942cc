"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``window`` consecutive benchmark words (an item with fewer words is one
window). Texts and patterns are read as word numbers. Per pattern length, a shift table says for
each block of two words how far the search may skip, a suffix-hash bucket selects the patterns that
end in the block, and a direct comparison confirms each occurrence.

Edge cases: null or empty texts have no words and no hits; items without words have no window;
repeated items or rows are matched alike; items without an id are searched too and count as one item, which
the list of ids leaves out; empty tables give empty results; extra columns of the
documents pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwise.llm.common import bound_batches

WINDOW = 10
#: Benchmark text held by a task at once; a larger benchmark is searched for in several such parts.
MAX_PART_BYTES = 8 << 20

#: A-Z to a-z; every other ASCII byte outside 0-9 and a-z separates words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.translate(_WORDS).split()


class WuManber:
    """Search tables of one set of equally long patterns (tuples of word numbers)."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[tuple[tuple[int, ...], list[int]]]] = defaultdict(list)
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                code = self.code(pattern, end)
                self.shift[code] = min(self.shift.get(code, self.skip), length - end)
            self.bucket[self.code(pattern, length)].append((pattern, items))

    def code(self, words, end: int) -> int:
        return words[end - 1] if self.block == 1 else (words[end - 2] << 32) | words[end - 1]

    def search(self, words: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of every occurrence."""
        end, n, shift, skip = self.length, len(words), self.shift, self.skip
        two = self.block == 2
        while end <= n:
            code = (words[end - 2] << 32) | words[end - 1] if two else words[end - 1]
            step = shift.get(code, skip)
            if step:
                end += step
                continue
            start = end - self.length
            window = tuple(words[start:end])
            for pattern, items in self.bucket[code]:
                if pattern == window:
                    yield start, items
            end += 1


class Patterns:
    """Word numbers and search tables of a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], window: int):
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[int, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            nums = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            size = min(window, len(nums))
            for i in range(len(nums) - size + 1 if size else 0):
                ids = by_length[size][tuple(nums[i:i + size])]
                if not ids or ids[-1] != item_id:
                    ids.append(item_id)
        self.tables = [WuManber(n, dict(p)) for n, p in sorted(by_length.items())]

    def find(self, text: str | bytes | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, merged hit spans in words, items with an occurring window."""
        words = words_of(text)
        get = self.number.get
        nums = [get(w, 0) for w in words]
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for t in self.tables:
            for start, ids in t.search(nums):
                spans.append((start, start + t.length))
                items.update(ids)
        return len(words), merge_spans(spans), items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_SPANS = T.ArrayType(T.ArrayType(T.IntegerType()))
_OUT = [("n_words", pa.int64(), T.LongType()), ("hit_spans", pa.list_(pa.list_(pa.int32())), _SPANS),
        ("hit_items", pa.list_(pa.int64()), T.ArrayType(T.LongType()))]


def _benchmark_parts(benchmark: DataFrame, max_bytes: int) -> Iterator[list[tuple[int | None, str]]]:
    """Items in parts of at most ``max_bytes`` of text (one longer item is a part of its own)."""
    part: list[tuple[int, str]] = []
    size = 0
    rows = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        n = len(r["text"].encode())
        if part and size + n > max_bytes:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    yield part


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_part_bytes: int = MAX_PART_BYTES,
                   keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (``text`` only if ``keep_text``) plus n_words, hit_spans (merged [start, end)
    in words) and hit_items (sorted; a null last if an item without an id occurs).

    One pass over the documents per part of the benchmark, with no shuffle; the part's tables are the
    only thing broadcast and bounded by ``max_part_bytes``. Between parts the result is checkpointed,
    so only one part's tables are alive at a time.
    """
    names = [n for n, _, _ in _OUT]
    bound_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    found = docs.drop(*names)
    parts = _benchmark_parts(benchmark, max_part_bytes)
    part, k = next(parts), 0
    while part is not None:
        following = next(parts, None)
        carry = [f for f in found.schema.fields if f.name not in names and (keep_text or following is not None or f.name != "text")]
        schema = T.StructType(carry + [T.StructField(n, t) for n, _, t in _OUT])
        held = sc.broadcast(part)
        found = found.mapInArrow(_searcher(held, window, [f.name for f in carry], first=k == 0), schema)
        if following is not None:
            found = found.checkpoint()
        part, k = following, k + 1
    return found


def _searcher(held, window: int, carry: list[str], first: bool):
    """mapInArrow function that adds the occurrences of one part of the benchmark to what is known."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(held.value, window)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                n_words, spans, items = [], [], []
                for j, x in enumerate(piece.column("text").cast(pa.binary())):
                    n, s, ids = patterns.find(x.as_py())
                    if not first:
                        s = merge_spans(s + [tuple(p) for p in piece.column("hit_spans")[j].as_py()])
                        ids |= set(piece.column("hit_items")[j].as_py())
                    n_words.append(n)
                    spans.append(s)
                    items.append(sorted(ids - {None}) + [None] * (None in ids))
                arrays = [piece.column(c) for c in carry] + [pa.array(v, t) for v, (_, t, _) in zip((n_words, spans, items), _OUT)]
                yield pa.RecordBatch.from_arrays(arrays, names=carry + [n for n, _, _ in _OUT])
    return search


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (F.element_at(s, 2) - F.element_at(s, 1)))
    ids = F.array_join(F.array_sort(F.transform("hit_items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(ids, 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, columns as given."""
    found = find_benchmark(docs.select("*"), benchmark, window)
    return found.filter(F.size("hit_spans") == 0).select(*docs.columns)
