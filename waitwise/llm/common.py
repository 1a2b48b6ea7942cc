"""Shared helpers of the corpus operators: shared-folder tables, Arrow text blocks, substring
hashes, and a fixed-size Bloom filter that keeps joins on documents from moving every text."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waitwise.session import checkpoint_dir

#: Texts are handled in blocks of about this many bytes, so a task's memory does not depend on the batch.
BLOCK_BYTES = 1 << 18

#: Rows travel to Python in Arrow batches of about this many bytes. Both ends hold a batch whole (the JVM in buffers of
#: up to twice its size, and the half as large ones they grew from), in every task at once.
BATCH_BYTES = 4 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; listed anew on every call, so appended files are seen."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet under the folder in ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage for steps that read a frame more than once; the files are on storage that
    every executor sees, so a lost executor costs a re-read and no recomputation.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete the files of ``stored`` frames that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files and checkpoints of finished steps go: Spark removes them once the driver's garbage is
    collected, which a driver with little to do may put off for the whole of a long operator."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bound_batches(spark: SparkSession) -> None:
    """Batches of ``BATCH_BYTES`` instead of Spark's 64 MB; a setting that the session has already stays.

    Plans read it when they run, so it is not taken back when an operator returns its frame.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


# --------------------------------------------------------------------------- Arrow text blocks

def text_blocks(col: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null counts as empty.

    A row longer than ``max_bytes`` is a block of its own: texts are never cut.
    """
    col = col.cast(pa.large_binary()).fill_null(b"")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(col)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)          # 5 modulo 8: powers have the longest period modulo 2**64
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for key, base in (("p", _BASE), ("q", _BASE_INV)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[key] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift-multiply rounds), so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class SubstringHash:
    """64-bit hashes of any substrings of a byte block, from one pass of prefix sums."""

    def __init__(self, buf: np.ndarray):
        p, self._q = _powers(len(buf) + 1)
        self._s = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * p[:len(buf)], out=self._s[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._s[end] - self._s[start]) * self._q[start])


_P31 = np.uint64(2**31 - 1)
_LANES = [(int(_RNG.integers(2**20, 2**31 - 2)), _RNG.integers(1, 2**31 - 1, 256, dtype=np.uint64)) for _ in range(2)]
_PRIME_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _fold31(x: np.ndarray) -> np.ndarray:
    """Congruent modulo 2**31 - 1, and smaller: below 2**32 for anything below 2**62."""
    return (x & _P31) + (x >> np.uint64(31))


def _modular_powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        k = min(done, size - done)
        out[done:done + k] = _fold31(_fold31(out[:k] * np.uint64(pow(base, done, int(_P31)))))
        done += k
    return out


def _prime_powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _PRIME_POWERS or len(_PRIME_POWERS[0][0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        _PRIME_POWERS[:] = [(_modular_powers(b, size), _modular_powers(pow(b, -1, int(_P31)), size)) for b, _ in _LANES]
    return _PRIME_POWERS


class PrimeHash:
    """Hashes of any substrings of a byte block, from one pass of prefix sums.

    Two independent polynomials modulo the prime 2**31 - 1: modulo a power of two, some long strings of two
    letters collide for every base. Texts of less than 4 GB.
    """

    def __init__(self, buf: np.ndarray):
        self._lanes = []
        for (power, inverse), (_, symbol) in zip(_prime_powers(len(buf) + 1), _LANES):
            sums = np.zeros(len(buf) + 1, np.uint64)
            np.cumsum(_fold31(symbol[buf] * power[:len(buf)]), out=sums[1:])
            self._lanes.append((sums, inverse))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (_fold31(_fold31(_fold31(_fold31(_fold31(s[end] - s[start])) * inverse[start]))) for s, inverse in self._lanes)
        a, b = (np.where(x >= _P31, x - _P31, x) for x in (a, b))
        return mix((a << np.uint64(31)) | b)


# --------------------------------------------------------------------------- bounded Bloom filter

BLOOM_BITS = 1 << 22


def bloom_positions(key: Column, bits: int, probes: int = 2) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(probes)]


def maybe_in(ids: DataFrame, id_col: str, key: Column, bits: int = BLOOM_BITS) -> Column:
    """True for every key that is among ``ids``, and for a few that are not.

    The filter has a fixed size (``bits``), whatever the number of ids: it travels as a scalar
    subquery of ``bits`` / 8 bytes. Past its capacity it only lets more rows through; every use
    is followed by an exact join, so results never depend on it.
    """
    spark = ids.sparkSession
    pos = ids.select(F.explode(F.array(*bloom_positions(F.col(id_col), bits))).alias("b"))
    words = pos.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 as int))").alias("v"))
    zero = spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    dense = words.unionByName(zero).groupBy("w").agg(F.bit_or("v").alias("v"))
    packed = dense.agg(F.array_sort(F.collect_list(F.struct("w", "v"))).alias("a")).select(F.col("a.v"))
    arr = packed.scalar()
    hits = [F.getbit(F.element_at(arr, (F.shiftright(b, 6) + 1).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
            for b in bloom_positions(key, bits)]
    return F.coalesce(reduce(lambda a, b: a & b, hits), F.lit(False))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def without_ids(docs: DataFrame, drop: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id is in ``drop``: only rows that may be in it are shuffled.

    Rows with a null id stay; extra columns pass through.
    """
    hit = maybe_in(drop, id_col, F.col(id_col))
    sure = docs.filter(~hit | F.col(id_col).isNull())
    unsure = docs.filter(hit & F.col(id_col).isNotNull()).join(drop.select(id_col).distinct(), id_col, "left_anti")
    return sure.unionByName(unsure.select(*docs.columns))
