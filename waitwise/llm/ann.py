"""Nearest neighbours by randomly rotated one-bit codes.

Each vector, less the corpus mean, is scaled to length 1 and turned by a random rotation; the signs
are its code (one bit a dimension, packed), and two scalars correct the estimate: the length that
was divided out and the inner product of the vector with its own code. A query is turned alike and
quantised to ``QUERY_BITS`` bits, so estimated inner products need bit counts only. The estimator's
error bound gives an interval for each pair; a vector is reranked by its exact inner product when its
upper bound reaches the k-th best exact product among the best estimates of its query.

Queries go out in blocks of bounded size against all rows. Recall is measured in the tests.

Edge cases: vectors that are null, empty, zero or hold a null or non-finite component take no part,
neither do vectors whose length is not ``dim`` (by default the most common length; ties: the longer)
or rows without an id; fewer candidates than k give them all; ties go to the smaller id; rows that
repeat an id are candidates each, but never of a query with that id; empty tables give empty results;
extra columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitwise.llm.common import stored, union_all

QUERY_BITS = 5
#: Half-width of the error interval in standard deviations of the estimator.
EPSILON = 1.7
#: Best estimates whose exact products give the score to beat, as a multiple of k.
FIRST = 3
#: Queries sent out at once (a block of 64-dimensional queries is 4 MB).
QUERY_BLOCK = 8192
SEED = 20240607


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, as doubles."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False))).select("vec_id", v.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten(), np.float64).reshape(-1, dim)


def pack(bits: np.ndarray) -> np.ndarray:
    """(n, dim) booleans as (n, words) of 64 bits, zero-padded."""
    words = -(-bits.shape[1] // 64)
    full = np.zeros((len(bits), words * 64), bool)
    full[:, :bits.shape[1]] = bits
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def encode(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, lengths and self inner products of the rows of ``x``."""
    y = x - mean
    norm = np.sqrt((y * y).sum(axis=1))
    unit = np.divide(y, norm[:, None], out=np.zeros_like(y), where=norm[:, None] > 0) @ turn
    return pack(unit > 0), norm, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])


def build_index(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, np.ndarray, int] | None:
    """Index rows (vec_id, v, code, norm, self_dot), the mean vector and the dimension; None without vectors."""
    rows = usable(vectors)
    if dim is None:
        top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if top is None:
            return None
        dim = top["d"]
    rows = rows.filter(F.size("v") == dim)
    sums = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).collect()   # dim rows
    if not sums:
        return None
    mean = np.zeros(dim)
    for r in sums:
        mean[r["i"]] = r["m"]
    mean = np.round(mean, 9)                     # the same to the last bit, whatever the order of summing
    turn = rotation(dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bits, norm, dot = encode(_matrix(b.column("v"), dim), mean, turn)
                yield pa.RecordBatch.from_arrays(
                    [b.column("vec_id"), b.column("v"), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(norm), pa.array(dot)],
                    names=["vec_id", "v", "code", "norm", "self_dot"])

    return rows.mapInArrow(code, "vec_id long, v array<double>, code binary, norm double, self_dot double"), mean, dim


class QueryBlock:
    """Rotated, quantised queries of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray):
        self.ids, self.vectors = ids, vectors
        turned = vectors @ turn
        low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - low) / (2 ** QUERY_BITS - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / self.step[:, None]).astype(np.int64)
        self.planes = [pack((level >> j) & 1 == 1) for j in range(QUERY_BITS)]
        self.low, self.total = low, level.sum(axis=1)
        self.with_mean = vectors @ mean
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))

    def estimates(self, q: int, code: np.ndarray, signs_sum: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Estimated inner products of query ``q`` with the coded vectors."""
        count = np.zeros(len(code), np.int16)
        for j, plane in enumerate(self.planes):
            for w in range(code.shape[1]):
                count += np.bitwise_count(code[:, w] & plane[q, w]).astype(np.int16) << j
        # <signs, level> = 2 * count - total; the query is low + step * level
        signs = (2 * self.step[q]) * count - self.step[q] * self.total[q] + self.low[q] * signs_sum
        return self.with_mean[q] + scale * signs

    def search(self, ids, x, code, norm, dot, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
        """(query id, vector ids, scores, reranked) of the k best of these rows for each query."""
        dim = self.vectors.shape[1]
        safe = np.maximum(dot, 1e-9)
        signs_sum = 2.0 * np.bitwise_count(code).sum(axis=1) - dim
        scale = norm / np.sqrt(dim) / safe
        spread = EPSILON * norm * np.sqrt(np.maximum(1 - dot * dot, 0)) / safe / np.sqrt(max(dim - 1, 1))
        rounding = 0.5 * norm / safe
        for q, qid in enumerate(self.ids):
            estimate = self.estimates(q, code, signs_sum, scale)
            estimate[ids == qid] = -np.inf
            pick = np.flatnonzero(estimate > -np.inf)
            if len(pick) > FIRST * k:
                # exact products of the best estimates give the k-th score to beat; then all that may beat it
                likely = np.argpartition(estimate, len(estimate) - FIRST * k)[-FIRST * k:]
                exact = (x[likely] * self.vectors[q]).sum(axis=1)
                kth = np.partition(exact, len(exact) - k)[len(exact) - k]
                error = spread * self.norm[q] + rounding * self.step[q]
                pick = np.union1d(np.flatnonzero(estimate + error >= kth), likely)
            score = (x[pick] * self.vectors[q]).sum(axis=1)          # summed alike for equal vectors
            best = np.lexsort((ids[pick], -score))[:k]
            yield qid, ids[pick][best], score[best], len(pick)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, dim: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` largest inner products found for each query.

    ``queries`` has vec_id and embedding like ``vectors``. Each block of queries is one pass over the
    index (rows are scored where they lie; only k rows a query and batch are shuffled).
    """
    spark = vectors.sparkSession
    empty = spark.range(0).select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    built = build_index(vectors, dim)
    if built is None:
        return empty
    index, mean, dim = built
    index = stored(index, "onebit-index")
    turn = rotation(dim)
    wanted = usable(queries).filter(F.size("v") == dim).distinct()
    ids = stored(wanted, "onebit-queries")
    parts, last = [], None
    while True:                                      # blocks in the order of (id, vector), each bounded
        rest = ids if last is None else ids.filter(
            (F.col("vec_id") > last["vec_id"]) | (F.col("vec_id") == last["vec_id"]) & (F.col("v") > F.array(*map(F.lit, last["v"])).cast(ids.schema["v"].dataType)))
        rows = rest.orderBy("vec_id", "v").limit(block).collect()
        if not rows:
            break
        last = rows[-1]
        held = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows])))
        parts.append(index.mapInArrow(_block_search(held, mean, turn, dim, k), "query_id long, vec_id long, score double"))
        if len(rows) < block:
            break
    if not parts:
        return empty
    found = union_all(parts)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _block_search(held, mean: np.ndarray, turn: np.ndarray, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, qv = held.value
        block = QueryBlock(qids, qv, mean, turn)
        words = -(-dim // 64)
        for b in batches:
            if not b.num_rows:
                continue
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint64).reshape(-1, words)
            out = list(block.search(np.asarray(b.column("vec_id")), _matrix(b.column("v"), dim), code,
                                    np.asarray(b.column("norm")), np.asarray(b.column("self_dot")), k))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)),
                 pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]))],
                names=["query_id", "vec_id", "score"])
    return run
