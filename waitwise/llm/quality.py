"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of ``WIDTH`` bytes run over every position of a text; positions are grouped in
chunks whose windows overlap the next chunk, each filter is max-pooled per chunk, and the largest
and the mean chunk value of each filter are combined into one probability. A score depends on the
text alone: not on the batch, the partition or any other column.

Edge cases: a null or empty text has no window and gets the score of the bias; texts of any length
are read whole, in blocks; rows of ``labels`` with a null label or id are ignored and repeated ones
averaged; without usable labels of both classes the score is the (smoothed) share of label 1; extra
columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwise.llm.common import bound_batches, text_blocks

WIDTH, FILTERS, CHUNK = 5, 16, 256
#: The classifier is fitted on at most so many labelled rows a class, and so many bytes of text in all.
MAX_ROWS_PER_CLASS, MAX_TRAIN_BYTES = 1200, 10 << 20
EPOCHS, BATCH, RATE, DECAY = 20, 16, 0.01, 1e-4
_SLICE = 1 << 16


@dataclass
class ByteCnn:
    table: np.ndarray     # (WIDTH, 256, FILTERS): a filter's weight for each byte at each offset
    bias: np.ndarray      # (FILTERS,)
    out: np.ndarray       # (2 * FILTERS,): largest chunk value, mean chunk value
    out_bias: float

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each text in a block of bytes."""
        feats = np.zeros((len(offs) - 1, 2 * FILTERS), np.float32)
        filled = np.flatnonzero(np.diff(offs) > 0)
        if len(filled):
            padded, first, lens = pad(buf, offs[:-1][filled], np.diff(offs)[filled])
            chunk_at, chunk_of = chunk_starts(first, lens)
            pooled = np.maximum(self._pool(padded, chunk_at, first + lens), 0)
            begin = np.searchsorted(chunk_of, np.arange(len(filled)))
            count = np.diff(np.append(begin, len(chunk_of)))[:, None]
            feats[filled, :FILTERS] = np.maximum.reduceat(pooled, begin, axis=0)
            feats[filled, FILTERS:] = np.add.reduceat(pooled, begin, axis=0) / count
        z = (feats.astype(np.float64) * self.out).sum(axis=1) + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def responses(self, padded: np.ndarray, start: int, end: int) -> np.ndarray:
        """(positions, FILTERS) of the windows that begin in [start, end)."""
        act = np.take(self.table[0], padded[start:end], axis=0)
        for w in range(1, WIDTH):
            act += np.take(self.table[w], padded[start + w:end + w], axis=0)
        act += self.bias
        return act

    def _pool(self, padded: np.ndarray, chunk_at: np.ndarray, text_end: np.ndarray) -> np.ndarray:
        """Largest response of each chunk, a slice of about _SLICE positions at a time."""
        stop = np.minimum(chunk_at + CHUNK, text_end[np.searchsorted(text_end, chunk_at, "right")])
        out = np.empty((len(chunk_at), FILTERS), np.float32)
        i = 0
        while i < len(chunk_at):
            j = max(i + 1, int(np.searchsorted(chunk_at, chunk_at[i] + _SLICE)))
            s = chunk_at[i]
            act = self.responses(padded, s, stop[j - 1])
            cut = np.empty(2 * (j - i), np.int64)      # chunk, gap (padding between texts), chunk, ...
            cut[0::2], cut[1::2] = chunk_at[i:j] - s, stop[i:j] - s
            keep = np.ones(2 * (j - i), bool)
            keep[1::2] = np.append(cut[1:-1:2] < cut[2::2], False)     # chunks that touch leave no gap
            out[i:j] = np.maximum.reduceat(act, cut[keep], axis=0)[np.flatnonzero(keep) % 2 == 0]
            i = j
        return out


def pad(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The (non-empty, consecutive) texts with WIDTH - 1 zero bytes after each: bytes, new starts, lengths."""
    first = starts - starts[0] + np.arange(len(starts)) * (WIDTH - 1)
    out = np.zeros(int(lens.sum()) + len(starts) * (WIDTH - 1), np.uint8)
    where = np.ones(len(out), bool)
    for w in range(WIDTH - 1):
        where[first + lens + w] = False
    out[where] = buf[starts[0]:starts[-1] + lens[-1]]
    return out, first, lens


def chunk_starts(first: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every chunk and the text it belongs to."""
    per = -(-lens // CHUNK)
    of = np.repeat(np.arange(len(first)), per)
    k = np.arange(len(of)) - np.repeat(np.cumsum(per) - per, per)
    return first[of] + k * CHUNK, of


# --------------------------------------------------------------------------- fitting

def fit(texts: list[bytes], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> ByteCnn:
    """Fit filters and output together by Adam; both classes weigh the same."""
    rng = np.random.default_rng(seed)
    y_all = np.asarray(labels, np.float64)
    model = ByteCnn(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32),
                    rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    share = (y_all.sum() + 1) / (len(y_all) + 2)
    if len(set(labels)) < 2:
        return ByteCnn(model.table * 0, model.bias, model.out * 0, float(np.log(share / (1 - share))))
    weight = np.where(y_all == 1, 0.5 / max(y_all.mean(), 1e-9), 0.5 / max(1 - y_all.mean(), 1e-9))
    state = {k: [np.zeros(s), np.zeros(s)] for k, s in (("table", model.table.shape), ("bias", FILTERS), ("out", 2 * FILTERS), ("out_bias", ()))}
    step = 0
    steps = epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            step += 1
            pick = [j for j in order[i:i + BATCH] if texts[j]]
            grads = _gradients(model, [texts[j] for j in pick], y_all[pick], weight[pick]) if pick else None
            if grads:
                rate = RATE * (1 - step / (steps + 1))
                for k, g in grads.items():
                    m, v = state[k]
                    m[...] = 0.9 * m + 0.1 * g
                    v[...] = 0.999 * v + 0.001 * g * g
                    move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                    old = getattr(model, k)
                    setattr(model, k, (old * (1 - rate * DECAY) - move).astype(np.float32) if k in ("table", "bias") else old - move)
    model.out_bias = float(model.out_bias)
    return model


def _gradients(model: ByteCnn, texts: list[bytes], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    lens = np.array([len(t) for t in texts])
    padded, first, lens = pad(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lens) - lens, lens)
    at, of = chunk_starts(first, lens)
    stop = np.minimum(at + CHUNK, (first + lens)[of])
    where = np.empty((len(at), FILTERS), np.int64)
    pooled = np.empty((len(at), FILTERS), np.float32)
    for c, (s, e) in enumerate(zip(at, stop)):
        act = model.responses(padded, s, e)
        top = act.argmax(axis=0)
        where[c], pooled[c] = s + top, act[top, np.arange(FILTERS)]
    h = np.maximum(pooled, 0)
    begin = np.searchsorted(of, np.arange(len(texts)))
    count = np.diff(np.append(begin, len(of)))
    largest = np.maximum.reduceat(h, begin, axis=0)
    mean = np.add.reduceat(h, begin, axis=0) / count[:, None]
    feats = np.concatenate([largest, mean], axis=1)
    dz = (1 / (1 + np.exp(-np.clip(feats @ model.out + model.out_bias, -40, 40))) - y) * weight / len(texts)
    d_feats = dz[:, None] * model.out
    is_top = h == largest[of]
    d_h = is_top * d_feats[of, :FILTERS] + d_feats[of, FILTERS:] / count[of][:, None]
    d_h[pooled <= 0] = 0
    table = np.zeros(model.table.shape)
    f = np.broadcast_to(np.arange(FILTERS), where.shape)
    for w in range(WIDTH):
        np.add.at(table[w], (padded[where + w], f), d_h)
    return {"table": table, "bias": d_h.sum(axis=0), "out": dz @ feats, "out_bias": np.asarray(dz.sum())}


# --------------------------------------------------------------------------- Spark side

def held_out(doc_id: Column) -> Column:
    """Rows that no classifier may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS_PER_CLASS,
                    max_bytes: int = MAX_TRAIN_BYTES) -> list[tuple[bytes, int]]:
    """Labelled texts that are not held out: at most ``max_rows`` a class in the order of a hash of the id,
    cut off at ``max_bytes`` in all."""
    known = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
             .withColumn("h", F.xxhash64("doc_id")))
    pick = None
    for y in (0, 1):
        top = known.filter(F.col("y") == y).orderBy("h", "doc_id").limit(max_rows)
        pick = top if pick is None else pick.unionByName(top)
    rows = (docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")          # at most 2 * max_rows ids
            .select("doc_id", "y", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n")))
    chosen, total = [], 0
    for r in sorted(rows.collect(), key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= max_bytes:
            total += r["n"]
            chosen.append(r["doc_id"])
    if not chosen:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(set(chosen))], "doc_id long")
    got = docs.select("doc_id", "text").join(F.broadcast(ids.join(pick, "doc_id")), "doc_id").collect()
    got.sort(key=lambda r: (r["h"], r["doc_id"], r["text"] or ""))
    return [((r["text"] or "").encode("utf-8"), r["y"]) for r in got]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> ByteCnn:
    sample = training_sample(docs, labels, label)
    return fit([t for t, _ in sample], [y for _, y in sample])


def score_column(text: Column, model: ByteCnn) -> Column:
    """Probability of label 1, as an Arrow-batched column expression."""
    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            yield pa.array(np.concatenate([model.scores(b, o) for _, _, b, o in text_blocks(col)] or [np.zeros(0)]))
    return score(text)


def score_documents(docs: DataFrame, model: ByteCnn, out: str = "score") -> DataFrame:
    bound_batches(docs.sparkSession)
    return docs.withColumn(out, score_column(F.col("text"), model))


def keep_good(docs: DataFrame, model: ByteCnn, least: float = 0.5) -> DataFrame:
    """The documents that score at least ``least``, columns as given."""
    bound_batches(docs.sparkSession)
    return docs.filter(score_column(F.col("text"), model) >= least)
