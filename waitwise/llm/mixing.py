"""Mixing documents to target domain weights, with soft membership.

A classifier fitted on the labelled table gives each document a posterior over domains. Nonnegative
rates (expected copies of each document) are then fitted by projected-gradient least squares, so that
the expected tokens of every domain, tokens * posterior * rate summed over all documents, match the
targets; a small ridge keeps rates near 1 and makes them unique. The domain of the largest weight sets the
total: the others are thinned or repeated until each has its share of it.

The gradient of a document's rate, divided by its tokens, depends on its posterior alone. Posteriors are
given on a grid of shares (``GRID`` steps), so documents of one posterior form one cell, and the
iterations run over the cells: their number is bounded by the grid, whatever the corpus.

Edge cases: null or empty texts have no tokens and no features (the posterior is the prior's) and weigh
nothing in the fit; labels that are null are ignored, repeated ones count once a row; without usable
labels every posterior is uniform; empty tables give empty results; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waitwise.llm.common import bound_batches

#: Steps of the posterior grid by number of domains: at most about 25,000 cells each, so a table of
#: cells is below 2 MB and safe to broadcast.
GRID = {1: 1, 2: 1000, 3: 200, 4: 50, 5: 25, 6: 15}
#: The classifier is fitted on at most so many labelled rows and so many bytes of text, in the order of a hash of the id.
MAX_ROWS, MAX_BYTES = 3000, 16 << 20
FEATURES = 768
RIDGE, MAX_STEPS, TOLERANCE = 1e-6, 100, 1e-5

#: Production domains, as the labelled table tells them, and target weights.
DOMAINS = {"clean": "quality = 1 AND toxic = 0", "junk": "quality = 0 AND toxic = 0", "toxic": "toxic = 1"}
TARGETS = {"clean": 0.92, "junk": 0.05, "toxic": 0.03}

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MARKS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_NOT_MARKS = bytes(b for b in range(256) if b not in _MARKS)
_UPPER = bytes(range(65, 91))


def features(raw: bytes) -> tuple[int, set[bytes]]:
    """Number of words, and the set of words (A-Z lower-cased), marks that follow a tenth of the words, and shouting."""
    words = raw.translate(_LETTERS).split()
    found = set(words)
    marks = Counter(raw.translate(None, _NOT_MARKS))
    found.update(b"#mark %d" % m for m, n in marks.items() if 10 * n >= len(words))
    letters = len(raw.translate(_LETTERS).replace(b" ", b""))
    if letters and 3 * (len(raw) - len(raw.translate(None, _UPPER))) > letters:
        found.add(b"#upper")
    return len(words), found


@dataclass
class DomainModel:
    names: list[str]
    vocab: dict[bytes, int]
    weights: np.ndarray      # (features, domains)
    bias: np.ndarray         # (domains,)

    @property
    def grid(self) -> int:
        return GRID[len(self.names)]

    def cells(self, texts: list[bytes]) -> tuple[list[int], np.ndarray]:
        """Words of each text, and its posterior as grid counts that add up to ``grid``."""
        known = self.vocab.keys()
        tokens, logits = [], np.empty((len(texts), len(self.names)))
        for i, raw in enumerate(texts):
            n, found = features(raw)
            tokens.append(n)
            rows = sorted(self.vocab[w] for w in known & found)
            logits[i] = self.weights[rows].sum(axis=0) + self.bias if rows else self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True)) if len(texts) else logits
        p = p / p.sum(axis=1, keepdims=True) * self.grid if len(texts) else p
        low = np.floor(p)
        short = (self.grid - low.sum(axis=1)).astype(int)       # largest remainders get what is left
        order = np.argsort(low - p, axis=1, kind="stable")
        for i, k in enumerate(short):
            low[i, order[i, :k]] += 1
        return tokens, low.astype(np.int32)


def fit_model(names: list[str], texts: list[bytes], labels: list[int], steps: int = 300) -> DomainModel:
    """Softmax regression on the presence of the features that tell the domains apart best."""
    n, d = len(texts), len(names)
    if n == 0:
        return DomainModel(names, {}, np.zeros((0, d)), np.zeros(d))
    y = np.eye(d)[labels]
    sets = [features(t)[1] for t in texts]
    times = Counter(w for found in sets for w in found)
    often = {w: i for i, w in enumerate(sorted(w for w, m in times.items() if m >= 3))}
    have = np.zeros((len(often), d))
    for found, label in zip(sets, labels):
        have[[often[w] for w in often.keys() & found], label] += 1
    totals = y.sum(axis=0)
    m = have.sum(axis=1, keepdims=True)           # chi-square of presence against the domain
    chi = sum(((h - e) ** 2 / np.maximum(e, 1e-9)).sum(axis=1) for h, e in ((have, totals * m / n), (totals - have, totals * (n - m) / n)))
    scored = list(zip(chi.tolist(), often))
    top = sorted(scored, key=lambda x: (-x[0], x[1]))[:FEATURES]
    vocab = {w: i for i, w in enumerate(sorted(w for c2, w in top if c2 > 6.0))}
    x = np.zeros((n, len(vocab)), np.float32)
    for i, found in enumerate(sets):
        x[i, [vocab[w] for w in vocab.keys() & found]] = 1
    mean = x.mean(axis=0)
    x -= mean
    w = np.zeros((len(vocab) + 1, d))                       # the last row is the bias
    w[-1] = np.log((totals + 1) / (n + d))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):                           # Adam over the whole sample, decay on the weights
        z = x @ w[:-1] + w[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y) / n
        grad = np.vstack([x.T @ g + 1e-3 * w[:-1], g.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.05 * (1 - k / (steps + 1)) * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-9)
    b = w[-1] - mean @ w[:-1]
    w = w[:-1]
    return DomainModel(names, vocab, w, b)


def fit_domains(docs: DataFrame, labels: DataFrame, domains: dict[str, str] | None = None) -> DomainModel:
    """Domain classifier from the labelled table; ``domains`` maps a name to its SQL condition on ``labels``."""
    domains = domains or DOMAINS
    names = list(domains)
    domain = F.coalesce(*[F.when(F.expr(c), i) for i, c in enumerate(domains.values())])
    pick = (labels.filter(F.col("doc_id").isNotNull()).select("doc_id", domain.alias("domain")).filter("domain IS NOT NULL")
            .groupBy("doc_id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_ROWS))
    joined = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
    sizes = joined.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("h")).collect()
    chosen, total = set(), 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if total + r["n"] <= MAX_BYTES:
            total += r["n"]
            chosen.add(r["doc_id"])
    if not chosen:
        return fit_model(names, [], [])
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(chosen)], "doc_id long")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.join(pick, "doc_id")), "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"] or ""))
    return fit_model(names, [(r["text"] or "").encode() for r in rows], [r["domain"] for r in rows])


def classify(docs: DataFrame, model: DomainModel, carry: list[str]) -> DataFrame:
    """``carry`` columns, tokens, and cell (the posterior in grid counts, one entry a domain)."""
    schema = T.StructType([f for f in docs.schema.fields if f.name in carry]
                          + [T.StructField("tokens", T.LongType()), T.StructField("cell", T.ArrayType(T.IntegerType()))])
    carry = [f.name for f in schema.fields[:-2]]
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                piece = batch.slice(i, 512)
                tokens, cells = model.cells([x.as_py() or b"" for x in piece.column("text").cast(pa.binary())])
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in carry] + [
                    pa.array(tokens, pa.int64()), pa.array(list(cells), pa.list_(pa.int32()))], names=[*carry, "tokens", "cell"])

    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(run, schema)


def _rates_after(history: list[list[float]], share: list[Column]) -> Column:
    """(rate, ahead) of a cell after the steps of ``history``: each entry holds the domain errors at the point
    ahead and the momentum. A rate follows from its posterior and the errors alone."""
    start = F.struct(F.lit(1.0).alias("rate"), F.lit(1.0).alias("ahead"))
    if not history:
        return start
    step = 1 / (1 + RIDGE)            # the curvature in this metric is at most 1 + ridge

    def move(s: Column, h: Column) -> Column:
        slope = sum((c * F.element_at(h, i + 1) for i, c in enumerate(share)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), s["ahead"] - F.lit(step) * (slope + F.lit(RIDGE) * (s["ahead"] - F.lit(1.0))))
        return F.struct(rate.alias("rate"), (rate + F.element_at(h, len(share) + 1) * (rate - s["rate"])).alias("ahead"))

    past = F.from_json(F.lit("[" + ",".join("[" + ",".join(map(repr, h)) + "]" for h in history) + "]"), "array<array<double>>")
    return F.aggregate(past, start, move)


def fit_rates(members: DataFrame, model: DomainModel, targets: dict[str, float]) -> DataFrame:
    """(cell, tokens, rate) of every posterior that occurs in ``members`` (tokens, cell).

    The domain of the largest weight (of those with tokens) keeps its expected tokens and sets the total; every
    other domain with tokens gets its exact share of it, by rates below 1 or above. Errors count relative to
    the tokens a domain has, so a small domain is fitted as fast as a large one. Each accelerated
    projected-gradient step is one aggregation over the cells.

    Soft membership limits what rates can reach: where no posterior holds as much of a domain as its share, the
    closest fit is given.
    """
    d = len(model.names)
    weight = np.array([targets[n] for n in model.names], float)
    weight = weight / weight.sum()
    cells = members.groupBy("cell").agg(F.sum("tokens").alias("tokens")).checkpoint()
    share = [F.element_at("cell", i + 1) / F.lit(float(model.grid)) for i in range(d)]

    def totals(history: list[list[float]]) -> np.ndarray:
        moved = cells.select("tokens", "cell", _rates_after(history, share)["ahead"].alias("x"))
        row = moved.agg(*[F.sum(F.col("tokens") * F.col("x") * c).alias(f"t{i}") for i, c in enumerate(share)]).first()
        return np.array([x or 0.0 for x in row])

    have = totals([])
    live = have > 0
    history: list[list[float]] = []
    if live.any():
        main = int(np.where(live, weight, -1.0).argmax())
        goal = weight * have[main] / weight[main] if weight[main] > 0 else np.zeros(d)

        def errors() -> np.ndarray:
            return np.where(live, totals(history) - goal, 0.0) / np.where(live, have, 1.0)

        error, k = errors(), 1
        for _ in range(MAX_STEPS):
            history.append([*map(float, error), k / (k + 3)])
            last, error = error, errors()
            k = 1 if (error @ error) > (last @ last) else k + 1      # restart the momentum when it overshoots
            if np.abs(error - last).max() < TOLERANCE:
                break
    return cells.select("cell", "tokens", F.round(_rates_after(history, share)["rate"], 9).alias("rate")).checkpoint()


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies of a row: its rate rounded up or down by a hash of its key, right on average."""
    u = F.pmod(F.xxhash64(*key, F.lit("mix")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + u).cast("int")


def mixing_plan(members: DataFrame, rates: DataFrame, model: DomainModel) -> DataFrame:
    """Columns of ``members`` with p_<domain>, rate and copies. The rates are a bounded table (see GRID)."""
    joined = members.join(F.broadcast(rates.select("cell", "rate")), "cell")
    p = [(F.element_at("cell", i + 1) / F.lit(float(model.grid))).alias(f"p_{n}") for i, n in enumerate(model.names)]
    return joined.select(*[c for c in members.columns if c != "cell"], *p, "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix_documents(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None,
                  domains: dict[str, str] | None = None, all_docs: DataFrame | None = None) -> DataFrame:
    """``docs`` repeated or dropped by their fitted rates, columns as given."""
    model = fit_domains(docs if all_docs is None else all_docs, labels, domains)
    rates = fit_rates(classify(docs, model, []), model, targets or TARGETS)
    placed = classify(docs.drop("tokens", "cell"), model, docs.columns).join(F.broadcast(rates.select("cell", "rate")), "cell")
    n = copies(F.col("rate"), F.col("doc_id"))
    return (placed.withColumn("__n", n).filter("__n > 0")
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns))
