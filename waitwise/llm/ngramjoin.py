"""N-gram Jaccard join: documents whose word-shingle sets have a Jaccard similarity of at least 0.8.

Equal sets are one node. In any fixed order of shingles (frequent ones last, then by hash), two similar sets
share at least k of the first ``n - ceil(0.8 n) + k`` of each, so each node sends those only, with k = 1 + n / 25;
a node that shares fewer of them with others than its smallest possible partner's k has no partner and leaves.
The rest is compared in two steps, exact as a whole:

* every node of a shingle with the smallest node of each of ``STARS`` hash classes of the shingle's nodes (stars: a
  group of g copies makes STARS * g pairs, and a shingle of few nodes is done with);
* the others of a shingle, where they lie in different components, in tiles of nodes of neighbouring size
  bands, split into blocks of bounded size.

Each node has a bitmap of its hashed shingles. A bit that two bitmaps differ in is a shingle they do not share,
so bit counts bound the overlap from above; only pairs that can still reach the threshold have their sorted
shingle arrays intersected. Nodes linked already need no further pair to make components complete.

Links lie inside components, so they are counted there (``count_links``): all pairs of a component's nodes whose
sizes allow a link are compared, in pairs of blocks of bounded size, by exact overlaps. A block pair gives
one count a node, weighted by the rows of the other set; no pair of nodes is ever a row.

Edge cases: a text without words has an empty set and links with nothing; fewer than five words are one
shingle; repeated rows and equal texts share a node; a null doc_id takes part but is never the smallest id;
empty tables give empty results; extra columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from waitwise.llm.common import PrimeHash, bound_batches, free, maybe_in, mix, release, stored, text_blocks
from waitwise.session import cut_lineage

WORDS, PERCENT = 5, 80
#: A shingle in more than 1 / FREQUENT of the documents is ordered last (at most FREQUENT * mean set size of them).
FREQUENT = 400
#: Rows whose shingles are counted together when frequent ones are sought.
SLICE_ROWS = 2500
#: Nodes of each shingle that all its nodes are compared with first.
STARS = 4
#: Nodes of one tile block; a hot tile is split into pairs of blocks.
BLOCK_NODES = 512
#: Smallest shingles of a node that travel with it, so that a pair comes out of the first tile it shares.
LOWEST = 16
#: About so many shingles make one block of a component whose links are counted.
BLOCK_SHINGLES = 1 << 19

_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[9:14] = 32


def shingle_sets(buf: np.ndarray, offs: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block. Words are runs of bytes other than 0x20, 0x09-0x0D,
    with A-Z lower-cased; a text of fewer than ``words`` words is one shingle."""
    spaced = np.insert(_NORMAL[buf], offs[1:], 32)
    ends = offs[1:] + np.arange(1, len(offs))                   # a space ends every text
    is_word = spaced != 32
    after_word = np.concatenate([[False], is_word[:-1]])
    starts = np.flatnonzero(is_word & ~after_word)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))     # first word of each text
    kept = spaced[is_word | after_word]                          # one space after each word
    stop = np.flatnonzero(kept == 32)
    begin = np.concatenate([[0], stop[:-1] + 1])
    count = np.diff(first)
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(count)
    if not len(stop):
        return out
    hashed = PrimeHash(kept)
    n = len(stop)
    whole = hashed(begin[:max(0, n - words + 1)], stop[words - 1:]) if n >= words else np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < words))
    one = hashed(begin[first[short]], stop[first[short + 1] - 1])
    for i, h in zip(short, one):
        out[i] = np.array([h], np.uint64)
    for i in np.flatnonzero(count >= words):
        out[i] = np.unique(whole[first[i]:first[i + 1] - words + 1])
    return out


def need(size: int) -> int:
    """Smallest overlap of a set with a similar one."""
    return -(-PERCENT * size // 100)


def prefix_extra(size):
    """k: shingles that a set shares, at least, with a similar one in their prefixes (the smaller set's k holds)."""
    return 1 + size // 25


def bitmap(h: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set. Its length follows the size band: at least two bits a shingle, and sixteen for sets
    of up to 256, where pairs just below the threshold are then told by their bits."""
    bits = 1 << (max(64, 2 * len(h), min(16 * len(h), 4096)) - 1).bit_length()
    out = np.zeros(bits // 8, np.uint8)
    pos = (mix(h) & np.uint64(bits - 1)).astype(np.int64)
    np.bitwise_or.at(out, pos >> 3, (1 << (pos & 7)).astype(np.uint8))
    return out


def fold(bits: np.ndarray, length: int) -> np.ndarray:
    """The bitmap a set would have at a shorter length (bit positions are hashes modulo the length)."""
    while bits.shape[-1] > length:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def overlap_bound(na: int, nb: int, differing: int) -> int:
    """Largest possible overlap of two sets whose bitmaps differ in so many bits."""
    return (na + nb - differing) // 2


def similar(overlap: int, na: int, nb: int) -> bool:
    return 100 * overlap >= PERCENT * (na + nb - overlap)


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


# --------------------------------------------------------------------------- sketches

def _node(h: np.ndarray) -> int:
    """Hash of a set."""
    return int(mix(h ^ np.uint64(0xA5A5)).sum(dtype=np.uint64).view(np.int64))


def _check(h: np.ndarray) -> int:
    """A second hash of a set."""
    return int(mix(h ^ np.uint64(0x5A5A5A)).sum(dtype=np.uint64).view(np.int64))


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    for i, _, buf, offs in text_blocks(batch.column("text")):
        yield i, shingle_sets(buf, offs)


def frequent_shingles(docs: DataFrame, share: int = FREQUENT) -> np.ndarray:
    """Hashes of the shingles that (about) more than 1 / share of the documents hold.

    Every ``SLICE_ROWS`` rows of a task count their shingles, those in more than 1 / (2 share) of the documents are
    summed; the size of batches does not matter. The list only orders shingles: results do not depend on it. It holds
    at most 2 * share * (mean set size) entries.
    """
    def often(held: list[np.ndarray], rows: int) -> pa.RecordBatch:
        every = np.concatenate(held or [np.zeros(0, np.uint64)])
        every.sort()
        at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        times = np.diff(np.append(at, len(every)))
        some = times > max(2, rows // (2 * share))
        return pa.RecordBatch.from_arrays([pa.array(every[at][some].view(np.int64)), pa.array(times[some].astype(np.int64))], names=["h", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0                                 # a slice's shingles are held at once
        for b in batches:
            done = 0
            while done < b.num_rows:
                part = b.slice(done, SLICE_ROWS - rows)
                done, rows = done + part.num_rows, rows + part.num_rows
                held += [h for _, s in _sets(part) for h in s]
                if rows == SLICE_ROWS:
                    yield often(held, rows)
                    held, rows = [], 0
        if rows:
            yield often(held, rows)

    total = docs.count()
    least = max(16, total // share)
    rows = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return np.sort(np.array([r["h"] for r in rows.select("h").collect()], np.int64).view(np.uint64))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), node (hash of the set; null if empty), check (a second one), prefix, bits."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = held.value
        for b in batches:
            ids = b.column("doc_id")
            for i, sets in _sets(b):
                n, node, check, prefix, bits = [], [], [], [], []
                for h in sets:
                    n.append(len(h))
                    if not len(h):
                        for x in (node, check, prefix, bits):
                            x.append(None)
                        continue
                    node.append(_node(h))
                    check.append(_check(h))
                    size = min(len(h), len(h) - need(len(h)) + prefix_extra(len(h)))
                    if len(frequent):
                        at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                        late = frequent[at] == h
                        if late.any():
                            h = np.concatenate([h[~late], h[late]])
                    prefix.append(h[:size].view(np.int64))
                    bits.append(bitmap(h).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, len(n)), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()),
                     pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    names=["doc_id", "n", "node", "check", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, node long, check long, prefix array<long>, bits binary")


# --------------------------------------------------------------------------- comparing

def _may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps leave the threshold in reach."""
    a = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a"))
    b = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b"))
    sized = (pairs.join(a.drop("bits_a"), "a").join(b.drop("bits_b"), "b")
             .filter(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for na, nb, x, y in zip(t.column("na").to_pylist(), t.column("nb").to_pylist(), t.column("bits_a"), t.column("bits_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                short = min(len(x), len(y))
                differ = int(np.bitwise_count(fold(x, short) ^ fold(y, short)).sum())
                keep.append(similar(overlap_bound(na, nb, differ), na, nb))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return sized.join(a.drop("na"), "a").join(b.drop("nb"), "b").mapInArrow(run, "a long, b long")


def _linked(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link: exact intersection of the sorted shingle arrays.

    Arrays are made anew from the texts of the nodes in question, which travel once to each pair.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    owners = nodes.join(wanted, "node", "left_semi").select("node", F.col("min_doc").alias("doc_id"))
    some = docs.select("doc_id", "text").filter(maybe_in(owners, "doc_id", F.col("doc_id")) | F.col("doc_id").isNull())

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _sets(b):
                full = [j for j, h in enumerate(sets) if len(h)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(sets[j]) for j in full], pa.int64()),
                     pa.array([sets[j].tobytes() for j in full], pa.binary())], names=["node", "h"])

    sets = some.mapInArrow(arrays, "node long, h binary").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for x, y in zip(t.column("ha"), t.column("hb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(similar(intersection(x, y), len(x), len(y)))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return (pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b").mapInArrow(compare, "a long, b long"))


def _tile_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) across components among the nodes of a shingle, that sizes and bitmaps allow.

    ``members``: token, node, n; ``nodes``: node, label, bits, low (smallest shingles of the node among those compared
    here). Tile = shingle and size band (a ratio of 1.25, so a similar pair lies in one band or in two neighbours: the
    smaller set is sent up one band too). Bitmaps join the rows that are dealt already, so they are shuffled once a row.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / PERCENT))).cast("int")
    placed = (members.withColumn("__band", band)
              .withColumn("tile", F.explode(F.array(F.col("__band"), F.col("__band") + 1)))
              .withColumn("own", F.col("tile") == F.col("__band")).drop("__band"))
    sizes = placed.groupBy("token", "tile").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("own").cast("int")).alias("any_own"))
    sizes = sizes.filter((F.col("c") > 1) & (F.col("any_own") == 1))
    blocks = F.ceil(F.col("c") / BLOCK_NODES).cast("int")
    dealt = (placed.join(sizes, ["token", "tile"]).withColumn("s", blocks)
             .withColumn("k", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
             .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
             .select("token", "tile", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "own", "node", "n")
             .join(nodes, "node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for t in batches:
            cols = [t.column(c).to_numpy(zero_copy_only=False) for c in ("token", "tile", "i", "j")]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if t.num_rows > 1 else np.zeros(0, int)
            for s, e in zip(np.concatenate([[0], cut]), np.append(cut, t.num_rows)):
                if s == e:
                    continue
                this = tuple(c[s] for c in cols)
                if held and this != key:
                    yield _compare_tile(held)
                    held = []
                key = this
                held.append(t.slice(int(s), int(e - s)))
        if held:
            yield _compare_tile(held)

    order = ["token", "tile", "i", "j"]
    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def _compare_tile(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts)
    node, label, n, own, k = (t.column(c).to_numpy() for c in ("node", "label", "n", "own", "k"))
    raw = [np.frombuffer(x.as_buffer(), np.uint8) for x in t.column("bits")]
    length = min(len(x) for x in raw)
    bits = np.stack([fold(x, length) for x in raw])
    bits = bits.view(np.uint64)
    i, j, token = (t.column(c)[0].as_py() for c in ("i", "j", "token"))
    low = np.full((len(node), LOWEST), np.iinfo(np.int64).max)
    for r, x in enumerate(t.column("low")):
        low[r, :len(x)] = x.values.to_numpy()
    a, b = [], []
    for x in range(len(node) - 1):
        rest = np.arange(x + 1, len(node))
        ok = (label[rest] != label[x]) & (own[rest] | own[x]) & (100 * np.minimum(n[rest], n[x]) >= PERCENT * np.maximum(n[rest], n[x]))
        if i != j:
            ok &= k[rest] != k[x]
        rest = rest[ok]
        if len(rest):
            differ = np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1, dtype=np.int64)
            bound = (n[rest] + n[x] - differ) // 2
            hit = rest[100 * bound >= PERCENT * (n[rest] + n[x] - bound)]
            earlier = low[x][low[x] < token]           # a smaller shingle of both: the pair came out there
            if len(earlier) and len(hit):
                hit = hit[~np.isin(low[hit], earlier).any(axis=1)]
            a.append(np.minimum(node[hit], node[x]))
            b.append(np.maximum(node[hit], node[x]))
    empty = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [empty])), pa.array(np.concatenate(b or [empty]))], names=["a", "b"])


# --------------------------------------------------------------------------- links

def _block_links(docs: DataFrame, members: DataFrame, block: int) -> DataFrame:
    """(node, links): rows of the other sets that a node links with, one sum for each pair of blocks.

    ``members``: node, label, min_doc, n, copies. A component is dealt into blocks of about ``block`` shingles,
    and every pair of its blocks is one group. Texts travel, as they are smaller than their arrays.
    """
    blocks = F.ceil(F.col("total") / F.lit(float(block))).cast("int")
    sizes = members.groupBy("label").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    placed = (members.join(sizes, "label").withColumn("s", blocks).withColumn("k", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
              .select("node", "label", "min_doc", "copies", "s", "k"))
    placed = cut_lineage(placed)
    some = docs.select("doc_id", "text").filter(maybe_in(placed, "min_doc", F.col("doc_id")) | F.col("doc_id").isNull())

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            for i, sets in _sets(b):
                full = [j for j, h in enumerate(sets) if len(h)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(sets[j]) for j in full], pa.int64()), text.take(pa.array([i + j for j in full], pa.int64()))],
                    names=["node", "text"])

    texts = some.mapInArrow(named, "node long, text string").join(placed.select("node"), "node", "left_semi").dropDuplicates(["node"])
    dealt = (texts.join(placed.drop("min_doc"), "node").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
             .select("label", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "node", "copies", "text"))
    order = ["label", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        key = None

        def counted() -> pa.RecordBatch:
            nodes, links = _count_block(held, key[1] == key[2])
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64())], names=["node", "links"])

        for t in batches:
            keys = list(zip(*(t.column(c).to_pylist() for c in order)))
            k, node, copies = (t.column(c).to_pylist() for c in ("k", "node", "copies"))
            for at, sets in _sets(t):
                for x, h in enumerate(sets, at):
                    if keys[x] != key:
                        if held:
                            yield counted()
                        held, key = [], keys[x]
                    held.append((k[x], node[x], copies[x], h))
        if held:
            yield counted()

    return dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "node long, links long")


def _count_block(held: list[tuple[int, int, int, np.ndarray]], same: bool) -> tuple[list[int], list[int]]:
    """Nodes of a pair of blocks (k, node, copies, array), and the copies of those each links with; nodes of one
    block are compared where it is paired with itself (``same``) only."""
    k = np.array([x[0] for x in held])
    copies = np.array([x[2] for x in held], np.int64)
    n = np.array([len(x[3]) for x in held], np.int64)
    order = np.argsort(n, kind="stable")                # sizes that allow a link are neighbours
    k, copies, n = k[order], copies[order], n[order]
    every, code = np.unique(np.concatenate([held[x][3] for x in order]), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(n)])
    marked = np.zeros(len(every), bool)
    links = np.zeros(len(held), np.int64)
    for x in range(len(held) - 1):
        end = int(np.searchsorted(n, 100 * n[x] // PERCENT, "right"))
        if end <= x + 1:
            continue
        mine = code[first[x]:first[x + 1]]
        marked[mine] = True
        overlap = np.add.reduceat(marked[code[first[x + 1]:first[end]]], first[x + 1:end] - first[x + 1], dtype=np.int64)
        marked[mine] = False
        hit = 100 * overlap >= PERCENT * (n[x] + n[x + 1:end] - overlap)
        if not same:
            hit &= k[x + 1:end] != k[x]
        links[x + 1:end][hit] += copies[x]
        links[x] += copies[x + 1:end][hit].sum()
    return [held[x][1] for x in order], links.tolist()


# --------------------------------------------------------------------------- components

def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node each linked node reaches. Alternating large and small stars: each round is
    an aggregation and a join on a node, and the number of links never grows beyond the input's."""
    spark = links.sparkSession
    edges = cut_lineage(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        star = large.join(low, "b")
        small = (star.select(F.col("m").alias("a"), F.col("a").alias("b"))
                 .unionByName(star.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct())
        last, edges = edges, cut_lineage(small)
        del both, low, large, star, small, last
        release(spark)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            out = cut_lineage(edges.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(
                edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()))
            return out
        before = now


def _with_enough_shared(shared: DataFrame, info: DataFrame, rounds: int = 2) -> DataFrame:
    """``shared`` (token, node) without the nodes that share too few shingles to have a partner, and without
    the shingles that are left with one node. More rounds drop more, none drops a node of a link."""
    smallest = F.ceil(F.col("n") * PERCENT / F.lit(100.0)).cast("long")       # size of the smallest partner
    least = F.lit(1) + F.floor(smallest / 25)
    for _ in range(rounds):
        nodes = cut_lineage(shared.groupBy("node").agg(F.count(F.lit(1)).alias("c")).join(info.select("node", "n"), "node")
                       .filter(F.col("c") >= least).select("node"))
        some = shared.join(nodes, "node", "left_semi")
        tokens = cut_lineage(some.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token"))
        last, shared = shared, cut_lineage(some.join(tokens, "token", "left_semi"))
        del last, nodes, some, tokens
        release(shared.sparkSession)
    return shared


def _hubs(shared: DataFrame) -> DataFrame:
    """(token, hubs): the smallest node of each hash class of a shingle's nodes, by one aggregation of ``STARS`` values."""
    kind = F.pmod(F.xxhash64("node"), F.lit(STARS))
    low = [F.min(F.when(kind == c, F.col("node"))).alias(f"h{c}") for c in range(STARS)]
    return cut_lineage(shared.groupBy("token").agg(*low).select("token", F.array_compact(F.array(*[f"h{c}" for c in range(STARS)])).alias("hubs")))


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (see ``sketch``), classes (node, check, min_doc, n, copies) and (node, label) of the linked nodes.

    Every step is checkpointed in the shared folder and let go after its last reader (Spark deletes the files of
    checkpoints that nothing refers to where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set).
    """
    spark = docs.sparkSession
    rows = stored(sketch(docs), "ngram-sketch")
    classes = stored(rows.filter("n > 0").groupBy("node", "check").agg(
        F.min("doc_id").alias("min_doc"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies")), "ngram-classes")
    sent = rows.select("node", F.explode("prefix").alias("token"))
    several = cut_lineage(sent.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token"))
    release(spark)                              # every sent shingle was shuffled: these files go before the next ones come
    shared = cut_lineage(sent.join(several, "token").select("token", "node").distinct())
    del sent, several
    release(spark)
    shared = _with_enough_shared(shared, classes)

    # bitmaps of the nodes that are left
    left = shared.select("node").distinct()
    bits = rows.select("node", "bits").filter(maybe_in(left, "node", F.col("node"))).groupBy("node").agg(F.first("bits").alias("bits"))
    nodes = cut_lineage(classes.join(left, "node", "left_semi").join(bits, "node"))
    del left, bits

    # both sides of the join are plain exchanges, so the rows of a common shingle can be split
    hubs = _hubs(shared)
    star = shared.join(hubs, "token")
    # two hubs of a shingle are paired once, at the smaller one
    partners = F.when(F.array_contains("hubs", F.col("node")), F.filter("hubs", lambda h: h < F.col("node"))).otherwise(F.col("hubs"))
    first = cut_lineage(star.select("node", F.explode(partners).alias("hub"))
                   .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct())
    others = cut_lineage(star.filter(~F.array_contains("hubs", F.col("node"))).select("token", "node"))
    del shared, hubs, star
    release(spark)
    close = cut_lineage(_may_link(first, nodes))
    links = cut_lineage(_linked(close, docs, nodes))
    del first, close
    label = components(links)
    del links
    release(spark)

    # nodes not compared yet share enough shingles among those that are left, across components
    named = others.join(label, "node", "left").select("token", "node", F.coalesce("label", "node").alias("label"))
    mixed = cut_lineage(named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("token"))
    apart = cut_lineage(others.join(mixed, "token", "left_semi").select("token", "node"))
    del others, named, mixed
    apart = _with_enough_shared(apart, nodes)
    low = apart.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LOWEST).alias("low"))
    about = nodes.select("node", "bits").join(low, "node").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = cut_lineage(_tile_pairs(apart.join(nodes.select("node", "n"), "node"), about))
    del apart, low, about
    release(spark)
    if not rest.isEmpty():
        more = _linked(rest, docs, nodes)
        last, label = label, components(label.filter("node <> label").select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(more))
    del rest, nodes
    release(spark)
    return rows, classes, label


def _named(rows: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, node, check, n_shingles, component_id of every row."""
    home = classes.select("node", "check", "min_doc").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = home.groupBy("label").agg(F.min("min_doc").alias("component_id"))
    of = home.join(smallest, "label").select("node", "check", "component_id")
    return (rows.select("doc_id", "n", "node", "check").join(of, ["node", "check"], "left")
            .select("doc_id", "node", "check", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))


def link_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included) of every row."""
    return _named(*_labelled(docs)).drop("node", "check")


def count_links(docs: DataFrame, block: int = BLOCK_SHINGLES) -> DataFrame:
    """``link_documents`` with n_links of every row: the other rows it links with, those of an equal set included."""
    rows, classes, label = _labelled(docs)
    nodes = classes.groupBy("node").agg(F.min("min_doc").alias("min_doc"), F.max("n").alias("n"), F.sum("copies").alias("copies"))
    counts = _block_links(docs, nodes.join(label, "node"), block).groupBy("node").agg(F.sum("links").alias("links"))
    own = classes.select("node", "check", "copies").join(counts, "node", "left").select(
        "node", "check", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return (_named(rows, classes, label).join(own, ["node", "check"], "left")
            .select("doc_id", "n_shingles", "component_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))


def _with_sets(docs: DataFrame) -> DataFrame:
    """``docs`` with __node and __check of their sets (null without words)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in _sets(b):
                part = b.slice(i, len(sets))
                hashes = [(_node(h), _check(h)) if len(h) else (None, None) for h in sets]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([x[k] for x in hashes], pa.int64()) for k in (0, 1)]],
                                                 names=[*part.schema.names, "__node", "__check"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__node", LongType()), StructField("__check", LongType())]))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component of linked rows, columns as given: the row of the smallest id.

    Decided by row: an id that occurs with two texts keeps the one that no row of a smaller id is linked with, and of
    rows with one id and one set one stays. Rows without an id are the last choice of their component. Rows without
    words link with nothing and stay.
    """
    rows, classes, label = _labelled(docs)
    home = classes.select("node", "check").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keyed = stored(rows.filter("n > 0").groupBy("doc_id", "node", "check").agg(F.count(F.lit(1)).alias("m")).join(home, ["node", "check"]), "ngram-keyed")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "check")
    first = keyed.groupBy("label").agg(F.min(place).alias("f"), F.min_by("m", place).alias("m"), F.count(F.lit(1)).alias("c"))
    chosen = stored(first.select(F.col("f.doc_id").alias("__id"), F.col("f.node").alias("__node"), F.col("f.check").alias("__check"), "m", "c", "label"), "ngram-chosen")
    # ids with a row that may go: in components of several keys, or of several equal rows
    some = chosen.filter("m > 1 OR c > 1").select("label")
    touched = stored(keyed.join(some, "label", "left_semi").select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ngram-touched")
    free(rows, classes, label, keyed)
    hit = maybe_in(touched, "doc_id", F.col("doc_id")) | F.col("doc_id").isNull()
    asked = _with_sets(docs.filter(hit))
    stay = chosen.select("__id", F.col("__node").alias("__n"), F.col("__check").alias("__c"), "m")
    found = asked.filter("__node IS NOT NULL").join(stay, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__node") == F.col("__n")) & (F.col("__check") == F.col("__c")))
    single = found.filter("m = 1").select(*docs.columns)
    equal = found.filter("m > 1").dropDuplicates(["doc_id", "__node", "__check"]).select(*docs.columns)
    release(docs.sparkSession)
    return (docs.filter(~hit).unionByName(asked.filter("__node IS NULL").select(*docs.columns)).unionByName(single).unionByName(equal))
