"""Alignment of two tokenizers over the same bytes, by merge-path partitioning.

Each text is encoded by A (byte-level BPE) and B (sentencepiece); both lists of token ends are sorted byte
offsets over the same bytes. Their merge is a path through the (A, B) grid that takes the smaller end, A first
on ties. Diagonals at equal distances cut the path into pieces of equal work; a binary search along each
diagonal finds where the path crosses it, so every piece starts by itself. All pieces of a block walk side by
side, one numpy lane each: a step emits the overlap of its two tokens (a link), a step at which both tokens end
closes a group. Group numbers are counted inside each piece and stitched by a running sum over the pieces.

The corpus-wide counts of linked id pairs are one grouped sum. They go back to the documents in slices of at
most ``SLICE`` pairs (a broadcast of that size each, as many slices as there are pairs to hold): pairs are
bounded by the two vocabularies, not by the rows.

Edge cases: null and empty texts, and texts whose joined A or B bytes differ from space + text, have no tokens
(zeros, digest ''); rows without an id or with a repeated id are rows of their own; an empty table gives an
empty result; a text is encoded whole, however long (its links are held ``CHUNK`` lanes at a time); other
columns of the input are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitwise.llm.common import stored, text_blocks, union_all

#: Where the public tokenizer files lie; every function takes other paths.
TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"

#: Merge steps of a piece, pieces walked at once, bytes of text in a block.
PIECE, CHUNK, BLOCK = 48, 1 << 15, 1 << 20
#: Pairs of a slice of the count table (17 bytes each, sent to every worker).
SLICE = 2_000_000
_FAR = np.int64(1) << np.int64(62)

# Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer runs of white space overflow the stack of the faster encoder's pattern engine.
_LONG_SPACE = re.compile(r"\s{400}")
_BY_SPACE = re.compile(r"\s | \s")


def byte_alphabet() -> dict[str, int]:
    """Character of a byte-level vocabulary entry -> byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Tokenizer A. Merges whose order is the order of ids (checked) run in the faster of two equal encoders."""

    def __init__(self, raw: bytes):
        self._raw, self._slow = raw, None
        spec = json.loads(raw)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec.get("added_tokens") or [] if t.get("special")}
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        ranks = {}
        for piece, i in vocab.items():
            if piece in special:
                self.bytes[i] = piece.encode()
            else:
                self.bytes[i] = bytes(alphabet[c] for c in piece)
                ranks[self.bytes[i]] = i
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        plain = (merged == sorted(merged) and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and not spec.get("normalizer") and all(bytes([b]) in ranks for b in range(256)))
        self._fast, self.cuts_at_spaces = None, plain
        if plain:
            import tiktoken
            self._fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self._fast is not None and not _LONG_SPACE.search(text):
            return self._fast.encode_to_numpy(text, disallowed_special=())
        if self._slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_str(self._raw.decode())
            self._slow.encode_special_tokens = True
        return np.array(self._slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)


class PieceBPE:
    """Tokenizer B, which puts a space before the text."""

    def __init__(self, raw: bytes):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.bytes = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
                      for i, p in ((i, self._model.id_to_piece(i)) for i in range(self._model.get_piece_size()))]

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self._model.encode_as_numpy(text)).astype(np.uint32)


class Words(dict):
    """Number of each word met, in the order of meeting; ``new`` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Ragged:
    """Growing lists of ids, one a word."""

    def __init__(self):
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, ids: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.ids = np.concatenate([self.ids, *ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(sizes))])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of ``rows`` end to end, and their lengths."""
        size = self.ends[rows + 1] - self.ends[rows]
        at = np.cumsum(size) - size
        return self.ids[np.repeat(self.ends[rows] - at, size) + np.arange(int(size.sum()))], size


class Pair:
    """Both tokenizers, and the ids of words already met.

    A text whose spaces all stand between characters other than white space is encoded word by word, which gives
    the same ids: A's pattern cuts before each such space, and no token of B holds a space after another
    character. New words are encoded together, ``TOGETHER`` at a time with spaces between them, and cut apart.
    """

    MOST, LONGEST, TOGETHER = 300_000, 64, 200

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.a, self.b = ByteBPE(raw_a), PieceBPE(raw_b)
        self.len_a, self.len_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b))
        self.by_word = self.a.cuts_at_spaces and not any(re.search(rb"[^ ] ", x) for x in self.b.bytes)
        self._forget()

    def _forget(self) -> None:
        self._words, self._a, self._b, self._wrong = Words(), Ragged(), Ragged(), np.zeros(0, bool)

    def whole(self, text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
        """Ids of both for space + text, and whether both stand for just those bytes."""
        word = text.decode("utf-8")
        ids_a, ids_b = self.a.encode(" " + word), self.b.encode(word)
        return ids_a, ids_b, all(b"".join(map(t.bytes.__getitem__, x.tolist())) == b" " + text for t, x in ((self.a, ids_a), (self.b, ids_b)))

    def _learn(self) -> None:
        new, self._words.new = self._words.new, []
        found: tuple[list, ...] = ([], [], [], [])             # ids and sizes of A, of B
        wrong = np.zeros(len(new), bool)
        for i in range(0, len(new), self.TOGETHER):
            text = " ".join(new[i:i + self.TOGETHER]).encode()
            ids_a, ids_b, right = self.whole(text)
            if right:
                ends = np.append(np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1, len(text) + 1)
                sizes = [np.diff(np.searchsorted(np.cumsum(size[ids]), ends) + 1, prepend=0)
                         for ids, size in ((ids_a, self.len_a), (ids_b, self.len_b))]
            else:
                each = [self.whole(w.encode()) for w in new[i:i + self.TOGETHER]]
                ids_a, ids_b = (np.concatenate([x[k] for x in each]) for k in (0, 1))
                sizes = [np.array([len(x[k]) for x in each]) for k in (0, 1)]
                wrong[i:i + len(each)] = [not x[2] for x in each]
            for into, x in zip(found, (ids_a, sizes[0], ids_b, sizes[1]), strict=True):
                into.append(x)
        if new:
            self._a.add(found[0], found[1])
            self._b.add(found[2], found[3])
            self._wrong = np.concatenate([self._wrong, wrong])

    def tokens(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of both for each text; none if either's bytes are not space + text."""
        none = np.zeros(0, np.uint32)
        out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * len(texts)
        whole, rows, numbers = [], [], []
        if len(self._words) > self.MOST:
            self._forget()
        for i, raw in enumerate(texts):
            if not raw:
                continue
            text = raw.decode("utf-8")
            words = text.split(" ") if self.by_word and not (_BY_SPACE.search(text) or text[0].isspace() or text[-1].isspace()) else []
            if words and max(map(len, words)) <= self.LONGEST:
                rows.append(i)
                numbers.append(np.fromiter(map(self._words.__getitem__, words), np.int64, len(words)))
            else:
                whole.append(i)
        self._learn()
        if rows:
            flat, sizes = np.concatenate(numbers), [len(x) for x in numbers]
            first = np.cumsum([0, *sizes])[:-1]
            taken = [r.take(flat) for r in (self._a, self._b)]
            parts = [np.split(ids, np.cumsum(np.add.reduceat(size, first))[:-1]) for ids, size in taken]
            bad = np.logical_or.reduceat(self._wrong[flat], first)
            for i, ids_a, ids_b, wrong in zip(rows, *parts, bad.tolist(), strict=True):
                if wrong:
                    whole.append(i)
                else:
                    out[i] = ids_a, ids_b
        for i in whole:
            ids_a, ids_b, right = self.whole(texts[i])
            if right:
                out[i] = ids_a, ids_b
        return out


_LOADED: dict[str, Pair] = {}


def _loaded(raw_a: bytes, raw_b: bytes) -> Pair:
    """One pair of tokenizers a worker process, however many tasks it runs."""
    key = hashlib.sha256(raw_a).hexdigest() + hashlib.sha256(raw_b).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pair(raw_a, raw_b)
    return _LOADED[key]


# --------------------------------------------------------------------------- merge path

def crossings(a_end: np.ndarray, b_end: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many A tokens the merge has taken when it crosses each diagonal: one binary search a diagonal, all at once."""
    low, high = np.maximum(diagonals - len(b_end), 0), np.minimum(diagonals, len(a_end))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        take = open_ & (a_end[np.minimum(mid, len(a_end) - 1)] <= b_end[np.clip(diagonals - 1 - mid, 0, len(b_end) - 1)])
        low, high = np.where(take, mid + 1, low), np.where(open_ & ~take, mid, high)


def merge_pieces(a_end: np.ndarray, b_end: np.ndarray, piece: int = PIECE, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, ...]]:
    """Walk the merge of two lists of token ends over the same bytes, ``chunk`` pieces of ``piece`` steps at a time.

    Gives for each chunk, in path order: A and B token of each link; A tokens taken, with their group; B tokens
    taken, with their group. Groups are numbered over the whole merge, whatever piece they begin and end in.
    """
    na, nb = len(a_end), len(b_end)
    pad = np.full(piece + 1, _FAR)
    ea, eb = np.concatenate([a_end, pad]), np.concatenate([b_end, pad])
    sa, sb = np.concatenate([[0], ea[:-1]]), np.concatenate([[0], eb[:-1]])
    starts = np.arange(0, na + nb, piece)
    base = 0
    for lo in range(0, len(starts), chunk):
        d = starts[lo:lo + chunk]
        i = crossings(a_end, b_end, d)
        j = d - i
        shape = (piece, len(d))
        at_a, at_b = np.empty(shape, np.int32), np.empty(shape, np.int32)
        link, took_a, closes = np.empty(shape, bool), np.empty(shape, bool), np.empty(shape, bool)
        for t in range(piece):
            end_a, end_b = ea[i], eb[j]
            at_a[t], at_b[t] = i, j
            np.less(np.maximum(sa[i], sb[j]), np.minimum(end_a, end_b), out=link[t])
            step = np.less_equal(end_a, end_b, out=took_a[t])
            # B ends where the A token before it ended: both are taken now
            np.logical_and(~step, end_b == sa[i], out=closes[t])
            i = i + step
            j = j + ~step
        steps = min(na + nb - int(d[0]), piece * len(d))
        flat = [x.T.ravel()[:steps] for x in (at_a, at_b, link, took_a, closes)]
        at_a, at_b, link, took_a, closes = flat
        # groups closed before each step: counted per piece, stitched by the running sum over the pieces
        group = base + np.cumsum(closes) - closes
        base += int(closes.sum())
        took_b = ~took_a
        yield at_a[link], at_b[link], at_a[took_a], group[took_a], at_b[took_b], group[took_b]


# --------------------------------------------------------------------------- one block of texts

def _decimals(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n - 1 as rows of bytes with room for a separator, and their lengths."""
    text = np.array([str(i).encode() for i in range(n)])
    width = text.dtype.itemsize
    rows = np.zeros((n, width + 1), np.uint8)
    rows[:, :width] = text.view(np.uint8).reshape(n, width)
    return rows, np.char.str_len(text)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _DIGITS:
        _DIGITS[n] = _decimals(n)
    return _DIGITS[n]


class Block:
    """Tokens, links and groups of the texts of one block, laid end to end."""

    def __init__(self, texts: list[bytes], both: Pair):
        pairs = both.tokens(texts)
        self.n_a = np.array([len(x) for x, _ in pairs], np.int64)
        self.n_b = np.array([len(y) for _, y in pairs], np.int64)
        self.a = np.concatenate([x for x, _ in pairs]).astype(np.int64)
        self.b = np.concatenate([y for _, y in pairs]).astype(np.int64)
        doc_a, doc_b = np.repeat(np.arange(len(texts)), self.n_a), np.repeat(np.arange(len(texts)), self.n_b)
        self.group_a, self.group_b = np.empty(len(self.a), np.int64), np.empty(len(self.b), np.int64)
        self.n_links = np.zeros(len(texts), np.int64)
        size_b = len(both.b.bytes)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(self.a):
            for la, lb, ta, ga, tb, gb in merge_pieces(np.cumsum(both.len_a[self.a]), np.cumsum(both.len_b[self.b])):
                self.group_a[ta], self.group_b[tb] = ga, gb
                docs = doc_a[la]
                self.n_links += np.bincount(docs, minlength=len(texts))
                found.append(_summed_pairs(docs, self.a[la] * size_b + self.b[lb]))
        if len(found) > 1:
            d, k, n = (np.concatenate(x) for x in zip(*found, strict=True))
            found = [_summed_pairs(d, k, n)]
        self.pair_doc, self.pair, self.pair_n = found[0] if found else (np.zeros(0, np.int64),) * 3
        # a document's last tokens end together, so no group holds tokens of two documents
        last = np.cumsum(self.n_a) - 1
        closed = np.where(last >= 0, self.group_a[np.maximum(last, 0)] + 1, 0) if len(self.a) else np.zeros(len(texts), np.int64)
        self.n_groups = np.where(self.n_a > 0, np.diff(closed, prepend=0), 0)

    def digests(self, digits_a, digits_b) -> list[str]:
        """sha256 of ``a1,a2|b1;a3|b2,b3`` for each text; '' without tokens."""
        if not len(self.a):
            return [""] * len(self.n_a)
        groups = int(self.group_a[-1]) + 1
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        to_a, to_b = np.cumsum(in_a), np.cumsum(in_b)
        pos_a = np.arange(len(self.a)) + (to_b - in_b)[self.group_a]
        pos_b = np.arange(len(self.b)) + to_a[self.group_b]
        width = max(digits_a[0].shape[1], digits_b[0].shape[1])
        out = np.zeros((len(self.a) + len(self.b), width), np.uint8)
        size = np.empty(len(out), np.int64)
        for ids, pos, (rows, length), ends, sign in ((self.a, pos_a, digits_a, to_a, b"|"), (self.b, pos_b, digits_b, to_b, b";")):
            out[pos, :rows.shape[1]] = rows[ids]
            mark = np.full(len(ids), ord(","), np.uint8)
            mark[ends - 1] = sign[0]
            out[pos, length[ids]] = mark
            size[pos] = length[ids] + 1
        flat = out.ravel()
        flat = flat[flat != 0]
        bounds = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])]
        return [hashlib.sha256(flat[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(bounds[:-1], bounds[1:], strict=True)]


def _summed_pairs(docs: np.ndarray, keys: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each (document, pair) once with its number of links, in order."""
    order = np.lexsort((keys, docs)) if len(docs) and (docs[0] != docs[-1] or n is not None) else np.argsort(keys, kind="stable")
    docs, keys = docs[order], keys[order]
    first = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if n is None else np.add.reduceat(n[order], first) if len(first) else np.zeros(0, np.int64)
    return docs[first], keys[first], sums


# --------------------------------------------------------------------------- Spark

_DIGEST = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_TOKENS = "a_ids array<int>, b_ids array<int>, a_groups array<long>, b_groups array<long>"
_PAIRS = "pairs array<long>, links array<long>"


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def _align_fn(raw, keep_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*raw.value)
        digits_a, digits_b = _digits(len(both.a.bytes)), _digits(len(both.b.bytes))
        for batch in batches:
            for i, j, data, offs in text_blocks(batch.column("text"), BLOCK):
                block = Block([data[offs[k]:offs[k + 1]].tobytes() for k in range(j - i)], both)
                cols = {"doc_id": batch.column("doc_id").slice(i, j - i), "n_a": block.n_a, "n_b": block.n_b, "n_groups": block.n_groups,
                        "n_links": block.n_links, "groups_sha256": block.digests(digits_a, digits_b)}
                if keep_tokens:
                    first = np.concatenate([[0], np.cumsum(block.n_groups)])[:-1]
                    cols |= {"a_ids": _lists(block.a, block.n_a, pa.int32()), "b_ids": _lists(block.b, block.n_b, pa.int32()),
                             "a_groups": _lists(block.group_a - np.repeat(first, block.n_a), block.n_a, pa.int64()),
                             "b_groups": _lists(block.group_b - np.repeat(first, block.n_b), block.n_b, pa.int64())}
                sizes = np.bincount(block.pair_doc, minlength=j - i)
                cols |= {"pairs": _lists(block.pair, sizes, pa.int64()), "links": _lists(block.pair_n, sizes, pa.int64())}
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in cols.values()],
                                                 names=list(cols))
    return run


def align_documents(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, keep_tokens: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and its linked id pairs
    (``pairs``: A id * size of B + B id, each once; ``links``: how many links hold it).

    ``keep_tokens`` adds the ids of both tokenizers with the group number (from 0) of each token. The two files
    are read by the driver and sent along, so workers need no copy.
    """
    raw = docs.sparkSession.sparkContext.broadcast((open(a_file, "rb").read(), open(b_file, "rb").read()))     # 2 MB, whatever the corpus
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_DIGEST}, {_TOKENS + ', ' if keep_tokens else ''}{_PAIRS}"
    return docs.select("doc_id", "text").mapInArrow(_align_fn(raw, keep_tokens), schema)


def token_groups(aligned: DataFrame) -> DataFrame:
    """(doc_id, group_no, a_ids, b_ids): the aligned groups of ``align_documents(..., keep_tokens=True)``.

    Rows that share a doc_id give their groups under that id each.
    """
    def part(side: str, g: str) -> str:
        return f"transform(filter(arrays_zip({side}_ids, {side}_groups), x -> x.{side}_groups = {g}), x -> x.{side}_ids)"
    rows = aligned.filter("n_groups > 0").select("doc_id", "a_ids", "b_ids", "a_groups", "b_groups",
                                                 F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_groups") - 1)).alias("group_no"))
    return rows.select("doc_id", "group_no", F.expr(part("a", "group_no")).alias("a_ids"), F.expr(part("b", "group_no")).alias("b_ids"))


def pair_counts(aligned: DataFrame, b_size: int) -> DataFrame:
    """(pair, n, best): links that hold each id pair in the corpus, and whether no pair of its B id has more."""
    rows = aligned.select(F.explode(F.arrays_zip("pairs", "links")).alias("x"))
    counts = rows.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.links").alias("n"))
    # a B id has at most as many pairs as A has ids
    return counts.withColumn("best", F.col("n") == F.max("n").over(W.partitionBy(F.col("pair") % b_size)))


def _score_fn(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = held.value
        for batch in batches:
            pairs = batch.column("pairs")
            flat = np.asarray(pairs.flatten())
            links = np.asarray(batch.column("links").flatten())
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = keys[at] == flat if len(keys) else np.zeros(len(flat), bool)
            count = np.where(hit, n[at], 0) if len(keys) else np.zeros(len(flat), np.int64)
            top = np.where(hit & best[at], links, 0) if len(keys) else count
            ends = np.concatenate([[0], np.cumsum(np.asarray(pairs.value_lengths()))])
            total = [np.concatenate([[0], np.cumsum(x)]) for x in (top, count * links)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(t[ends[1:]] - t[ends[:-1]]) for t in total]], names=["row", "n_best", "count_sum"])
    return run


def alignment_digest(docs: DataFrame, a_file: str = A_FILE, b_file: str = B_FILE, slice_pairs: int = SLICE) -> DataFrame:
    """``align_documents`` with n_best (links whose pair is the commonest of its B id) and count_sum (of the
    corpus-wide counts, over links) per document."""
    spark = docs.sparkSession
    aligned = stored(align_documents(docs, a_file, b_file).withColumn("row", F.monotonically_increasing_id()), "aligned")
    b_size = len(PieceBPE(open(b_file, "rb").read()).bytes)
    counts = stored(pair_counts(aligned, b_size), "aligned-counts")
    slices = max(1, -(-counts.count() // slice_pairs))
    parts = []
    for s in range(slices):
        own = counts.filter(F.pmod(F.xxhash64("pair"), F.lit(slices)) == s).toArrow()
        keys = np.asarray(own.column("pair"))
        order = np.argsort(keys)
        held = spark.sparkContext.broadcast((keys[order], np.asarray(own.column("n"))[order], np.asarray(own.column("best"))[order]))
        parts.append(aligned.select("row", "pairs", "links").mapInArrow(_score_fn(held), "row long, n_best long, count_sum long"))
    sums = union_all(parts).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return (aligned.drop("pairs", "links").join(sums, "row")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))
