"""Block naming, token alignment and whitening against brute force."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waitwise.llm import blocknames, tokalign, whitening
from waitwise.llm.common import table
from waitwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# --------------------------------------------------------------------------- exact duplicates

def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute_groups(rows):
    """(doc_id, keep_id, group_size, sha256) of each row, and how many rows stay in each text."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[lower(t)].append(i)
    out = [(i, max((x for x in by[lower(t)] if x is not None), default=None), len(by[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest())
           for i, t in rows]
    return sorted(out, key=str)


LONG = "".join(chr(97 + i % 23) for i in range(9000))
TEXTS = [(1, "Same text"), (2, "same TEXT"), (2, "same text"), (3, "same text "), (4, None), (5, ""), (None, "ÄB"), (6, "äB"), (7, "ÄB"),
         (8, LONG), (9, LONG.upper()), (10, LONG + "x"), (11, LONG[:4096]), (12, LONG[:4096] + LONG[:4096]), (13, LONG[:4096]),
         (14, "ab" * 2048), (15, "ab" * 2047), (None, None), (16, "é" * 700), (17, "é" * 700)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, row int, key string").repartition(3)


@pytest.mark.parametrize("weak", [False, True])
def test_groups_equal_brute_force(spark, weak):
    # a weak key puts different blocks under one key: names come from the bytes, so nothing changes
    key = (lambda b: F.pmod(F.octet_length(b), F.lit(3)).cast("long")) if weak else blocknames.block_key
    got = blocknames.duplicate_groups(frame(spark, TEXTS), size=64, key=key).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_groups(TEXTS)
    stay = collections.Counter(r["text_sha256"] for r in got if r["kept"])
    assert len(stay) == len({lower(t) for _, t in TEXTS}) and set(stay.values()) == {1}
    assert all(r["keep_id"] == r["doc_id"] for r in got if r["kept"])


def test_keep_last_passes_columns_through(spark):
    docs = frame(spark, TEXTS)
    got = blocknames.keep_last(docs)
    assert got.columns == docs.columns
    kept = collections.Counter(lower(r["text"]) for r in got.collect())
    assert set(kept) == {lower(t) for _, t in TEXTS} and set(kept.values()) == {1}


def test_empty_table_has_no_groups(spark):
    assert blocknames.duplicate_groups(frame(spark, TEXTS).limit(0)).collect() == []
    assert blocknames.keep_last(frame(spark, TEXTS).limit(0)).collect() == []


def test_naming_has_no_python_and_no_cross_join(spark):
    plan = blocknames.duplicate_groups(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))


# --------------------------------------------------------------------------- alignment

@pytest.fixture(scope="module")
def both():
    return tokalign.Pair(open(tokalign.A_FILE, "rb").read(), open(tokalign.B_FILE, "rb").read())


def brute_tokens(both, text):
    """Ids by both libraries from the whole text."""
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokalign.A_FILE)
    a.encode_special_tokens = True
    x, y = a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text).tolist()
    whole = b" " + text.encode()
    if not text or any(b"".join(t.bytes[i] for i in ids) != whole for t, ids in ((both.a, x), (both.b, y))):
        return [], []
    return x, y


def spans(ids, sizes):
    out, at = [], 0
    for i in ids:
        out.append((at, at + int(sizes[i])))
        at = out[-1][1]
    return out


def brute_alignment(both, texts):
    rows, count = [], collections.Counter()
    for text in texts:
        x, y = brute_tokens(both, text or "")
        sx, sy = spans(x, both.len_a), spans(y, both.len_b)
        links = [(a, b) for a, (s, e) in zip(x, sx) for b, (u, v) in zip(y, sy) if max(s, u) < min(e, v)]
        cuts = sorted({e for _, e in sx} & {e for _, e in sy})
        groups, low = [], 0
        for c in cuts:
            groups.append(([a for a, (s, e) in zip(x, sx) if low <= s and e <= c], [b for b, (s, e) in zip(y, sy) if low <= s and e <= c]))
            low = c
        rows.append((x, y, groups, links))
        count.update(links)
    best = collections.defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for x, y, groups, links in rows:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(x), len(y), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if x else ""))
    return out, rows


HARD = [None, "", " ", "a", "two  spaces and a tail ", "\n\nlines\n here\n", "<|endoftext|> x </s> <s> <unk>", "a ▁ piece", "naïve café 文字 🙂 €5",
        "x" + " " * 900 + "y", "tab\there \r\n z", "12345 6789 don't we'll", "same words same words", "same words same words", "w" * 300, "\x00 \x01 a",
        "é" * 200, "The Café the café"]


def test_word_by_word_ids_are_the_whole_texts_ids(both):
    rng = np.random.default_rng(5)
    letters = list(" \n\ta'sé文   bZ1 \r\x1c　<s>-.")
    texts = [t for t in HARD if t] + ["".join(rng.choice(letters, int(rng.integers(1, 50)))) for _ in range(300)]
    got = both.tokens([t.encode() for t in texts])
    assert both.by_word
    for text, (x, y) in zip(texts, got):
        assert (x.tolist(), y.tolist()) == tuple(brute_tokens(both, text)), text


def test_vocabulary_limits_of_the_word_store(both, monkeypatch):
    monkeypatch.setattr(tokalign.Pair, "MOST", 3)
    for text in ("one two three four five", "five six one", "two one"):
        x, y = both.tokens([text.encode()])[0]
        assert (x.tolist(), y.tolist()) == tuple(brute_tokens(both, text))


@pytest.mark.parametrize("piece,chunk", [(1, 1), (3, 2), (48, 1 << 15)])
def test_pieces_are_stitched_whatever_their_size(piece, chunk):
    rng = np.random.default_rng(piece)
    for _ in range(30):
        total = int(rng.integers(1, 60))
        a = np.unique(np.append(rng.integers(1, total + 1, 12), total))
        b = np.unique(np.append(rng.integers(1, total + 1, 9), total))
        parts = list(tokalign.merge_pieces(a, b, piece, chunk))
        la, lb, ta, ga, tb, gb = (np.concatenate(x) for x in zip(*parts))
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert sorted(zip(la.tolist(), lb.tolist())) == [(i, j) for i in range(len(a)) for j in range(len(b)) if max(sa[i], sb[j]) < min(a[i], b[j])]
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert ta.tolist() == list(range(len(a))) and tb.tolist() == list(range(len(b)))
        assert ga.tolist() == [sum(c < e for c in cuts) for e in a] and gb.tolist() == [sum(c < e for c in cuts) for e in b]


@pytest.mark.parametrize("slice_pairs", [7, 1 << 20])
def test_alignment_equals_brute_force(spark, both, slice_pairs):
    texts = HARD + [r["text"] for r in table(spark, SF, "documents").orderBy("n_chars").limit(12).collect()]
    docs = spark.createDataFrame([(i // 2, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, row string, n_a int").repartition(3)
    want, _ = brute_alignment(both, texts)
    got = tokalign.alignment_digest(docs, slice_pairs=200 if slice_pairs == 7 else slice_pairs).collect()
    cols = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(tuple(r[c] for c in cols) for r in got) == sorted((i // 2, *w) for i, w in enumerate(want))


def test_groups_are_listed(spark, both):
    docs = spark.createDataFrame([(1, HARD[8]), (2, None), (3, HARD[11])], "doc_id long, text string")
    got = collections.defaultdict(list)
    for r in tokalign.token_groups(tokalign.align_documents(docs, keep_tokens=True)).orderBy("doc_id", "group_no").collect():
        got[r["doc_id"]].append((r["a_ids"], r["b_ids"]))
    _, rows = brute_alignment(both, [HARD[8], HARD[11]])
    assert dict(got) == {1: rows[0][2], 3: rows[1][2]}


def test_alignment_of_an_empty_table(spark):
    assert tokalign.alignment_digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --------------------------------------------------------------------------- whitening

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1.0) for i, v in rows], "vec_id long, embedding array<double>, x int, n double").repartition(3)


def spectrum(rng, n, values):
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    return (rng.normal(size=(n, len(values))) * np.sqrt(values)) @ turn


def brute_whitening(v):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    values, turn = np.linalg.eigh(z.T @ z / n)
    k = min(16, x.shape[1])
    values, turn = values[::-1], turn[:, ::-1]
    exact = n * x.astype(object) - s.astype(object)
    return n, (exact * exact).sum(axis=1), ((n * x - s) / n @ turn[:, :k]) / np.sqrt(values[:k]), values[:k] / values.sum()


@pytest.mark.parametrize("values", [[50.0 / (i + 1) for i in range(60)], [1e4, 900.0, 800.0] + [3.0 + 0.01 * i for i in range(57)], [9.0, 4.0, 1.0]])
def test_whitening_equals_brute_force(spark, values):
    rng = np.random.default_rng(len(values))
    v = spectrum(rng, 400, values) / 8
    v = np.concatenate([v, v[:40], np.repeat(v[:1], 30, axis=0)])               # copies count once in the fit
    got = whitening.whitening_rows(vectors(spark, [(i // 2, x.tolist()) for i, x in enumerate(v)])).toPandas()
    n, deviation, whitened, share = brute_whitening(v)
    k = whitened.shape[1]
    assert len(got) == len(v) * k and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert sorted(got["deviation"]) == sorted(int(d) for d in deviation for _ in range(k))
    for c in range(1, k + 1):
        mine, want = got[got["component"] == c], whitened[:, c - 1]
        assert abs(mine["explained"].iloc[0] / share[c - 1] - 1) < 1e-9
        mine = mine["whitened"].to_numpy()
        assert min(np.abs(np.sort(mine) - np.sort(s * want)).max() for s in (1, -1)) < 1e-8


def test_unusable_vectors_take_no_part(spark):
    rng = np.random.default_rng(9)
    good = [(i, (rng.normal(size=4)).tolist()) for i in range(20)]
    bad = [(50, None), (51, [1.0, None, 2.0, 3.0]), (52, [1.0, float("nan"), 2.0, 3.0]), (53, [1.0, float("inf"), 2.0, 3.0]), (54, []), (55, [1.0, 2.0]),
           (56, [1e300, 0.0, 0.0, 0.0])]
    got = whitening.whitening_rows(vectors(spark, good + bad + [(None, good[0][1])]))
    assert sorted(got.groupBy("vec_id").count().collect(), key=str) == sorted([(i, 4) for i, _ in good] + [(None, 4)], key=str)


def test_flat_directions_and_empty_tables(spark):
    line = [(i, [float(i), float(i), 1.0]) for i in range(12)]
    got = whitening.whitening_rows(vectors(spark, line)).toPandas()
    assert set(got["component"]) == {1} and got["identity_error"].max() < 1e-9 and abs(got["explained"].iloc[0] - 1) < 1e-12
    assert whitening.whitening_rows(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whitening.whitening_rows(vectors(spark, [(1, None)])).collect() == []


def test_large_values_keep_exact_deviations(spark):
    rows = [(1, [3e9, 1.0]), (2, [-3e9, 2.0]), (3, [5.0, 4e9])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitening_rows(vectors(spark, rows)).collect()}
    x = [[64 * int(c) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = {i: sum((3 * c - t) ** 2 for c, t in zip(v, s)) for (i, _), v in zip(rows, x)}
    assert got == {i: d if d < 2**63 else None for i, d in want.items()}


def test_queries_cover_their_tables(spark):
    n = table(spark, SF, "documents").count()
    assert QUERIES["op13_exact_dedup"](spark, SF).count() == n
    assert QUERIES["op11_token_alignment"](spark, SF).count() == n
    assert QUERIES["op12_whiten_embeddings"](spark, SF).select("vec_id").distinct().count() == table(spark, SF, "embeddings").count()
