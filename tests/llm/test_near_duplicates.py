"""Near duplicates: exact word sets, one row a group, and the pipeline against a plain version."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, text
from waitwise.llm import ngramjoin, quality
from waitwise.llm.common import PrimeHash, table

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    bits = np.array([bin(i).count("1") % 2 for i in range(n)])
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_modulo_a_power_of_two_are_told_apart(spark):
    a, b = thue_morse(1024)
    sets = [ngramjoin.shingle_sets(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])) for w in (a, b)]
    assert not np.array_equal(sets[0][0], sets[1][0])
    got = ngramjoin.link_documents(spark.createDataFrame([(1, a), (2, b), (3, a.upper())], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 2), (3, 1)}


def test_hash_of_a_substring_does_not_depend_on_its_place():
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    h = PrimeHash(buf)
    start = rng.integers(0, 4990, 3000)
    size = rng.integers(1, 9, 3000)
    got = h(start, start + size)
    by = {}
    for s, n, x in zip(start.tolist(), size.tolist(), got.tolist()):
        assert by.setdefault(buf[s:s + n].tobytes(), x) == x
    assert len(set(by.values())) == len(by)


def test_one_row_of_each_group_stays(spark):
    rng = np.random.default_rng(8)
    a, clean, b = text(rng, 60), text(rng, 60), text(rng, 40)
    near = a.replace(a.split()[30], "changed", 1)
    rows = [(1, a), (1, a), (2, a), (3, clean), (3, a), (4, None), (4, None), (5, ""), (None, near), (None, b), (None, b), (7, near.upper()), (8, text(rng, 50)), (8, text(rng, 50))]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, node int, label string").repartition(4)
    got = ngramjoin.keep_first(docs)
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert left == sorted([(1, a), (3, clean), (4, None), (4, None), (5, ""), (None, b), rows[12], rows[13]], key=str)


def test_null_ids_take_part(spark):
    rng = np.random.default_rng(9)
    t = text(rng, 30)
    got = ngramjoin.count_links(spark.createDataFrame([(None, t), (5, t), (None, text(rng, 30))], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["n_links"]) for r in got) == [("5", "5", 1), ("None", "5", 1), ("None", "None", 0)]


def words(t, pattern):
    return re.findall(pattern, "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def test_pipeline_equals_a_plain_version(spark):
    """run() stage by stage: what each stage keeps is checked against plain code on its own input."""
    docs = table(spark, SF, "documents")
    labels = table(spark, SF, "labels")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, SF).collect()
    model = quality.fit_quality(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.select("doc_id", "text"), model).collect()}
    assert {r["doc_id"] for r in kept} == {i for i, s in scored.items() if s >= 0.5}

    good = spark.createDataFrame(kept, docs.schema)
    first = stages["near_duplicates"](spark, good, SF).collect()
    smallest = {c for _, n, c in brute_components([(r["doc_id"], r["text"]) for r in kept])}
    assert {r["doc_id"] for r in first} == smallest and len(first) == len(smallest)

    unique = spark.createDataFrame(first, docs.schema)
    clean = stages["decontamination"](spark, unique, SF).collect()
    pattern = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    windows = set()
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"], pattern)
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    want = set()
    for r in first:
        w = words(r["text"], pattern)
        if not any(tuple(w[i:i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in clean} == want

    mixed = stages["mixing"](spark, spark.createDataFrame(clean, docs.schema), SF).collect()
    assert {r["doc_id"] for r in mixed} <= want and mixed            # rows by rates: thinned or repeated, never new
    last = stages["sharding"](spark, spark.createDataFrame(mixed, docs.schema), SF).collect()
    crc = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in mixed}
    assert len(last) == len(mixed) and all(r["text_crc32"] == crc[r["doc_id"]] for r in last)
    for s in range(8):
        slots = sorted(r["slot"] for r in last if r["shard"] == s)
        assert slots == list(range(len(slots)))
    full = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in full) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in last)


def test_shuffled_shingles_go_before_the_next_step(spark, monkeypatch):
    # the shuffle of every sent shingle is let go before the next one is written, not after both
    steps = []
    cut, release = ngramjoin.cut_lineage, ngramjoin.release
    monkeypatch.setattr(ngramjoin, "cut_lineage", lambda df: steps.append("cut") or cut(df))
    monkeypatch.setattr(ngramjoin, "release", lambda s: steps.append("release") or release(s))
    rng = np.random.default_rng(3)
    a = text(rng, 60)
    docs = spark.createDataFrame([(1, a), (2, a + " more"), (3, text(rng, 60))], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngramjoin.link_documents(docs).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
    assert steps[:4] == ["cut", "release", "cut", "release"]


def test_bitmaps_are_shuffled_once_a_dealt_row(spark):
    members = spark.createDataFrame([(5, 1, 100), (5, 2, 100)], "token long, node long, n long")
    nodes = spark.createDataFrame([(1, 1, bytearray(512), [5]), (2, 2, bytearray(512), [5])], "node long, label long, bits binary, low array<long>")
    pairs = ngramjoin._tile_pairs(members, nodes)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    order = pairs._jdf.queryExecution().optimizedPlan().toString()
    by_tile = [x for x in order.splitlines() if "Join Inner" in x]
    assert len(by_tile) == 2 and "node" in by_tile[0] and "token" in by_tile[1]
