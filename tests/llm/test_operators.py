"""Corpus operators against brute force on small fixtures and the smallest given tables."""

import collections
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waitwise.llm import ann, decontaminate, htmltext, mixing, ngramjoin, pii, quality, repeats, sharding, urlfilter
from waitwise.llm.common import table, without_ids
from waitwise.llm.queries import URL_RULES

SF = "/root/testdata/sf0.001"
WORDS = "the of and to in is was for that with on as by at from or an be this are".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.integers(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, empties, nulls, a repeated id; an extra column of a clashing name."""
    rng = np.random.default_rng(3)
    base, passage = text(rng, 80), text(rng, 60)
    rows = [(i, text(rng, int(rng.integers(1, 120)))) for i in range(30)]
    rows += [(100 + i, base) for i in range(8)] + [(200 + i, base.replace("the", f"x{i}", 1)) for i in range(12)]
    rows += [(300 + i, text(rng, 20) + "\n" + passage + " " + text(rng, 15)) for i in range(6)]
    rows += [(400, ""), (401, None), (402, "one two"), (403, "ONE  two"), (404, "é" * 300), (405, "ab" * 700), (0, rows[0][1])]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tile string, n long").repartition(5)


def brute_components(rows):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                u, v = find(i), find(j)
                parent[max(u, v)] = min(u, v)
    return {(i, len(x), find(i)) for i, x in sets}


def test_ngram_join_equals_brute_force(corpus):
    rows = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    got = {tuple(r) for r in ngramjoin.link_documents(corpus).collect()}
    assert got == brute_components(rows)


def test_ngram_join_of_nothing(corpus):
    assert ngramjoin.link_documents(corpus.limit(0)).count() == 0


def test_overlap_bound_never_falls_below_the_overlap():
    rng = np.random.default_rng(1)
    for n in (1, 5, 60, 400):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2 + 1], rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))
        x, y = ngramjoin.bitmap(a), ngramjoin.bitmap(b)
        short = min(len(x), len(y))
        differ = int(np.bitwise_count(ngramjoin.fold(x, short) ^ ngramjoin.fold(y, short)).sum())
        true = len(set(a.tolist()) & set(b.tolist()))
        assert ngramjoin.overlap_bound(len(a), len(b), differ) >= true == ngramjoin.intersection(a, b)


def test_repeats_equal_brute_force(corpus):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in corpus.collect()]
    seen = collections.Counter(t[i:i + 200] for _, t in rows for i in range(len(t) - 199))
    want = collections.Counter()
    for i, t in rows:
        hit = np.zeros(len(t), bool)
        for p in range(len(t) - 199):
            if seen[t[p:p + 200]] > 1:
                hit[p:p + 200] = True
        kept = bytes(b for b, h in zip(t, hit) if not h)
        want[(i, len(t), int(hit.sum()), int((np.diff(np.concatenate([[0], hit.astype(int), [0]])) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    assert collections.Counter(tuple(r) for r in repeats.removal_digest(corpus).collect()) == want


def test_jump_hash_equals_the_published_recurrence(spark):
    def jump(key, n):
        key &= 2**64 - 1
        b, j = -1, 0
        while j < n:
            b = j
            key = (key * 2862933555777941757 + 1) & (2**64 - 1)
            j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
        return b
    seeds = [0, 1, -1, 2**63 - 1, -2**63, 42, 10**15]
    df = spark.createDataFrame([(s,) for s in seeds], "s long")
    for n in (1, 2, 8, 9, 100):
        got = {r[0]: r[1] for r in df.select("s", sharding.jump_hash(F.col("s"), n)).collect()}
        assert got == {s: jump(s, n) for s in seeds}


def test_shards_have_gapless_slots_and_grow_into_the_new_shard_only(corpus):
    rows = sharding.shard_documents(corpus, 8).collect()
    assert len(rows) == corpus.count()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by = {r["doc_id"]: r for r in rows}
    assert by[401]["size"] == 1 and by[404]["size"] == 601 and by[405]["text_crc32"] == zlib.crc32(b"ab" * 700)
    assert sharding.shard_documents(corpus.limit(0), 8).count() == 0


def test_url_rules_equal_direct_matching(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/x?y", "https://www.example.com/en/", "http://x.net/es/1", "http://net/fr/", "http://xnet/fr/",
            "http://b.com", "ftp://q.com/?a", "http://x.net/de/#f", "http://deep.www.example.com/en/a/b", "http://com/"]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    for r in urlfilter.judge_urls(df, URL_RULES).collect():
        fits = [x for x in URL_RULES if r["host"] and (r["host"] == x.host or r["host"].endswith("." + x.host)) and r["path"].startswith(x.path)]
        best = max(fits, key=lambda x: len(x.key), default=None)
        assert (r["rule"], r["verdict"]) == ((best.key, best.action) if best else (None, "allow")), r
    assert urlfilter.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urlfilter.judge_urls(df, []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("xxhash64(key) % 13 = 0")
    cascade = urlfilter.build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.filter(cascade.contains(F.col("key")) != (F.expr("xxhash64(key) % 13 = 0")))
    assert wrong.count() == 0


def test_recall_of_one_bit_codes(spark):
    vectors = table(spark, SF, "embeddings")
    odd = spark.createDataFrame([(20000, None, 0), (20020, [0.0] * 64, 0), (20040, [float("nan")] * 64, 0), (20060, [1.0], 0)], vectors.schema)
    both = vectors.unionByName(odd)
    got = collections.defaultdict(list)
    for r in ann.search(both, both.filter("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = vectors.collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    hit = total = 0
    for q in got:
        s = (x * x[ids == q][0]).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        assert all(abs(s[ids == v][0] - sc) < 1e-12 for v, sc in got[q])
        hit, total = hit + len(set(best) & {v for v, _ in got[q]}), total + 20
    assert max(got) < 20000 and hit / total >= 0.9
    assert ann.search(both.limit(0), both.limit(0), 20).count() == 0


def test_wu_manber_equals_direct_search():
    rng = np.random.default_rng(5)
    items = [(i, " ".join(rng.choice(list("abcd"), int(rng.integers(0, 15))))) for i in range(12)]
    patterns = decontaminate.Patterns(items, 10)
    for _ in range(40):
        words = list(rng.choice(list("abcd"), int(rng.integers(0, 200))))
        hit, found = set(), set()
        for i, t in items:
            w = t.split()
            n = min(10, len(w))
            for j in range(len(w) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p:p + n] == w[j:j + n]:
                        hit.update(range(p, p + n))
                        found.add(i)
        n, spans, ids = patterns.find(" ".join(words))
        assert n == len(words) and ids == found and {p for s, e in spans for p in range(s, e)} == hit


def test_benchmark_in_parts_gives_the_same(spark, corpus):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    one = decontaminate.contamination_digest(decontaminate.find_benchmark(docs, bench, keep_text=False))
    parts = decontaminate.contamination_digest(decontaminate.find_benchmark(docs, bench, max_part_bytes=4000, keep_text=False))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, parts.collect()))
    assert decontaminate.decontaminate(corpus, bench.limit(0)).count() == corpus.count()


def test_main_text():
    page = ('<html><head><title>x</title><script>var a="<p>";</script></head><body><header>Site</header><nav>a b c</nav>'
            '<div class="cookie-notice">we use cookies</div><article><h1>Head &amp; line</h1><p>one\n two<aside>buy</aside><p>three <b>four</b> five'
            '<div class="ad">ad</div><section class="comments">user says hello</section></article><footer>foot</footer>')
    assert htmltext.main_text(page, htmltext.START) == "Head & line\none two\nthree four five"
    assert htmltext.main_text(None, htmltext.START) == htmltext.main_text("", htmltext.START) == htmltext.main_text("<p>", htmltext.START) == ""
    assert htmltext.best_region([1, -5, 3, -1, 2, -9, 4]) == (2, 5)


def test_surrogates_keep_format_identity_and_distinctness(spark):
    rows = [(1, "a.bé@mail.example.com A.BÉ@MAIL.EXAMPLE.COM +1 (659) 555-3949, 4111 1111 1111 1111, 4111111111111111"),
            (2, "Mr. John Smith, Mrs. Anna Smith, Mr. Smith; Г-н Иван Петров"), (3, None), (4, ""), (5, "v. 2.0 in 1999")]
    rows += [(100 + i, f"id {i:03d}-11-1111") for i in range(300)]
    out = {r["doc_id"]: r["text"] for r in pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    mail, shout, *_ = out[1].split()
    assert shout == mail.upper() and mail != "a.bé@mail.example.com" and re.fullmatch(r"[aeiou]\.[a-z][à-ü]@\w+\.\w+\.com", mail)
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[1])
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    assert (out[3], out[4], out[5]) == (None, "", "v. 2.0 in 1999")
    family = re.findall(r"Mr\. \w+ (\w+), Mrs\. \w+ (\w+), Mr\. (\w+);", out[2])[0]
    assert len(set(family)) == 1 and "Smith" not in out[2] and re.search(r"Г-н [А-Я]\w+ [А-Я]\w+$", out[2])
    ids = [out[100 + i] for i in range(300)]
    assert len(set(ids)) == 300 and not set(ids) & {t for _, t in rows if t}


def test_classifier_scores_do_not_depend_on_the_batch(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality.fit_quality(docs, labels)
    a = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.repartition(1), model).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.score_documents(docs.repartition(7), model).collect()}
    assert a == b and all(0 <= s <= 1 for s in a.values())
    assert quality.fit([], []).scores(np.zeros(0, np.uint8), np.array([0, 0]))[0] == 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held = docs.join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    rows = quality.score_documents(held, quality.fit_quality(docs, labels)).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in rows]) >= 0.95


def test_mixing_meets_its_targets(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = mixing.fit_domains(docs, labels)
    members = mixing.classify(docs, model, ["doc_id"]).cache()
    plan = mixing.mixing_plan(members, mixing.fit_rates(members, model, mixing.TARGETS), model)
    total = plan.agg(*[F.sum(F.col("tokens") * F.col(f"p_{n}") * F.col("rate")) for n in model.names]).first()
    share = np.array(total) / sum(total)
    assert np.abs(share - np.array([mixing.TARGETS[n] for n in model.names])).max() < 0.01
    assert plan.filter("rate < 0").count() == 0 and plan.count() == docs.count()


def test_without_ids_keeps_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (2, "d")], "doc_id long, text string")
    out = without_ids(df, spark.createDataFrame([(2,), (9,)], "doc_id long"))
    assert sorted(r["text"] for r in out.collect()) == ["a", "c"]


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    from waitwise.llm.common import stored
    docs = table(spark, SF, "documents")
    cols = docs.columns
    for name, stage in c.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        if name != "sharding":
            assert docs.columns == cols and 0 < docs.count() <= before.count()
    assert docs.count() == before.count()


@pytest.mark.parametrize("toxic_every", [3, 500])
def test_copies_reach_the_shares_of_skewed_and_short_domains(spark, toxic_every):
    model = mixing.DomainModel(["clean", "toxic"], {}, np.zeros((0, 2)), np.zeros(2))
    cell = F.when(F.col("doc_id") % toxic_every == 0, F.array(F.lit(10), F.lit(990))).otherwise(F.array(F.lit(1000), F.lit(0)))
    members = spark.range(60000).select(F.col("id").alias("doc_id"), F.lit(50).cast("long").alias("tokens"), cell.alias("cell"))
    plan = mixing.mixing_plan(members, mixing.fit_rates(members, model, {"clean": 0.98, "toxic": 0.02}), model)
    for n, tolerance in (("rate", 1e-4), ("copies", 2e-3)):
        clean, toxic = plan.agg(*[F.sum(F.col("tokens") * F.col(f"p_{d}") * F.col(n)) for d in model.names]).first()
        assert abs(toxic / (clean + toxic) - 0.02) < tolerance


def test_rates_leave_out_a_domain_without_tokens(spark):
    model = mixing.DomainModel(["clean", "junk", "toxic"], {}, np.zeros((0, 3)), np.zeros(3))
    members = spark.createDataFrame([(1, 10, [0, 200, 0]), (2, 10, [0, 0, 200])], "doc_id long, tokens long, cell array<int>")
    rates = {tuple(r["cell"]): r["rate"] for r in mixing.fit_rates(members, model, mixing.TARGETS).collect()}
    assert abs(rates[(0, 200, 0)] - 1) < 1e-4 and abs(rates[(0, 0, 200)] - 0.6) < 1e-4


@pytest.mark.parametrize("block", [200, 1 << 19])
def test_links_are_counted_inside_components(spark, corpus, block):
    rng = np.random.default_rng(8)
    long = text(rng, 120).split()
    near = [(1000 + i, " ".join(long[:40 + i] + [f"y{i}"] + long[41 + i:]), "x", 1) for i in range(0, 60, 2)]
    grown = [(2000 + i, " ".join(long[:100 - 3 * i]), "x", 1) for i in range(12)]
    docs = corpus.unionByName(spark.createDataFrame(near + grown + near[:3], corpus.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append((i, frozenset(tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()))
    links = collections.Counter()
    for a, (i, x) in enumerate(sets):
        n = sum(1 for b, (_, y) in enumerate(sets) if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y))
        links[i, len(x), n] += 1
    got = ngramjoin.count_links(docs, block).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got) == links
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


def test_surrogates_of_any_script_and_of_more_forms(spark):
    whole = ["李明@例子.中国", "محمد@مثال.مصر", "דוד@דוגמה.קום", "हिन्दी@उदाहरण.भारत", "홍길동@예시.한국", "ώρα@ήλιος.ελ", "١٢٣@مثال.مصر", "中@中.中",
             "+14155552671", "3782 822463 10005", "01 23 45 67 89", "+33 6 12 34 56 78", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:DB8::1", "fe80::1"]
    named = ["Mr. 李明", "Mrs. محمد عبدالرحمن", "السيد محمد", "श्री मोहन", "Mr. Νίκος"]
    stay = ["-@-.-", "a::b", "12:30:45", "1 22 33 44 55", "_@_.__"]
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(whole + named + stay)], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_entities"]) for r in pii.replace_pii(docs, "k").collect()}
    for i, t in enumerate(whole + named + stay):
        new, n = out[i]
        assert (n == 0 and new == f"x {t} y") if t in stay else n == 1, (t, new, n)
        if t in whole[:8]:
            local, _, domain = t.partition("@")
            a, _, b = new[2:-2].partition("@")
            for x, y in ((local, a), (domain.rpartition(".")[0], b.rpartition(".")[0])):
                assert len(x) == len(y) and (x != y or len(x) == 1) and {unicodedata.name(c).split()[0] for c in y} <= {unicodedata.name(c).split()[0] for c in x}
        elif t not in stay:
            assert not set(re.findall(r"\w{3,}", t)) & set(re.findall(r"\w{3,}", new)) - {"Mrs", "السيد", "श्री"}, (t, new)
            assert new != f"x {t} y"


@pytest.mark.parametrize("wrapper", ["form action=x", "div class='layout sidebar-right'", "div class=has-sidebar", "div class='post-with-comments'",
                                     "div class='entry-content share-enabled'", "div id=page-widget"])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_a_wrapper_of_the_main_text_is_kept(wrapper, inner):
    body = "word " * 60
    tag = wrapper.split()[0]
    side = "<nav>menu here</nav><div class=sidebar>links and links</div><div class=comments>" + "user says " * (40 if inner == "article" else 15) + "</div>"
    for page in (f"<body><{wrapper}><{inner}><p>{body}</p></{inner}>{side}</{tag}></body>",
                 f"<body><{wrapper}><{inner}><p>{body}</p></{inner}></{tag}>{side}</body>",
                 f"<body><main><{wrapper}><{inner}><p>{body}</p></{inner}></{tag}>{side}</main></body>",
                 f"<body><form><{wrapper}><{inner}><p>{body}</p></{inner}></{tag}>{side}</form></body>"):
        assert htmltext.main_text(page, htmltext.START) == body.strip(), page
    beside = f"<body><article><p>{body}</p></article><{wrapper}><{tag}><p>{body * 3}</p></{tag}></{tag}></body>"
    assert htmltext.main_text(beside, htmltext.START) == body.strip()


@pytest.mark.parametrize("part", [1, 1 << 20])
def test_benchmark_items_without_an_id_are_searched(spark, part):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(None, " ".join(words[:12])), (None, "q r"), (7, " ".join(words[20:35]))], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words[:12])), (2, " ".join(words)), (3, "b c")], "doc_id long, text string")
    found = decontaminate.find_benchmark(docs, bench, max_part_bytes=part, keep_text=False)
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in decontaminate.contamination_digest(found).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {1: (12, 1, sha(b""), True), 2: (27, 2, sha(b"7"), True), 3: (0, 0, sha(b""), False)}
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()] == [3]


def test_query_blocks_keep_all_vectors_of_a_repeated_id(spark):
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, rng.normal(size=64).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + i // 3, rng.normal(size=64).tolist()) for i in range(7)], vectors.schema)
    whole, blocks = (sorted(map(tuple, ann.search(vectors, queries, 3, block=n).collect())) for n in (100, 2))
    assert whole == blocks and len(whole) == 9
