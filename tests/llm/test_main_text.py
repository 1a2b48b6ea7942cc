"""Main text of pages: what an article holds stays, and the scan is checked against all regions."""

import random
import time

import pytest

from tests.llm.test_operators import WORDS
from waitwise.llm import htmltext
from waitwise.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def learned(spark):
    return htmltext.learn(htmltext.labelled_pages(table(spark, SF, "pages")))


def some(n, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


CASES = {
    "short article beside a long div": (f"<article><h1>T</h1><p>Short.</p></article><div>{some(100)}</div>", "T\nShort."),
    "linked list": ("<article><p>" + some(20) + "</p><ul>" + "".join(f"<li><a href=x>item {i}</a></li>" for i in range(60)) + "</ul><p>the end</p></article>",
                    "\n".join([some(20), *(f"item {i}" for i in range(60)), "the end"])),
    "table": ("<article><p>" + some(20) + "</p><table>" + "".join(f"<tr><td>a{i}</td><td>b{i}</td></tr>" for i in range(30)) + "</table><p>the end</p></article>",
              "\n".join([some(20), *(x for i in range(30) for x in (f"a{i}", f"b{i}")), "the end"])),
    "names on text": ("<article><p class='related-work'>one two</p><p id='alert-levels'>three</p><section class='related-work'>four</section>"
                      "<div class='related-posts'>five</div><div class='share'>six</div></article>", "one two\nthree\nfour"),
    "teasers": (f"<article>{some(5)}</article><main><article>{some(50, 2)}</article><p>by us</p></main><article>{some(6)}</article>", some(50, 2)),
    "empty mark": (f"<main></main><p>{some(30)}</p>", some(30)),
}


@pytest.mark.parametrize("name", CASES)
def test_the_article_is_kept_whole(name, learned):
    page, want = CASES[name]
    for weights in (htmltext.START, learned):
        assert htmltext.main_text(f"<html><body><nav>a b c</nav>{page}<footer>x y</footer></body></html>", weights) == want


def test_region_is_the_best_of_all(learned):
    rng = random.Random(4)
    for _ in range(200):
        parts = [rng.choice([f"<p>{some(rng.randint(0, 9), rng.random())}</p>", "<div>", "</div>", f"<li><a href=x>{some(2)}</a></li>", "<nav>menu</nav>",
                             "<br>", "<article>", "</article>", f"<td>{some(1)}</td>"]) for _ in range(rng.randint(1, 25))]
        page = htmltext.parse("".join(parts))
        scores = htmltext.item_scores(page, learned)
        best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
        lo, hi = htmltext.best_region(scores)
        assert abs(sum(scores[lo:hi]) - best) < 1e-9


@pytest.mark.parametrize("unit", ["<b>", "<article><p>", "</i>"])
def test_time_is_linear_in_broken_pages(unit):
    page = unit * (200_000 // len(unit)) + "some words"
    t = time.process_time()
    htmltext.main_text(page, htmltext.START)
    small = time.process_time() - t
    t = time.process_time()
    htmltext.main_text(unit * (800_000 // len(unit)) + "some words", htmltext.START)
    assert time.process_time() - t < 10 * max(small, 0.2)


def test_pages_null_empty_and_repeated(spark, learned):
    cols = "page_id long, url string, html string, text string, n_chars int"
    page = "<main><p>one two</p></main>"
    df = spark.createDataFrame([(1, "u", page, "t", 1), (1, "u", page, "t", 1), (2, "v", None, "t", 1), (None, None, "", "t", 1)], cols)
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in htmltext.extract_pages(df, learned).collect()), key=str)
    assert got == sorted([(1, "one two", 7), (1, "one two", 7), (2, "", 0), (None, "", 0)], key=str)
    assert htmltext.extract_pages(df.limit(0)).collect() == []
    assert htmltext.extract_pages(df).count() == 4
