"""Rows travel to Python in small Arrow batches, and no result depends on their size."""

from functools import partial

import numpy as np
import pytest

from waitwise.llm import common, decontaminate, mixing, ngramjoin, quality

BYTES, ROWS = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture()
def batches(spark):
    """The session without a setting of its own, and again as it was."""
    before = {k: spark.conf.get(k, None) for k in (BYTES, ROWS)}
    spark.conf.unset(BYTES)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def long_texts(spark):
    """About 14 MB in one partition."""
    return spark.range(0, 7000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 200) AS text")


def test_a_step_holds_a_few_megabytes_of_text_at_once(batches, monkeypatch):
    most = 2 * common.BATCH_BYTES
    searcher = decontaminate._searcher

    def measured(*args, **kwargs):
        search = searcher(*args, **kwargs)

        def run(rows):
            def small():
                for b in rows:
                    assert b.nbytes <= most, b.nbytes
                    yield b
            return search(small())
        return run

    monkeypatch.setattr(decontaminate, "_searcher", measured)
    bench = batches.createDataFrame([(1, " ".join(["word7"] * 10))], "item_id long, text string")
    kept = decontaminate.decontaminate(long_texts(batches), bench)
    assert kept.count() == 6999 and kept.filter("doc_id = 7").isEmpty()


def test_every_operator_bounds_its_batches(batches):
    docs = long_texts(batches).limit(5)
    model = mixing.fit_model(["a"], [], [])
    cnn = quality.fit([], [])
    for use in (partial(quality.keep_good, docs, cnn), partial(quality.score_documents, docs, cnn), partial(ngramjoin.sketch, docs),
                partial(mixing.classify, docs, model, ["doc_id"])):
        batches.conf.unset(BYTES)
        use()
        assert int(batches.conf.get(BYTES)) == common.BATCH_BYTES


def test_a_setting_of_the_session_stays(batches):
    batches.conf.set(BYTES, "1234567")
    common.bound_batches(batches)
    assert batches.conf.get(BYTES) == "1234567"


def test_frequent_shingles_do_not_depend_on_batches(batches):
    docs = batches.range(0, 6000, 1, 1).selectExpr(
        "id AS doc_id", "concat('x', id, ' y', id, ' ', if(id % 300 = 0, 'the same six words again here', 'u v'), ' z', id) AS text")
    found = []
    for rows in (70, 10_000):
        batches.conf.set(ROWS, rows)
        found.append(ngramjoin.frequent_shingles(docs))
    assert len(found[1]) and np.array_equal(*found)
