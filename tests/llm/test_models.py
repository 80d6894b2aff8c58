import zlib

import numpy as np
import pytest

from attesta.llm import language_id as L, quality_mil as Q
from attesta.llm.passages import SHAPES, blocks, passage_features
from tests.llm import helpers as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_quality_on_held_out_rows(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.report(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [r["score"] for r in rows if r["held_out"] and marks.get(r["doc_id"]) == 1]
    bad = [r["score"] for r in rows if r["held_out"] and marks.get(r["doc_id"]) == 0]
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.9 and np.mean([s >= 0.3 for s in good]) > 0.97


def test_quality_gradients():
    """Analytic gradients against differences."""
    s = Q.Settings(buckets=4, hidden=5, gate=3)
    model = Q.Model(s)
    model.weights = {k: v.astype(np.float64) + 0.1 for k, v in model.weights.items()}
    rng = np.random.default_rng(1)
    x, counts, labels = rng.standard_normal((7, SHAPES + 4)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = model.forward(x, counts)["score"]
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    for name, grad in model.gradients(x, counts, labels).items():
        place = tuple(0 for _ in grad.shape)
        w, step = model.weights[name], 1e-5
        w[place] += step
        up = loss()
        w[place] -= 2 * step
        down = loss()
        w[place] += step
        assert abs((up - down) / (2 * step) - grad[place]) < 1e-5, name


def test_scores_do_not_depend_on_neighbours(docs):
    texts = [r["text"] for r in docs.limit(40).collect()] + [None, "", "  \n", "é" * 3000, "word " * 70000]
    together = [passage_features(b, 64, 64) for b in blocks(texts)]
    counts = np.concatenate([c for _, c in together])
    rows = np.concatenate([x for x, _ in together])
    at = 0
    for text, n in zip(texts, counts):
        x, own = passage_features(next(blocks([text])), 64, 64)
        assert own.tolist() == [n] and np.array_equal(x, rows[at : at + n])
        at += n


def test_quality_shapes(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (3, ""), (4, "x " * 50000)]
    docs = H.documents(spark, rows).selectExpr("*", "1 AS score", "2 AS held_out", "3 AS _label", "4 AS c0")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.report(docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(1, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in Q.report(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert len(Q.report(docs, both).collect()) == 5
    kept = Q.clean(docs, one)
    assert kept.columns == docs.columns and kept.count() == 5
    assert Q.report(docs.limit(0), both).collect() == []


def test_training_memory_is_bounded(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    limit = 400_000
    bags, marks = Q.training_bags(docs, labels, Q.Settings(max_bytes=limit))
    assert 0 < len(bags) == len(marks) and sum(2 * b.size for b in bags) < 3 * limit
    few, _ = Q.training_bags(docs, labels, Q.Settings(max_rows=50))
    assert 0 < len(few) < 120


def test_language_on_held_out_rows(docs):
    rows = L.report(docs).collect()
    real = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(real) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == real[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)
    taken = [r for r in held if not r["rejected"]]
    assert np.mean([r["lang_pred"] == real[r["doc_id"]] for r in taken]) >= np.mean([r["lang_pred"] == real[r["doc_id"]] for r in held])


def test_language_shapes(spark, docs):
    rows = [(1, None), (1, None), (2, ""), (3, "12 34 !?"), (None, "the house"), (5, "ß"), (6, "der " * 100000), (7, "a"), (8, "b"), (9, "c"), (10, "d")]
    found = {r["doc_id"]: r for r in L.report(H.documents(spark, rows, lang=None).selectExpr("*", "1 AS lang_pred", "2 AS score")).collect()}
    assert {r["lang_pred"] for r in found.values()} == {"und"}
    found = {r["doc_id"]: r for r in L.report(H.documents(spark, rows)).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[2]["score"] == 0
    assert [found[i]["lang_pred"] for i in (None, 5, 6)] == ["en"] * 3
    assert L.report(docs.limit(0)).collect() == []
