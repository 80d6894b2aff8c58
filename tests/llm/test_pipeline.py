"""The pipeline against plain Python over the same rows."""

import pytest

import corpus_pipeline as C
from attesta.llm import quality_mil
from attesta.llm.common import cut, table
from attesta.llm.packing import cuts, encoder
from attesta.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.llm import helpers as H
from tests.llm.test_decontaminate import expected as contaminated
from tests.llm.test_line_dedup import expected as deduped

SF = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in C.STAGES] == [
        "quality_classifier", "line_dedup", "simhash_near_duplicates", "benchmark_decontamination", "best_fit_packing",
    ]
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in C.STAGES:
        docs = cut(stage(spark, docs, SF))
        out.append({r["doc_id"]: r for r in docs.collect()} if "text" in docs.columns else docs.collect())
        if "text" in docs.columns:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_every_stage(spark, stages):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    scores = quality_mil.report(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert set(stages[0]) == {r["doc_id"] for r in scores if r["score"] >= 0.3}
    texts = [(i, docs[i]) for i in sorted(stages[0])]
    texts = [(d, kept) for d, _, _, kept in deduped(texts)]
    assert {d: r["text"] for d, r in stages[1].items()} == dict(texts)
    marks = [(d, H.fingerprint(t)) for d, t in texts]
    texts = [(d, t) for (d, t), c in zip(texts, H.groups(marks)) if c == d]
    assert set(stages[2]) == {d for d, _ in texts}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    dirty = {r[0] for r in contaminated(texts, items) if r[5]}
    texts = [(d, t) for d, t in texts if d not in dirty]
    assert set(stages[3]) == {d for d, _ in texts}
    encode = encoder(tokenizer_path())
    want = sorted((d, i, s, n) for d, t in texts for i, (s, n) in enumerate(cuts(len(encode(t)) + 1, 1024)))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in stages[4]) == want


def test_run(spark, stages):
    rows = C.run(spark, SF).collect()
    own = lambda rs: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rs)
    assert own(rows) == own(stages[4])
