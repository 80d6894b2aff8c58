import hashlib
import random
import re

from attesta.llm import decontaminate as D
from tests.llm import helpers as H

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", H.lower(text))


def expected(docs, items, length=10):
    out = []
    for doc_id, text in docs:
        w, hit, names = words(text), set(), set()
        for item, own in items:
            o = words(own)
            size = min(length, len(o))
            for s in range(len(o) - size + 1 if o else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == o[s : s + size]:
                        hit.update(range(at, at + size))
                        names.add(str(item) if item is not None else "")
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def tables():
    rng = random.Random(4)
    pool = ["Alpha", "beta", "gamma", "the", "of", "élan", "x1"]
    draw = lambda n: " ".join(rng.choice(pool) + rng.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(i, draw(rng.randint(10, 40))) for i in range(8)] + [(8, "one TWO three four"), (9, "Single"), (10, None), (11, "?!"), (None, "nul item here now"), (2, "again item two")]
    docs = [(i, draw(rng.randint(0, 80)) + " " + " - ".join(words(rng.choice(items)[1])[:14]) + " " + draw(5)) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "it is single."), (102, "it is single."), (103, "nul item here now again item two"), (None, "one two three four"), (104, "x" * 100000 + " single")]
    return docs, items


def rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_against_brute_force(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, ITEMS)
    assert rows(D.report(H.documents(spark, docs), bench)) == expected(docs, items)


def test_several_blocks(spark):
    """A benchmark beyond the bound is searched block by block with the same result."""
    docs, items = tables()
    bench = spark.createDataFrame(items, ITEMS)
    found = D.search_documents(H.documents(spark, docs), bench, ["doc_id"], block_bytes=300)
    whole = D.search_documents(H.documents(spark, docs), bench, ["doc_id"])
    order = lambda f: sorted(map(str, f.collect()))
    assert order(found) == order(whole)


def test_stage_and_empty_tables(spark):
    docs, items = tables()
    bench = spark.createDataFrame(items, ITEMS)
    frame = H.documents(spark, docs).selectExpr("*", "1 AS _spans", "2 AS n_words", "3 AS _items", "4 AS c0")
    kept = D.clean(frame, bench)
    assert kept.columns == frame.columns
    clean = sorted(str(r[0]) for r in expected(docs, items) if not r[5])
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == clean
    assert D.clean(frame, bench.limit(0)).count() == len(docs)
    assert D.report(H.documents(spark, []), bench).collect() == []
