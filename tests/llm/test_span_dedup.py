import hashlib
import random
import re

from attesta.llm import span_dedup as S
from tests.llm import helpers as H


def expected(pairs):
    """(doc_id, sentences, removed, kept) from all runs of all documents."""
    cut = []
    for doc_id, text in pairs:
        parts = re.findall("(?s).+?(?:[.!?][ \t\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*|\\Z)", text or "")
        assert "".join(parts) == (text or "")
        real = [i for i, p in enumerate(parts) if H.words(p)]
        runs = []
        for a in range(len(real)):
            for size in (1, 2, 3):
                own = real[a : a + size]
                key = tuple(" ".join(H.words(H.lower(parts[i]))) for i in own)
                if len(own) == size and sum(len(k.split(" ")) for k in key) >= (12 if size == 3 else 50):
                    runs.append((key, own))
        cut.append((doc_id, parts, real, runs))
    first = {}
    for doc_id, _, _, runs in cut:
        for key, _ in runs:
            if doc_id is not None:
                first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, parts, real, runs in cut:
        gone, seen = set(), set()
        for key, own in runs:
            if key in seen or (doc_id is not None and first[key] != doc_id):
                gone.update(own)
            seen.add(key)
        out.append((doc_id, len(real), len(gone), "".join(p for i, p in enumerate(parts) if i not in gone)))
    return out


def pairs():
    rng = random.Random(8)
    sentence = lambda n: " ".join(rng.choice(["Red", "blue", "élan", "sand", "old"]) + str(rng.randint(0, 99)) for _ in range(n)) + rng.choice(". ! ?".split())
    shared = [" ".join(sentence(rng.randint(1, 12)) for _ in range(8)) for _ in range(5)]
    long = sentence(60)
    made = []
    for i in range(60):
        parts = [sentence(rng.randint(1, 15)) for _ in range(rng.randint(0, 6))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(shared))
        if i % 7 == 0:
            parts.append(long)
        made.append((i, rng.choice([" ", "\n", "  \n\n"]).join(parts)))
    made += [(100 + i, shared[0].upper() + "\n Own tail %d here." % i) for i in range(200)]
    made += [(500, None), (501, ""), (502, "\n \n"), (503, "One. " * 50), (504, shared[1] + " " + shared[1]), (505, shared[2]), (505, shared[2]), (505, "x " + shared[2]), (None, shared[3])]
    return made


def test_against_brute_force(spark):
    rows = pairs()
    found = sorted((tuple(r) for r in S.report(H.documents(spark, rows)).select("doc_id", "n_sentences", "n_removed", "kept_sha256").collect()), key=str)
    want = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in expected(rows)), key=str)
    assert found == want


def test_long_passage_is_found_in_one_place_only(spark):
    passage = " ".join(f"w{i}" for i in range(55)) + "."
    rows = [(i, f"Start {i} of it.\n{passage}\nEnd {i} of it.") for i in range(5)]
    found = {r["doc_id"]: r["text"] for r in S.report(H.documents(spark, rows)).collect()}
    assert passage in found[0] and not any(passage in found[i] for i in range(1, 5))
    assert all(f"Start {i} of it.\n" in found[i] and f"End {i} of it." in found[i] for i in range(5))


def test_empty_table_and_clashing_columns(spark):
    assert S.report(H.documents(spark, [])).collect() == []
    docs = H.documents(spark, [(1, "a"), (2, "b")]).selectExpr("*", "1 AS runs", "2 AS version", "3 AS _id")
    assert sorted(r["text"] for r in S.report(docs).collect()) == ["a", "b"]
