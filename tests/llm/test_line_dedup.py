import hashlib
import random

from attesta.llm import line_dedup as L
from tests.llm import helpers as H

STRIP = " \t\n\x0b\x0c\r"


def expected(pairs):
    """(doc_id, lines, dropped, kept text) by comparing all lines."""
    holders = {}
    for doc_id, text in pairs:
        for line in (text or "").split("\n"):
            key = H.lower(line.strip(STRIP))
            if doc_id is not None and len(key) >= 10:
                holders.setdefault(key, set()).add(doc_id)
    out = []
    for doc_id, text in pairs:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            owners = holders.get(H.lower(line.strip(STRIP)), set())
            if doc_id is None or len(owners) < 2 or doc_id == min(owners):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(rows):
    return sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in rows), key=str)


def pairs():
    rng = random.Random(3)
    pool = [f"Shared line number {i}" for i in range(12)] + ["short", "", "  PADDED Shared Line \t", "padded shared line"]
    made = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    made += [(i, "one line that all of them hold\nown " + str(i)) for i in range(100, 400)]
    made += [(500, None), (501, ""), (502, "\n\n"), (503, "Ärger ist gross"), (504, "ärger ist gross"), (505, "ninechars\nninechars"), (506, "ninechars")]
    made += [(None, "one line that all of them hold"), (400, "twice the same line\ntwice the same line"), (400, "twice the same line\nx"), (401, "Twice the same line")]
    made += [(402, "\n".join(f"long text line {i % 3000}" for i in range(5000))), (403, "long text line 7\nlong text line 2999")]
    return made


def test_against_brute_force(spark):
    rows = pairs()
    found = [tuple(r) for r in L.report(H.documents(spark, rows)).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()]
    assert sorted(found, key=str) == digests(expected(rows))


def test_stage_keeps_columns(spark):
    rows = pairs()
    docs = H.documents(spark, rows).selectExpr("*", "'x' AS kept", "1 AS n_lines", "2 AS n_dropped", "3 AS keep", "4 AS version")
    found = L.clean(docs)
    assert found.columns == docs.columns
    want = sorted(((d, k if g or t is not None else None, "x") for (d, _, g, k), (_, t) in zip(expected(rows), rows)), key=str)
    got = found.select("doc_id", "text", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert {len(r["text"]) == r["n_chars"] for r in found.filter("text IS NOT NULL").collect()} == {True}


def test_empty_table(spark):
    assert L.report(H.documents(spark, [])).collect() == []
    assert L.clean(H.documents(spark, [])).collect() == []


def test_second_hash_is_no_function_of_the_first(spark):
    """Spark chains the columns of a hash: (key, 1) would hash 1 under the first hash as its seed."""
    rows = L.line_occurrences(H.documents(spark, [(1, "a line that is long enough")]))
    chained = "xxhash64('a line that is long enough', 1)"
    assert rows.filter(f"h2 = {chained} OR h2 = h1").count() == 0 and rows.count() == 1
