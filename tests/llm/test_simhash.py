import random

from attesta.llm import simhash
from attesta.llm.components import components
from tests.llm import helpers as H


def rows(frame):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in frame.collect()), key=str)


def expected(pairs):
    marks = [(i, H.fingerprint(t)) for i, t in pairs]
    return sorted(((i, f"{m:016x}", c) for (i, m), c in zip(marks, H.groups(marks))), key=str)


def test_texts_against_brute_force(spark):
    rng = random.Random(1)
    pool = [f"w{i}" for i in range(60)]
    pairs = []
    for k in range(40):
        base = [rng.choice(pool) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            pairs.append((len(pairs), " ".join(copy)))
    pairs += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (904, "one"), (905, "Ä b"), (None, "one")]
    assert rows(simhash.report(H.documents(spark, pairs))) == expected(pairs)


def test_crowded_marks_against_brute_force(spark):
    """Crowds of marks around a few centres: hubs, parts and the order of probing all matter."""
    rng = random.Random(2)
    marks = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            m = centre
            for _ in range(rng.randint(0, 6)):
                m ^= 1 << rng.randrange(64)
            marks.add(m)
    marks = [(i, m) for i, m in enumerate(sorted(marks))]
    signed = [(i, m - (1 << 64) if m >> 63 else m) for i, m in marks]
    firsts = spark.createDataFrame(signed, "first long, fp long")
    # every mark starts as its own group, so all links have to come from the search
    alone = firsts.selectExpr("fp", "fp AS root", "1L AS members")
    found = {r["node"]: r["root"] for r in components(
        simhash.cross_links(alone, simhash.plan_search(alone, 3))).collect()}
    want = H.groups(marks)
    by_fp = dict((m, w) for (_, m), w in zip(signed, want))
    groups = {}
    for fp, w in by_fp.items():
        groups.setdefault(w, set()).add(found.get(fp, fp))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g.pop() for g in groups.values()}) == len(set(want))


def test_empty_table_and_stage(spark):
    assert simhash.report(H.documents(spark, [])).collect() == []
    docs = H.documents(spark, [(5, "a b c d"), (3, "A b c d"), (3, "A b c d"), (9, "x y z"), (None, "a b c d")])
    docs = docs.selectExpr("*", "1 AS fp", "2 AS component_id")
    kept = simhash.clean(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "9", "None"]
