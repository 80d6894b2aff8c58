import random

from pyspark.sql import functions as F

from attesta.operators import groups, ordering
from attesta.operators.ordering import first_of_both, number_in_ranges, number_rows


def test_numbering_with_one_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot", i, j) for i in range(400) for j in range(rnd.randint(0, 3))] + [("cold", 5, 1), ("cold", 900, 0)]
    df = spark.createDataFrame(rows, "k string, a int, b int").repartition(5)
    got = {(r.k, r.a, r.b): r.n for r in number_rows(df, ["k"], ["a", "b"], [F.floor(F.col("a") / 16)], "n").collect()}
    for key in ("hot", "cold"):
        ordered = sorted(r for r in rows if r[0] == key)
        assert [got[r] for r in ordered] == list(range(1, len(ordered) + 1))


def test_numbering_of_hashed_orders(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b"]), rnd.getrandbits(60)) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, h long").repartition(3)
    got = {(r.k, r.h): r.n for r in number_in_ranges(df, ["k"], ["h"], "n").collect()}
    for key in ("a", "b"):
        ordered = sorted(r for r in rows if r[0] == key)
        assert [got[r] for r in ordered] == list(range(1, len(ordered) + 1))


def test_first_of_both_equals_one_by_one(spark):
    rnd = random.Random(11)
    rows = [(i, f"a{rnd.randint(0, 40)}", rnd.choice([None, f"b{rnd.randint(0, 40)}"])) for i in range(150)]
    seen_a, seen_b, kept = set(), set(), []
    for i, a, b in rows:
        if a in seen_a or (b is not None and b in seen_b):
            continue
        kept.append(i)
        seen_a.add(a)
        if b is not None:
            seen_b.add(b)
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r.i for r in first_of_both(df, "i", "a", "b").collect()) == kept


def one_by_one(rows):
    seen_a, seen_b, kept = set(), set(), []
    for i, a, b in sorted(rows):
        if a not in seen_a and (b is None or b not in seen_b):
            kept.append(i)
            seen_a.add(a)
            seen_b.add(b)
    return kept


def counted_rounds(monkeypatch):
    calls = []
    whole = ordering._round
    monkeypatch.setattr(ordering, "_round", lambda *args: calls.append(1) or whole(*args))
    return calls


def test_chain_of_repeats_takes_one_round(spark, monkeypatch):
    """Each row repeats the one before it in one key and is repeated by the next one in the other."""
    rows = [(i, f"a{i // 2}", f"b{(i + 1) // 2}") for i in range(1000)] + [(2000 + i, "hot", None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a string, b string").repartition(4)
    calls = counted_rounds(monkeypatch)
    assert sorted(r.i for r in first_of_both(df, "i", "a", "b").collect()) == one_by_one(rows)
    assert len(calls) == 1


def test_large_groups_go_on_in_rounds(spark, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, f"a{rnd.randint(0, 60)}", f"b{rnd.randint(0, 60)}") for i in range(200)]
    rows += [(1000 + i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(9)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    calls = counted_rounds(monkeypatch)
    assert sorted(r.i for r in first_of_both(df, "i", "a", "b", group_rows=8).collect()) == one_by_one(rows)
    assert len(calls) > 1


def test_components_of_a_sorted_path(spark, monkeypatch):
    steps = []
    monkeypatch.setattr(groups, "cut", lambda df: steps.append(1) or ordering.cut(df))
    links = spark.createDataFrame([(i, i + 1) for i in range(499)], "a long, b long")
    assert {(r.node, r.root) for r in groups.components(links).collect()} == {(i, 0) for i in range(500)}
    assert len(steps) <= 20


def test_components_of_other_shapes(spark):
    """A path in mixed order, a star, a ring, a node linked to itself."""
    mixed = random.Random(13).sample(range(1000, 1300), 300)
    links = list(zip(mixed, mixed[1:])) + [(2000, 2001 + i) for i in range(200)]
    links += [(3000 + i, 3000 + (i + 1) % 7) for i in range(7)] + [(4000, 4000)]
    rows = groups.components(spark.createDataFrame(links, "a long, b long")).collect()
    expected = {i: 1000 for i in mixed} | {2000 + i: 2000 for i in range(201)} | {3000 + i: 3000 for i in range(7)}
    assert {r.node: r.root for r in rows} == expected and len(rows) == len(expected)
    assert groups.components(spark.createDataFrame([(1, 1)], "a long, b long")).collect() == []
