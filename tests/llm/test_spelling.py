import random
import re
import zlib
from collections import Counter

from attesta.llm import spelling as S
from tests.llm import helpers as H


def near(a, b):
    """Whether two texts differ by exactly one edit, by trying all."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def words_of(pairs):
    counts = Counter()
    for doc_id, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = H.lower(run)
            if doc_id is not None:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def expected(counts):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    rows = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows[w] = (counts[w], len(links[w]), form[w], counts.get(form[w]), root)
    return rows


def found(frame):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in frame.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abcÉéz") for _ in range(rng.randint(6, 9))) for _ in range(25)]
    pairs = []
    for i in range(150):
        words = []
        for _ in range(rng.randint(0, 40)):
            w = rng.choice(stems[: rng.choice([2, 6, 25])])
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "a", "ÿ", w[k] * 2]) + w[k + 1 :]
            words.append(w)
        pairs.append((i, rng.choice([" ", "\n", ", 3"]).join(words)))
    pairs += [(200, None), (201, ""), (202, "12 34"), (None, " ".join(stems * 2)), (5, pairs[5][1]), (5, pairs[5][1])]
    docs = H.documents(spark, pairs).selectExpr("*", "1 AS word", "2 AS n")
    counts = words_of(pairs)
    assert {r["word"]: r["n"] for r in S.word_counts(docs).collect()} == counts
    rows = found(S.report(docs))
    assert rows == expected(counts) and any(r[2] for r in rows.values()) and any(r[1] > 5 for r in rows.values())


def test_chains_and_ties(spark):
    counts = {"aaaaaaa": 2000, "aaaaaab": 200, "aaaaabb": 20, "aaaabbb": 2, "zzzzzzz": 30, "zzzzzzy": 30, "zzzzzz": 3, "zzzzzzx": 3}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = found(S.variants(frame))
    assert rows == expected(counts) and rows["aaaabbb"][4] == "aaaaaaa" and rows["zzzzzz"][2] == "zzzzzzy"


def test_long_words(spark):
    """Words around and beyond the levels of the trie, some of them very long."""
    rng = random.Random(6)
    base = "".join(rng.choice("ab") for _ in range(15))
    words = {base[:k] + c + base[k + 1 :] for k in (0, 7, 9, 14) for c in "abz"} | {base[:k] for k in range(7, 16)}
    words |= {base[:10] + "z", base[:9] + "z", base[:5] + base[6:], "a" * 9, "a" * 10, "a" * 11, "a" * 9 + "b"}
    words |= {"x" * 100_000, "x" * 100_001, "x" * 50_000 + "y" + "x" * 49_999, "x" * 99_999 + "y"}
    counts = {w: 2 + 30 * (i % 3) for i, w in enumerate(sorted(words))}
    rows = found(S.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), levels=9))
    small = {w: n for w, n in counts.items() if len(w) < 1000}
    assert {w: r for w, r in rows.items() if len(w) < 1000} == expected(small)
    long = {len(w): rows[w][1] for w in rows if len(w) > 1000 and "y" not in w}
    assert long == {100_000: 3, 100_001: 1} and rows["x" * 99_999 + "y"][1] == 1


def test_empty(spark):
    assert S.report(H.documents(spark, [])).collect() == []
    assert S.report(H.documents(spark, [None, "", "short words only"])).collect() == []
