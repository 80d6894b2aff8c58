import random
from collections import Counter

from attesta.llm import quality_rules as Q, votes as V
from tests.llm import helpers as H


def base(text):
    w = H.words(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    inside = set()
    for i in range(len(w) - 2):
        if windows[(w[i], w[i + 1], w[i + 2])] > 1:
            inside.update((i, i + 1, i + 2))
    lines = [x for x in (text or "").split("\n") if H.words(x)]
    failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside), failed


def texts():
    rng = random.Random(9)
    pool = "the of and to in Ärger über lines written walking river house | x% ### 12".split()
    made = ["".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "\t", ". ", "\x0b"]) for _ in range(rng.randint(0, 200))) for _ in range(80)]
    return made + [None, "", " \n\t ", "a b a b a b", "same line\nsame line\n\n\nsame line ", "x " * 3000, "one two three " * 4000, " a b c"]


def test_base_figures(spark):
    rows = texts()
    found = {r["doc_id"]: r for r in Q.report(H.documents(spark, rows)).collect()}
    for i, text in enumerate(rows):
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base(text), i
        assert not (r["base_failed"] and r["kept"])


def test_posterior_keeps_clean_and_drops_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in Q.report(docs).collect() if r["doc_id"] in labels and not r["base_failed"]]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.3 * len(bad)


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: the posterior separates the classes."""
    rng = random.Random(10)
    counts = Counter()
    for _ in range(4000):
        good = rng.random() < 0.8
        votes = tuple((1 if good else -1) if rng.random() < right else (-1 if good else 1) if rng.random() < 0.3 else 0 for right in (0.9, 0.8, 0.7, 0.6))
        counts[good, votes] += 1
    patterns = Counter()
    for (_, votes), n in counts.items():
        patterns[votes] += n
    found = V.fit([(list(v), n) for v, n in sorted(patterns.items())], 4)
    right = sum(n for (good, v), n in counts.items() if (found.posterior(list(v)) >= 0.5) == good)
    assert right > 0.93 * 4000
    assert found.weights[0][1] > found.weights[3][1] and all(w[-1] <= 0 <= w[1] for w in found.weights)


def test_shapes(spark):
    assert Q.report(H.documents(spark, [])).collect() == []
    docs = H.documents(spark, [(1, "a b"), (1, "a b"), (None, "c")]).selectExpr("*", "1 AS n_words", "2 AS w", "3 AS kept")
    assert sorted(str(r["doc_id"]) for r in Q.report(docs).collect()) == ["1", "1", "None"]
