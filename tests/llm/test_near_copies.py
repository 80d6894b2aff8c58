import random

from pyspark.sql import functions as F

from attesta.llm import near_copies, simhash
from tests.llm import helpers as H


def shingles(text):
    w = H.words(H.lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def firsts(pairs, least=0.8):
    """Smallest id of every document's group by comparing all pairs of texts."""
    sets = [shingles(t) for _, t in pairs]
    root = list(range(len(pairs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= least * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    named = {}
    for i, (doc_id, _) in enumerate(pairs):
        named[find(i)] = min(named.get(find(i), doc_id), doc_id)
    return [named[find(i)] for i in range(len(pairs))]


def near_pairs():
    """Texts of up to 150 words with up to six changed words, and a crowd around one text."""
    rng = random.Random(5)
    pool = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(60):
        base = [rng.choice(pool) for _ in range(150 if k == 0 else rng.randint(1, 150))]
        for _ in range(60 if k == 0 else rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(pool)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate([*texts, None, "", " \n", "One two", "one TWO"]))


def test_stage_against_all_pairs(spark):
    pairs = near_pairs()
    want = {d for (d, _), f in zip(pairs, firsts(pairs)) if d == f}
    assert len(want) < len(pairs) - 40
    assert {r["doc_id"] for r in simhash.clean(H.documents(spark, pairs)).collect()} == want
    # the settings of the query would leave near copies in
    assert len(set(H.groups([(d, H.fingerprint(t)) for d, t in pairs]))) > len(want)


def test_repeated_ids_are_judged_by_their_texts(spark):
    """An id has a unique text and a copy of another group: only the copy goes."""
    words = lambda c: " ".join(f"{c}{i}" for i in range(40))
    for unique in ("x", "y", "z"):  # whatever the order of the texts' hashes
        rows = [(1, words("a")), (5, words(unique)), (5, words("a")), (5, words("b")), (7, words("b")), (5, words(unique))]
        kept = sorted((r["doc_id"], r["text"]) for r in simhash.clean(H.documents(spark, rows)).collect())
        assert kept == sorted([(1, words("a")), (5, words(unique)), (5, words("b"))])


def test_simhash_gives_candidates(spark, monkeypatch):
    """Near copies within three bits are found without any MinHash band; a look-alike that shares too little is not."""
    base = [f"w{i}" for i in range(400)]
    near = [*base[:-1], "other"]
    assert bin((simhash.fingerprint(" ".join(base), 5) ^ simhash.fingerprint(" ".join(near), 5)) % 2**64).count("1") <= 3
    none = lambda entries, *_: entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    monkeypatch.setattr(near_copies, "centre_pairs", none)
    monkeypatch.setattr(near_copies, "cross_pairs", none)
    rows = [(3, " ".join(base)), (4, " ".join(near)), (5, " ".join(reversed(base))), (6, None), (7, "")]
    assert {r["doc_id"] for r in simhash.clean(H.documents(spark, rows)).collect()} == {3, 5, 6}
