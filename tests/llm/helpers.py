"""Small tables and brute-force versions for the corpus tests."""

from __future__ import annotations

import re

import xxhash

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en"):
    """Documents with ids from 0; a pair gives the id itself."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, lang, "src", None if text is None else len(text)))
    return spark.createDataFrame(rows, DOCUMENTS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(marks, bound=3):
    """Component of every (id, fingerprint) by comparing all pairs."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if bin(marks[i][1] ^ marks[j][1]).count("1") <= bound:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    named = {}
    for i, (doc_id, _) in enumerate(marks):
        if doc_id is not None:
            r = find(i)
            named[r] = min(named.get(r, doc_id), doc_id)
    return [named.get(find(i)) for i in range(len(marks))]
