import random
import re

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import evidence
from attesta.registry import default_registry


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_normalize_text(spark):
    got = column(spark, ["a\r\nb\rc", " x \t y\xa0 z ", "\n\n", "a \n \n b", ""], T.normalize_text)
    assert got == ["a\nb\nc", "x y z", "", "a\nb", ""]


def test_sentences(spark):
    got = column(spark, ["One. Two!  Three?\nFour", " ", "v1.2 is out. Yes"], T.split_sentences)
    assert got == [["One.", "Two!", "Three?", "Four"], [], ["v1.2 is out.", "Yes"]]


def test_quote_and_words(spark):
    assert column(spark, ["x" * 239 + " y"], T.quote_text) == ["x" * 239]
    assert column(spark, [" a  b\nc ", ""], T.word_count) == [3, 0]


def brute_hits(text, rules):
    """Longest first, no overlap, by looking at every alias at every place."""
    found = []
    for _, _, _, alias, exact in rules.alias_rows():
        pattern = r"(?<![A-Za-z0-9])" + re.escape(alias) + r"(?![A-Za-z0-9])"
        found += [(m.start(), -len(m.group()), m.group()) for m in re.finditer(pattern, text, 0 if exact else re.I)]
    taken, kept = [], []
    for start, size, hit in sorted(found):
        if not any(start < e and start - size > s for s, e in taken):
            taken.append((start, start - size))
            kept.append((start, hit))
    return [h for _, h in sorted(kept)]


def brute_groups(text, rules):
    found = set()
    for group in evidence.SCANNED_GROUPS:
        for phrase in rules.cues[group]:
            tail = "" if group == "url_prefixes" else r"(?![A-Za-z0-9])"
            if re.search(r"(?<![A-Za-z0-9])" + re.escape(phrase) + tail, text, re.I):
                found.add(group)
    if any(re.search(r"(?<![A-Za-z0-9])" + re.escape(c) + r"(?![A-Za-z0-9])", text, re.I) for c in rules.action_cues):
        found.add("action")
    return found


def test_scans_equal_brute_force(spark):
    rules = default_registry()
    rnd = random.Random(7)
    words = [r[3] for r in rules.alias_rows()] + [p for _, p in rules.cue_rows()] + list(rules.action_cues)
    words += [w.upper() for w in rnd.sample(words, 60)] + ["of", "é", "x1", "http://a.b", "SQL-based"]
    glue = [" ", " ", ", ", "-", ". ", "/", "", "é"]
    texts = ["".join(rnd.choice(words) + rnd.choice(glue) for _ in range(rnd.randint(1, 9))) for _ in range(600)]
    aliases = [r[3] for r in rules.alias_rows()]
    assert column(spark, texts, lambda c: T.alias_hits(c, aliases, rules.case_sensitive)) == [brute_hits(t, rules) for t in texts]
    got = column(spark, texts, lambda c: evidence.cue_groups(c, rules))
    assert [set(g) for g in got] == [brute_groups(t, rules) for t in texts]
