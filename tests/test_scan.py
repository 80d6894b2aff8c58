import random
import time

from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import evidence
from attesta.registry import default_registry

ODD = T.ODD_LETTERS


def blocks(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "run_id long, text string")
    return rows.select(
        "run_id", F.lit("software_engineering").alias("track"), F.lit("doc").alias("source_id"), F.lit(0).alias("source_ord"),
        F.lit("cv").alias("source_type"), F.lit("attributed").alias("ownership_status"), F.lit(True).alias("accessible"),
        F.lit(0).alias("block_ord"), F.lit("page 1").alias("locator"), "text",
    )


def test_only_the_odd_letters_fold_to_plain_ones(spark):
    letters = "".join(chr(c) for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000)
    found = spark.createDataFrame([(letters,)], "t string").select(F.regexp_extract_all("t", F.lit("(?iu)([a-z0-9])"), F.lit(1))).first()[0]
    assert set(found) == set(ODD)


def test_plain_and_unicode_patterns_agree(spark):
    rules, rnd = default_registry(), random.Random(3)
    aliases = [r[3] for r in rules.alias_rows()]
    swaps = {"s": ODD[0], "k": ODD[1], "i": rnd.choice(ODD[2:])}
    words = [*aliases, *(p for _, p in rules.cue_rows()), *rules.action_cues, "lorem", "r", "\u00e9t\u00e9"]
    odd = lambda w: "".join(swaps[c] if c in swaps and rnd.random() < 0.3 else c for c in w)
    texts = [rnd.choice([" ", ". ", "-", ODD[0]]).join(odd(w) if rnd.random() < 0.5 else w.upper() for w in rnd.sample(words, 4)) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    scanner, t = evidence.cue_scanner(rules), F.col("t")
    unicode = lambda pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    cues = F.regexp_extract_all(t, F.lit(scanner.pattern("iu")), F.lit(1))
    got = df.select(
        "t", T.alias_hits(t, aliases, rules.case_sensitive).alias("hits"),
        unicode(T.alias_pattern(aliases, rules.case_sensitive)).alias("all_hits"),
        F.size(cues).alias("all_cues"),
        F.get(scanner.may_hold(F.array(t), aliases), F.lit(0)).alias("worth"),
    ).collect()
    assert [r.hits for r in got] == [r.all_hits for r in got]
    assert not [r.t for r in got if (r.all_hits or r.all_cues) and not r.worth]


def test_the_quick_search_leaves_out_texts_without_a_phrase(spark):
    rows = [(["ask a kind sister", "", "k", "Python"],), (None,), ([],), (["http://x", "xhttp://", "Pythons", "PYTHON."],)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(1)
    got = df.select(evidence.cue_scanner(default_registry()).may_hold(F.col("t"), ["Python"]).alias("w")).collect()
    assert [r.w for r in got] == [[False, False, False, True], None, [], [True, False, False, True]]


def test_a_phrase_beyond_ascii_is_found(spark):
    scanner = T.CueScanner({"a": ["\u00e9t\u00e9 work"]})
    df = spark.createDataFrame([("un \u00c9T\u00c9 WORK",), ("un ete",)], "t string")
    got = df.select(scanner.groups(F.col("t")).alias("g"), scanner.may_hold(F.array("t")).alias("w")).collect()
    assert [(r.g, r.w) for r in got] == [(["a"], [True]), ([], [False])]


def test_numbers_and_quotes_of_sentences(spark):
    found = evidence.scan_sentences(blocks(spark, ["Lorem ipsum. Used Python. Dolor.\nSQL", None, "", "nothing"]))
    got = [(r.run_id, r.sent_ord, r.sentence, r.hits, r.block_quote) for r in found.orderBy("sent_ord").collect()]
    quote = "Lorem ipsum. Used Python. Dolor.\nSQL"
    assert got == [(0, 1, "Used Python.", ["Python"], quote), (0, 3, "SQL", ["SQL"], quote)]


def test_a_long_block_does_not_go_along_with_each_sentence(spark):
    text = "Built a Flask API in Python. " * 16000
    evidence.scan_sentences(blocks(spark, ["Python"])).count()
    began = time.time()
    found = evidence.scan_sentences(blocks(spark, [text])).agg(F.count("sentence"), F.count("block_quote")).first()
    assert tuple(found) == (16000, 0)
    assert time.time() - began < 15


def test_a_link_paragraph_without_a_number_keeps_its_phrase(spark, tmp_path):
    from entries import base

    folder = str(tmp_path)
    spark.createDataFrame([(4, "Lorem ipsum.")], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, None, "user", "Dolor.")], "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    found = evidence.scan_sentences(base.link_blocks(spark, folder)).collect()
    assert [(r.block_ord, r.sent_ord, r.sentence) for r in found] == [(None, 0, base.PHRASES[-1] + ".")]
