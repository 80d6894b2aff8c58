"""Spelling variants: words one edit apart, found by walking a trie that lies in a distributed edge table.

1. ``word_counts``: the words of all texts, with a few runs misspelt by a rule, counted.
2. ``trie_edges``: one row (depth, node, letter, child) per trie edge; a node is the 64-bit hash of its prefix.
3. ``trie_pairs``: states (own, position, node, edits). ``own`` is the trie node of a word's first ``position``
   letters, so one state stands for all words with that prefix; ``node`` is the trie node reached beside it with one
   edit. States without an edit have node = own and are the edges themselves. Level by level they leave their common
   path at the first letter that differs (a replaced or an inserted letter; deletions are the same pairs seen from the
   other word), and all states join the edge table on their next letter. A pair of words leaves its common prefix at one
   place only, so every pair is made once. Terminal states with one edit are neighbours. A node has at most one child
   per letter of the alphabet, which bounds what leaves a node, however many words lie below it.
4. ``long_pairs``: words beyond ``LEVELS`` code points, which would need a level per letter, meet under the hash of
   the word with one letter left out instead: one row a letter, at most one word per letter of the alphabet in a group.
5. All pairs are compared letter by letter, so equal hashes of different prefixes add nothing, and cannot hide a pair.
6. ``variants``: forms by a maximum per word, roots by pointer doubling; a form is at least ten times as frequent, so
   chains are short.

Every level is written to the shared folder. Words are counted with partial aggregation, so a frequent word is one row
per task.

Defined results: null and empty texts hold no words; repeated rows are counted like any others, as is a null ``doc_id``
(its runs are kept as they are, since the rule cannot be computed); an empty table gives no rows; further columns of
the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import cut, lower_ascii
from attesta.session import shared_folder

#: Words up to this length walk the trie, a level per letter.
LEVELS = 32

#: What counts as a word, which runs are misspelt, and how much more frequent a form is.
RUN = "[A-Za-zÀ-ÿ]+"
EVERY = 31
TIMES = 10


def word_counts(docs: DataFrame, least: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``least`` code points that occur twice or more."""
    runs = docs.select(
        F.col(id_col).cast("string").alias("_id"),
        F.explode(F.regexp_extract_all(lower_ascii(F.col(text_col)), F.lit(RUN), F.lit(0))).alias("run"),
    ).filter(F.length("run") >= least)
    hashed = runs.select("run", F.crc32(F.concat("_id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    misspelt = F.concat(F.substring("run", F.lit(1), at), F.substr("run", at + 2))
    words = hashed.select(F.when(F.col("h") % EVERY == 0, misspelt).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter("n >= 2")


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, letter, child, terminal) of the trie of ``words``; depth is the number of letters at ``node``."""

    def edge(i: Column) -> Column:
        return F.struct(
            (i - 1).alias("depth"),
            F.xxhash64(F.substring("word", F.lit(1), i - 1)).alias("node"),
            F.substring("word", i, F.lit(1)).alias("letter"),
            F.xxhash64(F.substring("word", F.lit(1), i)).alias("child"),
            (i == F.length("word")).alias("terminal"),
        )

    steps = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), edge)).alias("e")).select("e.*")
    merged = steps.groupBy("depth", "node", "letter", "child").agg(F.max("terminal").alias("terminal"))
    return merged.repartitionByRange("depth", "node")


STATE = "own long, node long, own_ends boolean, node_ends boolean"


def first_differences(edges: DataFrame) -> DataFrame:
    """(depth, own, node, own_ends, node_ends, moves): where two words leave their common path, with one edit.

    ``depth`` is the number of own letters read. Words that are another word and one more letter do not move on.
    """
    own = edges.select("depth", "node", "letter", F.col("child").alias("own"), F.col("terminal").alias("own_ends"))
    to = F.col("child").alias("to")
    ends = F.col("terminal").alias("node_ends")
    other = edges.select("depth", "node", F.col("letter").alias("x"), to, ends)
    replaced = own.join(other, ["depth", "node"]).filter("letter < x")
    extra = edges.select("depth", "node", F.col("letter").alias("x"), F.col("child").alias("between"))
    after = edges.select((F.col("depth") - 1).alias("depth"), F.col("node").alias("between"), "letter", to, ends)
    inserted = extra.join(after, ["depth", "between"]).filter("x <> letter").join(own, ["depth", "node", "letter"])
    whole = own.filter("own_ends").select("depth", "own", "own_ends")
    appended = whole.join(after.filter("node_ends").withColumnRenamed("between", "own"), ["depth", "own"])
    columns = [(F.col("depth") + 1).alias("depth"), "own", F.col("to").alias("node"), "own_ends", "node_ends"]
    return (
        replaced.select(*columns, F.lit(True).alias("moves"))
        .unionByName(inserted.select(*columns, F.lit(True).alias("moves")))
        .unionByName(appended.select(*columns, F.lit(False).alias("moves")))
    )


def advanced(states: DataFrame, edges: DataFrame, position: int) -> DataFrame:
    """The states after one more letter, the same on both sides; the node may lie one letter deeper than the position."""
    here = edges.filter(F.col("depth") == position)
    own = here.select(F.col("node").alias("own"), "letter", F.col("child").alias("next"), F.col("terminal").alias("own_ends"))
    both = edges.filter(F.col("depth").between(position, position + 1))
    to = both.select("node", "letter", F.col("child").alias("to"), F.col("terminal").alias("node_ends"))
    moved = states.join(own, "own").drop("own").join(to, ["node", "letter"])
    return moved.select(F.col("next").alias("own"), F.col("to").alias("node"), "own_ends", "node_ends")


def trie_pairs(words: DataFrame) -> DataFrame:
    """(own, node): hashes of all pairs of ``words`` that may be one edit apart, each pair once.

    The loop has one round per letter of the longest common part, so one per letter of the longest word at most.
    """
    spark = words.sparkSession
    edges = cut(trie_edges(words))
    starts = cut(first_differences(edges).repartitionByRange("depth", "own"))
    last = starts.agg(F.max("depth")).first()[0] or 0
    folder = f"{shared_folder(spark)}/attesta/{uuid.uuid4().hex}"
    frontier = None
    position = 1
    while position <= last or frontier is not None:
        states = starts.filter((F.col("depth") == position) & F.col("moves")).select("own", "node")
        if frontier is not None:
            states = states.unionByName(frontier.select("own", "node"))
        position += 1
        path = f"{folder}/position={position}"
        advanced(states, edges, position - 1).write.parquet(path)
        frontier = spark.read.schema(STATE).parquet(path)
        if position > last and frontier.isEmpty():
            frontier = None
    found = starts.select("own", "node", "own_ends", "node_ends")
    if position > 1:
        found = found.unionByName(spark.read.schema(f"{STATE}, position int").parquet(folder).drop("position"))
    return found.filter("own_ends AND node_ends").select("own", "node")


#: Base of the hash over letters; odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def left_out(word: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Hash of a word, positions, and hashes of the word without the letter there.

    The hash is the sum of letter times BASE to the power of its position, modulo 2^64.
    """
    codes = np.frombuffer(word.encode("utf-32-le"), dtype="<u4").astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes) - 1, BASE, np.uint64)]), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    without = sums[:-1] + (sums[-1] - sums[1:]) * np.uint64(INVERSE)
    return int(sums[-1]), np.arange(len(codes)), without


def long_pairs(words: DataFrame, levels: int) -> DataFrame:
    """(own, node, place) as ``trie_pairs``, for the pairs whose longer word has more than ``levels`` code points.

    ``place`` is the letter of ``node`` that is replaced or left out; each pair has one.
    """
    schema = "key long, place int, shorter boolean, word_hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64()]
        for batch in batches:
            for word, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                whole, places, hashes = left_out(word)
                if len(word) <= levels:
                    places, hashes = places[:0], hashes[:0]
                n = len(places)
                columns = [
                    np.append(hashes, np.uint64(whole)).view(np.int64), np.append(places, -1).astype(np.int32),
                    np.append(np.zeros(n, bool), True), np.full(n + 1, own, np.int64),
                ]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns, kinds)), names=["key", "place", "shorter", "word_hash"])

    many = words.filter(F.length("word") >= levels).select("word", F.xxhash64("word").alias("own"))
    rows = cut(many.mapInArrow(run, schema))
    without, whole = rows.filter("NOT shorter"), rows.filter("shorter")
    swapped = without.select("key", "place", F.col("word_hash").alias("own")).join(
        without.select("key", "place", F.col("word_hash").alias("node")), ["key", "place"]
    ).filter("own < node")
    first = without.groupBy("key", F.col("word_hash").alias("node")).agg(F.min("place").alias("place"))
    longer = whole.select("key", F.col("word_hash").alias("own")).join(first, "key")
    return swapped.select("own", "node", "place").unionByName(longer.select("own", "node", "place"))


def without_letter(word: Column, place: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), place), F.substr(word, place + 2))


def one_edit(word: Column, near: Column, place: Column) -> Column:
    """Whether two texts differ by one inserted, deleted or replaced code point.

    A known ``place`` of the letter in ``near`` is tried alone, since distances of very long words take long.
    """
    same_length = F.length(word) == F.length(near)
    at_place = without_letter(near, place) == F.when(same_length, without_letter(word, place)).otherwise(word)
    return F.when(place.isNull(), F.levenshtein(word, near, 1) == 1).otherwise(at_place & (word != near))


def neighbours(words: DataFrame, levels: int) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of ``words`` (word, n) that are one edit apart."""
    pairs = trie_pairs(words.filter(F.length("word") <= levels)).withColumn("place", F.lit(None).cast("int"))
    if not words.filter(F.length("word") > levels).isEmpty():
        pairs = pairs.unionByName(long_pairs(words, levels))
    named = words.select(F.xxhash64("word").alias("own"), "word", "n")
    other = named.select(F.col("own").alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    both = pairs.join(named, "own").join(other, "node").filter(one_edit(F.col("word"), F.col("near"), F.col("place")))
    ways = F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    return both.select(F.explode(ways).alias("w")).select("w.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form, by following ``forms`` (word, form) two, four, eight steps at once."""
    reached = forms.select("word", F.col("form").alias("root"))
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = cut(reached.join(further, "root", "left"))
        reached = joined.select("word", F.coalesce("next", "root").alias("root"))
        if joined.filter(F.col("next").isNotNull()).isEmpty():
            return reached


def variants(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Per word of ``words`` (word, n): its neighbours, its form and the root that forms lead to."""
    words = cut(words)
    best = neighbours(words, levels).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("r"), F.col("near"))).alias("best")
    )
    joined = words.join(best, "word", "left")
    is_form = -F.col("best.r") >= TIMES * F.col("n")
    known = cut(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.r")).alias("form_n"),
    ))
    led = roots(known.filter(F.col("form").isNotNull()))
    return known.join(led, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )


def report(docs: DataFrame) -> DataFrame:
    return variants(word_counts(docs))


#: The rule's crc32 is computed from its table; runs hold only letters whose UTF-8 form has one byte, or two from 195 on.
SQL = r"""
WITH crc_table AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END
    )) AS t
),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+'
    )) AS run
    FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
    SELECT run, n, doc_id, flatten(list_transform(
        string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END
    )) AS b
    FROM counted
),
hashed AS (
    SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN xor(4294967295, list_reduce(
        list_prepend(4294967295, b), lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)
    )) END AS h
    FROM bytes, crc_table
),
words AS (
    SELECT CASE WHEN h % 31 = 0 THEN run[1 : h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word,
        sum(n)::BIGINT AS n
    FROM hashed GROUP BY ALL
),
kept AS (SELECT word, n FROM words WHERE length(word) >= 7 AND n >= 2),
shorter AS (
    SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest
    FROM (SELECT word, n, unnest(range(length(word))) AS i FROM kept)
),
near AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM shorter a JOIN kept b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM shorter a JOIN kept b ON a.rest = b.word
),
best AS (
    SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
    FROM near GROUP BY word
),
known AS (
    SELECT k.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
        CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
    FROM kept k LEFT JOIN best b ON k.word = b.word
),
led AS (
    WITH RECURSIVE walk AS (
        SELECT word, word AS root, form AS next FROM known
        UNION ALL SELECT w.word, k.word, k.form FROM walk w JOIN known k ON w.next = k.word
    )
    SELECT word, root FROM walk WHERE next IS NULL
)
SELECT k.word, n, n_near, form, form_n, root FROM known k JOIN led USING (word)
"""
