"""Line dedup: a line that several documents hold stays only in the first of them.

Only hashes are sorted, never text. Every line long enough becomes one row of two 64-bit hashes of
its key under different seeds, the document and its position. The rows are range-partitioned by hash and slice and sorted
by document and position inside, and one pass streams the first holder of every hash in a slice. A
slice is a 256th of the documents, so a line that a third of all documents share is spread over
256 ranges. The first holders of the slices (at most 256 for a hash) are merged, and each slice gets
the answer back. What leaves the operator is a bitmap per document: one bit a line, set where the
line stays, for those documents that lose lines. All steps are DataFrame functions.

The occurrence rows are written once to the shared folder: range bounds are sampled from that table
and not from a second scan of the texts, and a lost executor reads it again.

Defined results: a null or empty text is one empty line; a row without ``doc_id`` is nobody's copy
and keeps all its lines; rows that repeat a ``doc_id`` belong to one document (they do not make a
line a repeat of each other); an empty table gives no rows; the stage keeps all other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import SPACES, cut, lower_ascii, text_or_empty

SLICES = 256


def key_of(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def line_occurrences(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """One row for each line with a key of at least ``min_chars`` code points."""
    rows = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("version"),
        F.posexplode(F.split(text_or_empty(), "\n")).alias("pos", "line"),
    )
    keyed = rows.select("doc_id", "version", "pos", key_of(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"),
        "doc_id", "version", "pos",
    )


def dropped_lines(occurrences: DataFrame) -> DataFrame:
    """Rows (doc_id, version, pos) of all lines that repeat a line of an earlier document."""
    group = ["h1", "h2", "slice"]
    ordered = occurrences.repartitionByRange(*group).sortWithinPartitions(*group, "doc_id", "pos")
    stream = Window.partitionBy(*group).orderBy("doc_id", "pos")
    marked = ordered.withColumn("before", F.lag("doc_id").over(stream))
    # A row that begins a document within its slice: the first one of all is the slice's holder.
    begins = marked.filter(F.col("before").isNull() | (F.col("before") != F.col("doc_id")))
    holders = begins.groupBy(*group).agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("holders")
    )
    answers = (
        holders.groupBy("h1", "h2")
        .agg(
            F.min("first").alias("first"), F.sum("holders").alias("holders"),
            F.collect_list("slice").alias("slices"),
        )
        .filter(F.col("holders") > 1)
        .select("h1", "h2", "first", F.explode("slices").alias("slice"))
    )
    return (
        ordered.join(answers, group)
        .filter(F.col("doc_id") != F.col("first"))
        .select("doc_id", "version", "pos")
    )


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``keep`` (array of 64-bit words, lowest bit first) and ``n_dropped`` for documents that lose lines.

    Words past the last dropped line are left out: their lines stay.
    """
    dropped = dropped_lines(cut(line_occurrences(docs, min_chars)))
    words = dropped.groupBy("doc_id", "version", F.expr("pos div 64").cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits")
    )
    packed = words.groupBy("doc_id", "version").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"),
        F.sum(F.bit_count("bits")).alias("n_dropped"), F.max("word").alias("last"),
    )
    word = lambda w: F.bitwise_not(F.coalesce(F.element_at("bits", w), F.lit(0).cast("long")))
    return packed.select(
        "doc_id", "version", F.transform(F.sequence(F.lit(0), "last"), word).alias("keep"), "n_dropped"
    )


def kept_text(text: Column, keep: Column) -> Column:
    """The lines whose bit is set, joined again. Lines go through in groups of 64."""

    def group(lines: Column, bits: Column, number: Column) -> Column:
        return F.filter(
            F.slice(lines, number * 64 + 1, F.lit(64)),
            lambda _, i: F.getbit(bits, i) == 1,
        )

    def whole(lines: Column) -> Column:
        heads = F.flatten(F.transform(keep, lambda bits, number: group(lines, bits, number)))
        covered = F.size(keep) * 64
        rest = F.slice(lines, covered + 1, F.greatest(F.size(lines) - covered, F.lit(0)))
        return F.array_join(F.concat(heads, rest), "\n")

    return F.transform(F.array(F.split(text, "\n")), whole)[0]


def dedup_lines(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """All input columns in ``row``, with ``kept`` text, ``n_lines`` and ``n_dropped``."""
    bitmaps = keep_bitmaps(docs, min_chars).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    rows = docs.select(F.struct("*").alias("row"))
    version = F.xxhash64("row.text")
    joined = rows.join(
        bitmaps, (F.col("row.doc_id") == F.col("_id")) & (version == F.col("_version")), "left"
    )
    text = text_or_empty("row.text")
    return joined.select(
        "row",
        F.when(F.col("keep").isNull(), text).otherwise(kept_text(text, F.col("keep"))).alias("kept"),
        (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
        .cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )


def report(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )


def clean(docs: DataFrame) -> DataFrame:
    """The documents with the kept lines as their text and its length in ``n_chars``."""
    found = dedup_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    untouched = (F.col("n_dropped") == 0)
    columns = [
        F.when(untouched, F.col("row")[c]).otherwise(changed[c]).alias(c) if c in changed
        else F.col("row")[c].alias(c)
        for c in docs.columns
    ]
    return found.select(*columns)


#: The report in DuckDB's SQL.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT r, doc_id, i, lines[i] AS line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs)),
firsts AS (
  SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (
  SELECT r, lines.doc_id, i, line, coalesce(lines.doc_id <> first, FALSE) AS gone
  FROM lines LEFT JOIN firsts USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
