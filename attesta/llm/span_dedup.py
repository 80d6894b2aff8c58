"""Substring dedup over sliding spans of sentences.

Every run of several consecutive sentences is hashed, the hashes are joined over all documents, and the
sentences that a repeated run covers are removed, except in the first document that holds the run
(and there, except in its first place). A passage that is shared but cut into fewer sentences than a run
has is still found when it is long: runs of fewer sentences count from ``long_words`` words on. Runs of
fewer than ``min_words`` words are no evidence and are not hashed.

Steps: (1) one scan cuts texts into sentences and writes (hash, document, run number) once to the shared
folder, each run of a document once; (2) the first document of every hash comes from a plain aggregation, merged
before the shuffle, so a passage held by a third of all documents costs one row a task; (3) the run rows
are joined with the repeated hashes only (adaptive execution splits a hot hash) and become lists of run
numbers a document; (4) a second scan removes the covered sentences. Only the removal of step 4 moves
texts.

Sentences end after ``.``, ``!`` or ``?`` before white space, or at a line end. They are compared with white
space reduced to one space and A-Z lower-cased. White space after a sentence goes with it; pieces without a
word always stay.

Defined results: a null text counts as empty and stays empty; a row without ``doc_id`` is nobody's copy and
only loses its own repeats; rows that repeat a ``doc_id`` belong to one document; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import LOWER, UPPER, cut

PIECE = re.compile("(?s).+?(?:[.!?][ \t\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*|\\Z)")
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


@dataclass(frozen=True)
class Settings:
    """Sentences in a run; words a run needs; words from which shorter runs count too."""

    run: int = 3
    min_words: int = 12
    long_words: int = 50


def pieces(text: str) -> list[str]:
    """The text cut after every sentence; the pieces make up the whole text."""
    return PIECE.findall(text)


def runs_of(parts: list[str], settings: Settings) -> list[tuple[bytes, list[int]]]:
    """(hash, covered pieces) of every run, in the order of their starts."""
    digest = xxhash.xxh3_128_digest
    places, marks, sizes = [], [], []
    for i, part in enumerate(parts):
        words = part.encode("utf-8").translate(TO_LOWER).split()
        if words:
            places.append(i)
            marks.append(digest(b" ".join(words)))
            sizes.append(len(words))
    out = []
    for start in range(len(places)):
        total = 0
        for size in range(1, min(settings.run, len(places) - start) + 1):
            total += sizes[start + size - 1]
            if total >= (settings.min_words if size == settings.run else settings.long_words):
                covered = places[start : start + size]
                out.append((digest(b"".join(marks[start : start + size])), covered))
    return out


def run_rows(docs: DataFrame, settings: Settings) -> DataFrame:
    """(h1, h2, doc_id, version, run): every run of a document once, with its number."""
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("version"), "text"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                owners, numbers, hashes = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    seen = set()
                    for number, (mark, _) in enumerate(runs_of(pieces(text), settings)):
                        if mark not in seen:
                            seen.add(mark)
                            owners.append(i)
                            numbers.append(number)
                            hashes.append(mark)
                halves = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                take = pa.array(owners, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), part.column(0).take(take),
                        part.column(1).take(take), pa.array(numbers, pa.int32()),
                    ],
                    names=["h1", "h2", "doc_id", "version", "run"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, version long, run int")


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(doc_id, version, runs): numbers of the runs that an earlier document holds."""
    firsts = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        F.col("first") != F.col("last")
    )
    later = rows.join(firsts, ["h1", "h2"]).filter(F.col("doc_id") != F.col("first"))
    return later.groupBy("doc_id", "version").agg(F.collect_list("run").alias("runs"))


def without_runs(text: str | None, gone: list[int] | None, settings: Settings) -> tuple[str, int, int]:
    """(kept text, sentences, removed sentences)."""
    parts = pieces(text or "")
    dropped: set[int] = set()
    runs = runs_of(parts, settings)
    hidden = {runs[n][0] for n in gone or ()}  # first held by another document: every place goes
    seen: set[bytes] = set()
    for mark, covered in runs:
        if mark in hidden or mark in seen:
            dropped.update(covered)
        seen.add(mark)
    sentences = sum(1 for p in parts if p.split())
    return "".join(p for i, p in enumerate(parts) if i not in dropped), sentences, len(dropped)


def dedup_spans(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_sentences, n_removed, text) with the kept text of every document."""
    gone = repeated_runs(cut(run_rows(docs, settings))).withColumnsRenamed({"doc_id": "_id", "version": "_version"})
    joined = docs.select("doc_id", "text").join(
        gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_version")), "left"
    ).select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [
                without_runs(t, r, settings)
                for t, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            texts, sentences, removed = zip(*made) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sentences, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_sentences", "n_removed", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_sentences long, n_removed long, text string")


def report(docs: DataFrame) -> DataFrame:
    return dedup_spans(docs).select(
        "doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "text"
    )


#: The report in DuckDB's SQL.
SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text,
    regexp_extract_all(coalesce(text, ''), '(?s).+?(?:[.!?][ \t\x0b\x0c\r]+|\n[ \t\n\x0b\x0c\r]*|\z)') AS parts
  FROM documents),
pieces AS (SELECT r, doc_id, i, parts[i] AS piece, list_filter(
    regexp_split_to_array(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'),
    lambda w: w <> '') AS w
  FROM (SELECT r, doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM docs)),
sentences AS (
  SELECT r, doc_id, i, array_to_string(w, ' ') AS key, len(w) AS n, row_number() OVER (PARTITION BY r ORDER BY i) AS s
  FROM pieces WHERE len(w) > 0),
ahead AS (
  SELECT *, lead(key) OVER o AS key2, lead(key, 2) OVER o AS key3, lead(n) OVER o AS n2, lead(n, 2) OVER o AS n3
  FROM sentences WINDOW o AS (PARTITION BY r ORDER BY s)),
runs AS (
  SELECT r, doc_id, s, 1 AS size, key AS run FROM ahead WHERE n >= 50
  UNION ALL SELECT r, doc_id, s, 2, key || chr(10) || key2 FROM ahead WHERE n + n2 >= 50
  UNION ALL SELECT r, doc_id, s, 3, key || chr(10) || key2 || chr(10) || key3 FROM ahead WHERE n + n2 + n3 >= 12),
firsts AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),
own AS (SELECT r, run, min(s) AS s FROM runs GROUP BY r, run),
gone AS (
  SELECT DISTINCT runs.r, runs.s + k AS s
  FROM runs JOIN firsts USING (run) JOIN own ON own.r = runs.r AND own.run = runs.run,
    (VALUES (0), (1), (2)) AS v(k)
  WHERE k < size AND (doc_id <> first OR runs.s > own.s)),
marked AS (
  SELECT p.r, p.i, p.piece, s.s, g.s IS NOT NULL AS dropped
  FROM pieces p LEFT JOIN sentences s ON s.r = p.r AND s.i = p.i LEFT JOIN gone g ON g.r = p.r AND g.s = s.s),
kept AS (
  SELECT r, count(s) AS n_sentences, count(*) FILTER (dropped) AS n_removed,
    coalesce(string_agg(piece, '' ORDER BY i) FILTER (NOT dropped), '') AS kept
  FROM marked GROUP BY r)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256, coalesce(kept, '') AS text
FROM docs LEFT JOIN kept USING (r)
"""
