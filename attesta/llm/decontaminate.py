"""Benchmark decontamination by Wu-Manber search over words.

Benchmark items become windows of a fixed number of words (a shorter item is one window). All
windows of one length form a search table:

* the shift table says for every block of two words how far the search may jump; a block that no
  window holds lets it skip a whole window but one word;
* a block that ends a window leads to a bucket of windows, which are compared directly.

The tables are made from a block of benchmark items of bounded size (``block_bytes`` of text) and
travel with the task. A benchmark beyond the bound is searched in several blocks: one pass over the
same rows for each, chained in one stage, so texts are never shuffled and no table outgrows its bound.

Defined results: a null or empty text has no words; an item without words has no window; a null
``item_id`` counts as the empty text; repeated items count once per id; repeated documents give a
row each; with an empty benchmark no word is hit; further columns of the input are kept only when
``keep`` names them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that belong to words; A-Z turns into a-z, all others separate words.
WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(0x80, 0x100))
TO_WORDS = bytes(
    b if b in WORD_BYTES else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TO_WORDS).split() if text else []


class Windows:
    """Search table for windows of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.items: list[tuple[str, list[bytes]]] = []
        self.jump = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, item: str, words: list[bytes]) -> None:
        number = len(self.items)
        self.items.append((item, words))
        size, length = self.block, self.length
        for start in range(len(words) - length + 1):
            for end in range(size, length + 1):
                block = tuple(words[start + end - size : start + end])
                left = length - end
                if left < self.shift.get(block, self.jump):
                    self.shift[block] = left
            last = tuple(words[start + length - size : start + length])
            self.bucket.setdefault(last, []).append((number, start))

    def search(self, words: list[bytes], hits: list[tuple[int, int]], found: set[str]) -> None:
        length, size, jump, shift = self.length, self.block, self.jump, self.shift.get
        at, end = length - 1, len(words)
        while at < end:
            block = (words[at - 1], words[at]) if size == 2 else (words[at],)
            step = shift(block, jump)
            if step:
                at += step
                continue
            candidate = words[at - length + 1 : at + 1]
            hit = False
            for number, start in self.bucket[block]:
                item, own = self.items[number]
                if own[start : start + length] == candidate:
                    hit = True
                    found.add(item)
            if hit:
                hits.append((at - length + 1, at + 1))
            at += 1


def tables_of(items: list[tuple[str, str]], length: int) -> list[Windows]:
    """One table for full windows, and one for each smaller item length that occurs."""
    made: dict[int, Windows] = {}
    for item, text in items:
        words = words_of(text)
        if words:
            size = min(length, len(words))
            made.setdefault(size, Windows(size)).add(item, words)
    return list(made.values())


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``block_bytes`` of text; the driver holds one at a time."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text")
    ).filter(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // block_bytes + 1
    which = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    for number in range(blocks):
        part = rows.filter(which == number) if blocks > 1 else rows
        yield [(r["item"], r["text"]) for r in part.toLocalIterator()]


def search_documents(
    docs: DataFrame, benchmark: DataFrame, keep: list[str], length: int = 10,
    block_bytes: int = 4_000_000, text_col: str = "text",
) -> DataFrame:
    """The columns ``keep`` with ``_n_words``, merged ``_spans`` (word ranges hit) and ``_items``."""
    names = [*keep, *([text_col] if text_col not in keep else [])]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    found = docs.select(
        *names, F.lit(0).cast("long").alias("_n_words"), F.lit(None).cast(span).alias("_spans"),
        F.lit(None).cast("array<string>").alias("_items"),
    )
    for items in item_blocks(benchmark, block_bytes):
        found = found.mapInArrow(_search(items, length, text_col), found.schema)
    return found.select(*keep, "_n_words", *[
        F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)).alias(c) for c in ("_spans", "_items")
    ])


def _search(items: list[tuple[str, str]], length: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = tables_of(items, length)
        for batch in batches:
            counts, spans, names = [], batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                words = words_of(text)
                counts.append(len(words))
                hits: list[tuple[int, int]] = []
                found: set[str] = set()
                for made in tables:
                    made.search(words, hits, found)
                if hits:
                    hits += [(s["start"], s["end"]) for s in spans[i] or []]
                    spans[i] = [{"start": s, "end": e} for s, e in merged(hits)]
                    names[i] = sorted(found.union(names[i] or []))
            fields = batch.schema
            columns = {
                "_n_words": pa.array(counts, pa.int64()),
                "_spans": pa.array(spans, fields.field("_spans").type),
                "_items": pa.array(names, fields.field("_items").type),
            }
            yield pa.RecordBatch.from_arrays(
                [columns.get(f.name, batch.column(j)) for j, f in enumerate(fields)], names=fields.names
            )

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def hit_words() -> Column:
    """Number of words inside the spans."""
    return F.aggregate(
        "_spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]
    )


def report(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """Counts and the digest of the items found, one row per document."""
    found = search_documents(docs, benchmark, ["doc_id"], length)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), hit_words().alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        (F.size("_spans") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, length: int = 10) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # own names, whatever the input's are
    text_col = plain.columns[columns.index("text")]
    found = search_documents(plain, benchmark, plain.columns, length, text_col=text_col)
    return found.filter(F.size("_spans") == 0).select(*plain.columns).toDF(*columns)


#: The report in DuckDB's SQL.
SQL = r"""
WITH item_words AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x{00}-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2),
      lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS window_text
  FROM item_words WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, row_number() OVER () AS r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x{00}-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc_words, sizes WHERE len(w) >= size),
hits AS (
  SELECT p.r, p.i, p.size, v.item
  FROM (SELECT p.r, p.i, p.size, array_to_string(d.w[p.i:p.i + p.size - 1], ' ') AS window_text
        FROM places p JOIN doc_words d USING (r)) p
  JOIN windows v USING (size, window_text)),
counts AS (
  SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS j FROM hits) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN counts USING (r) LEFT JOIN names USING (r)
"""
