"""Best-fit packing: token pieces into sequences of fixed length, with a bounded number of open bins.

Every task tokenises its documents and places each piece at once: online best fit. The open bins
hang on a bitset keyed by their free space, so the best bin for a piece of length L is the lowest
set bit at or above L. When a new bin is needed and all are open, the fullest one closes. The pieces of
a few hundred documents at a time arrive longest first, which leaves less free space. Nothing is
shuffled; a task holds its open bins and one Arrow batch, and a repeated task makes the same rows, since
a scan split always gives the same rows in the same order.

Defined results: a null text counts as empty (one piece with the end token alone); a null
``doc_id`` and repeated rows are packed like any others; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from attesta.llm.byte_bpe import encoder

PIECES = (
    "doc_id {id}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
)


class OpenBins:
    """A fixed number of open bins; ``place`` returns bin number and offset."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.made
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def cuts(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: all full but for the first."""
    first = total % capacity or min(total, capacity)
    starts = [0, *range(first, total, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], total])]


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, open_bins: int = 2048, end_id: int = 2,
    group: int = 1000, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Place every document's pieces.

    ``tokenizer`` is the path of a tokenizer file that all executors can read. ``open_bins`` bounds
    memory, not which rows are packed; ``group`` documents arrive together.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], PIECES.format(id=kind)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        names = schema.names
        end = np.array([end_id], dtype="<u4")
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                pieces: list[tuple] = []
                for i, text in enumerate(part.column(1).to_pylist()):
                    tokens = np.append(encode(text or "").astype("<u4"), end)
                    for piece, (start, length) in enumerate(cuts(len(tokens), capacity)):
                        pieces.append((i, piece, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
                pieces.sort(key=lambda p: -p[3])
                places = [bins.place(p[3]) for p in pieces]
                i, *columns = zip(*pieces)
                columns += [[base + number for number, _ in places], [offset for _, offset in places]]
                kinds = [pa.int32(), *[pa.int64()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i, pa.int64())), *map(pa.array, columns, kinds)], names=names
                )

    return docs.select(id_col, text_col).mapInArrow(run, schema)
