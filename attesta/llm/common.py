"""Small helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.operators.ordering import cut

__all__ = ["SPACES", "arrow_rows", "cut", "documents", "lower_ascii", "table", "text_or_empty"]

#: The white space that separates words, and the letters that are lower-cased.
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def lower_ascii(col: Column) -> Column:
    """A-Z in lower case, every other letter as it is."""
    return F.translate(col, UPPER, LOWER)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def arrow_rows(
    row: Callable[..., tuple | None], inputs: list[str], names: list[str], types: list[pa.DataType],
    size: int = 2048,
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function that applies ``row`` to the columns ``inputs`` of each row.

    Results go out in batches of ``size`` rows, so a task holds one input batch and one output
    batch. ``row`` returns a tuple of values, or None for no output row.
    """
    schema = pa.schema(list(zip(names, types)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for values in zip(*[batch.column(name).to_pylist() for name in inputs]):
                made = row(*values)
                if made is not None:
                    out.append(made)
                if len(out) >= size:
                    yield pack(out, schema)
                    out = []
        if out:
            yield pack(out, schema)

    return run


def pack(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema
    )
