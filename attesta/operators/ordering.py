"""Numbering, first-occurrence and precedence helpers that hold up when one key is very large."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Write a result used several times to the shared folder and read it back.

    Later branches then prune its columns and a lost executor does not recompute the text scan.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/attesta/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    bucket: Sequence[Column],
    name: str = "row_no",
) -> DataFrame:
    """1-based position of every row within ``keys`` by ``order``, without one task per key.

    ``bucket`` has to grow with ``order`` (its leading columns, coarsened). Rows are numbered
    inside a bucket and shifted by the number of rows in earlier buckets, which is a running sum
    over one small row per bucket.
    """
    slots = [f"_slot{i}" for i in range(len(bucket))]
    slotted = df.select("*", *[b.alias(s) for b, s in zip(bucket, slots)])
    return _numbered(slotted, keys, order, slots, name)


def number_in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_no") -> DataFrame:
    """As ``number_rows``, for an order whose values may lie anywhere, such as hashes.

    The rows are range-partitioned by key and order, and the partition is the bucket; the result of the
    partitioning is written once, so its bounds are the same for all who read it. There is one small row per key and
    partition, however the values are spread.
    """
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_slot0", F.spark_partition_id()))
    return _numbered(ranged, keys, order, ["_slot0"], name)


def _numbered(slotted: DataFrame, keys: Sequence[str], order: Sequence[str], slots: Sequence[str], name: str) -> DataFrame:
    sizes = slotted.groupBy(*keys, *slots).agg(F.count(F.lit(1)).alias("_size"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(*slots)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = sizes.select(
        *keys, *slots, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy(*keys, *slots).orderBy(*order)
    return (
        slotted.withColumn("_inner", F.row_number().over(inside))
        .join(shifts, [*keys, *slots])
        .withColumn(name, (F.col("_inner") + F.col("_shift")).cast("int"))
        .drop("_inner", "_shift", *slots)
    )


def rank_struct(*cols: Column) -> Column:
    """Struct to be used with ``max_by``: compares the columns one after the other."""
    return F.struct(*[c.alias(f"r{i}") for i, c in enumerate(cols)])


def earliest(order: Sequence[str]) -> list[Column]:
    """Order columns negated, so that the maximum is the earliest row."""
    return [-F.col(c) for c in order]


#: Rows of a connected group of repeats that are decided one after the other.
GROUP_ROWS = 2000


def first_of_both(rows: DataFrame, order: str, key_a: str, key_b: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows that repeat no earlier kept row in either key. ``key_b`` may be null.

    A row only competes with rows that were kept. A round decides all rows at once that are the first undecided one of
    both their keys, and those that share a key with such a row, however many share it. What one round leaves falls
    into connected groups of rows that share keys. Groups of up to ``group_rows`` rows are decided in one pass, each in
    a fold over its rows in order, so a chain of repeats costs no round per link; larger ones go on in rounds.
    """
    kept, rest = _round(cut(rows.select(order, key_a, key_b)), order, key_a, key_b)
    small = True
    while not rest.isEmpty():
        if small:
            grouped = cut(_connected(rest, order, key_a, key_b))
            kept = kept.unionByName(_folded(grouped.filter(F.col("_rows") <= group_rows), order, key_a, key_b))
            rest, small = cut(grouped.filter(F.col("_rows") > group_rows).select(order, key_a, key_b)), False
        else:
            chosen, rest = _round(rest, order, key_a, key_b)
            kept = kept.unionByName(chosen)
    return kept


def _first_of_keys(rows: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Rows with the first row of each of their keys."""
    first_a = rows.groupBy(key_a).agg(F.min(order).alias("_first_a"))
    first_b = rows.filter(F.col(key_b).isNotNull()).groupBy(key_b).agg(F.min(order).alias("_first_b"))
    return rows.join(first_a, key_a).join(first_b, key_b, "left")


def _round(narrow: DataFrame, order: str, key_a: str, key_b: str) -> tuple[DataFrame, DataFrame]:
    """(kept, undecided) rows after one round."""
    ranked = _first_of_keys(narrow, order, key_a, key_b)
    is_first = (F.col("_first_a") == F.col(order)) & (
        F.col("_first_b").isNull() | (F.col("_first_b") == F.col(order))
    )
    chosen = cut(ranked.filter(is_first).select(order, key_a, key_b))
    rest = narrow.join(chosen.select(key_a), key_a, "left_anti").join(
        chosen.filter(F.col(key_b).isNotNull()).select(key_b), key_b, "left_anti"
    )
    return chosen, cut(rest.select(order, key_a, key_b))


def _connected(rows: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Rows with ``_group``, the same for rows that keys connect, and its number of rows.

    Every row is linked to the first row of each key, not to all that share it. Rows are named by a hash; equal hashes
    only put groups together.
    """
    from attesta.operators.groups import components

    ranked = _first_of_keys(rows, order, key_a, key_b).select(
        order, key_a, key_b, F.xxhash64(order).alias("_node"), F.xxhash64("_first_a").alias("_a"),
        F.when(F.col("_first_b").isNotNull(), F.xxhash64("_first_b")).alias("_b"),
    )
    ranked = cut(ranked)
    links = ranked.select(F.col("_node").alias("a"), F.col("_a").alias("b")).unionByName(
        ranked.filter(F.col("_b").isNotNull()).select(F.col("_node").alias("a"), F.col("_b").alias("b"))
    )
    roots = components(links).select(F.col("node").alias("_node"), F.col("root").alias("_group"))
    named = ranked.join(roots, "_node", "left").withColumn("_group", F.coalesce("_group", "_node"))
    sizes = named.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows"))
    return named.join(sizes, "_group").select(order, key_a, key_b, "_group", "_rows")


def _folded(grouped: DataFrame, order: str, key_a: str, key_b: str) -> DataFrame:
    """Kept rows of small groups, each decided by a fold over its rows in order."""
    fields = grouped.select(order, key_a, key_b).schema
    types = {f.name: f.dataType.simpleString() for f in fields}
    row = F.struct(F.col(order).alias("o"), F.col(key_a).alias("a"), F.col(key_b).alias("b"))
    start = F.struct(
        F.array().cast(f"array<struct<o:{types[order]},a:{types[key_a]},b:{types[key_b]}>>").alias("kept"),
        F.array().cast(f"array<{types[key_a]}>").alias("as"), F.array().cast(f"array<{types[key_b]}>").alias("bs"),
    )

    def step(state: Column, x: Column) -> Column:
        seen = F.array_contains(state["as"], x["a"]) | F.coalesce(F.array_contains(state["bs"], x["b"]), F.lit(False))
        bs = F.when(x["b"].isNull(), state["bs"]).otherwise(F.concat(state["bs"], F.array(x["b"])))
        with_row = F.struct(
            F.concat(state["kept"], F.array(x)).alias("kept"), F.concat(state["as"], F.array(x["a"])).alias("as"),
            bs.alias("bs"),
        )
        return F.when(seen, state).otherwise(with_row)

    lists = grouped.groupBy("_group").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    told = lists.select(F.explode(F.aggregate("rows", start, step, lambda s: s["kept"])).alias("r"))
    return cut(told.select(F.col("r.o").alias(order), F.col("r.a").alias(key_a), F.col("r.b").alias(key_b)))
