"""Market figures over collected posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def post_labels(posts: DataFrame, columns: list[str]) -> DataFrame:
    """One row per post and label, from the comma-separated label columns."""
    parts = F.array_distinct(F.flatten(F.array(*[F.split(c, ", ") for c in columns])))
    return posts.select("page_id", "track", F.explode(F.filter(parts, lambda x: x != "")).alias("label"))


def label_frequency(posts: DataFrame, columns: list[str]) -> DataFrame:
    """In how many posts of its track a label occurs. Labels are distinct per post, so counts do."""
    totals = posts.groupBy("track").agg(F.count(F.lit(1)).alias("n_track"))
    counts = post_labels(posts, columns).groupBy("track", "label").agg(F.count(F.lit(1)).alias("n_posts"))
    return counts.join(F.broadcast(totals), "track")


def label_pairs(posts: DataFrame, columns: list[str]) -> DataFrame:
    """In how many posts two labels occur together.

    A post holds at most the labels of its vocabularies, so its pairs are built inside the row:
    no self join on the post and no shuffle before the final counts.
    """
    parts = F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*[F.split(c, ", ") for c in columns])), lambda x: x != "")))
    pairs = F.flatten(
        F.transform(
            parts,
            lambda a: F.transform(
                F.filter(parts, lambda b: a < b),
                lambda b: F.struct(a.alias("label_a"), b.alias("label_b")),
            ),
        )
    )
    return (
        posts.select("track", F.explode(pairs).alias("p"))
        .groupBy("track", F.col("p.label_a").alias("label_a"), F.col("p.label_b").alias("label_b"))
        .agg(F.count(F.lit(1)).alias("n_posts"))
    )


def known_share(posts: DataFrame, column: str) -> DataFrame:
    """Counts of a value among the posts where it is known."""
    known = posts.filter(F.col(column) != "")
    totals = known.groupBy("track").agg(F.count(F.lit(1)).alias("n_known"))
    values = known.groupBy("track", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return values.join(F.broadcast(totals), "track")


def distribution(posts: DataFrame, column: str) -> DataFrame:
    return posts.groupBy("track", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def reconciliation(posts: DataFrame, key: Column, treatment: Column) -> DataFrame:
    """Raw and unique posts by treatment and track, with totals."""
    rows = posts.select("track", key.alias("_key"), treatment.alias("treatment"), "page_id")
    unique = rows.groupBy("track", "_key").agg(
        F.min_by("treatment", "page_id").alias("treatment"), F.count(F.lit(1)).alias("copies")
    )
    return unique.rollup("treatment", "track").agg(
        F.sum("copies").alias("n_raw"), F.count(F.lit(1)).alias("n_unique")
    )
