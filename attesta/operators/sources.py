"""Source records: building, comparing and summarising them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.checkouts import in_ranges, last_before

# Notes of source records.
CV_NOTE = "Candidate-submitted CV extracted without classification or scoring."
LINK_NOTE = "Candidate-submitted link retrieved without classification or scoring."


def cv_source_record(
    document_id: Column, retrieved_at: Column, content_hash: Column, locator: Column, extractor_version: Column
) -> Column:
    """Source record of a CV that was read."""
    return F.struct(
        document_id.alias("source_id"), F.lit("cv").alias("source_type"),
        F.lit(True).alias("submitted_by_candidate"), F.lit("accessible").alias("access_status"),
        F.lit("attributed").alias("ownership_status"), retrieved_at.alias("retrieved_at"),
        content_hash.alias("content_hash"), extractor_version.alias("extractor_version"), locator.alias("locator"), F.lit(CV_NOTE).alias("notes"),
    )


def link_source_record(
    link_id: Column, declared_type: Column, submitted_url: Column, retrieved_at: Column,
    access_status: Column, content_hash: Column, extractor_version: Column,
) -> Column:
    """Source record of a submitted link; who owns it is never known."""
    return F.struct(
        F.concat(F.lit("src-"), link_id).alias("source_id"), declared_type.alias("source_type"),
        F.lit(True).alias("submitted_by_candidate"), access_status.alias("access_status"),
        F.lit("unclear").alias("ownership_status"), retrieved_at.alias("retrieved_at"),
        content_hash.alias("content_hash"), extractor_version.alias("extractor_version"), submitted_url.alias("locator"), F.lit(LINK_NOTE).alias("notes"),
    )


def numbered_links(urls: Column) -> Column:
    """Submitted URLs of one submission, in order, with the IDs link-001, link-002 and so on."""
    return F.transform(
        urls, lambda u, i: F.struct(F.format_string("link-%03d", i + 1).alias("link_id"), u.alias("submitted_url"))
    )


def source_snapshot(sources: DataFrame) -> DataFrame:
    """Hashes of a run's CV and, in order, of its links that have one."""
    link = (F.col("source_type") != "cv") & F.col("content_hash").isNotNull()
    return sources.groupBy("run_id").agg(
        F.max(F.when(F.col("source_type") == "cv", F.col("content_hash"))).alias("cv_hash"),
        F.transform(
            F.array_sort(F.collect_list(F.when(link, F.struct("source_ord", "content_hash")))),
            lambda s: s.content_hash,
        ).alias("link_content_hashes"),
    )


def source_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Records that one side has and the other has not, or has differently."""
    mine = left.select(*columns).exceptAll(right.select(*columns)).withColumn("side", F.lit("left"))
    other = right.select(*columns).exceptAll(left.select(*columns)).withColumn("side", F.lit("right"))
    return mine.unionByName(other)


def retrievals_as_of(links: DataFrame, retrievals: DataFrame) -> DataFrame:
    """(run_id, source_id, latest): the last retrieval of each link that is not later than its run.

    ``links``: run_id, source_id, locator, assessed_at. ``retrievals``: locator, retrieved_at, access_status,
    content_hash; of several at one time the greatest by status and hash counts. Both sides lie in one order by
    locator and time, range-partitioned, and the last retrieval is carried over between partitions, so a locator that
    very many runs link, or that is retrieved very often, is split and pairs are never made.
    """
    got = F.struct("retrieved_at", "access_status", "content_hash")
    no_text, no_id = F.lit(None).cast("string"), F.lit(None).cast(links.schema["run_id"].dataType)
    once = retrievals.groupBy("locator", "retrieved_at").agg(F.max(got).alias("got"))
    events = once.select(
        F.col("locator").alias("owner"), F.unix_micros("retrieved_at").alias("us"), F.lit(0).alias("event_id"), "got",
        no_id.alias("run_id"), no_text.alias("source_id"),
    ).unionByName(links.select(
        F.col("locator").alias("owner"), F.unix_micros("assessed_at").alias("us"), F.lit(1).alias("event_id"),
        F.lit(None).cast(once.schema["got"].dataType).alias("got"), "run_id", "source_id",
    ))
    looked = last_before(in_ranges(events), {"latest": F.col("got")})
    return looked.filter((F.col("event_id") == 1) & F.col("latest").isNotNull()).select("run_id", "source_id", "latest")


def with_retrievals(sources: DataFrame, blocks: DataFrame, runs: DataFrame, retrievals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources and blocks of each run as its links were at ``runs.assessed_at``.

    A link without a retrieval until then, or whose last one failed, is inaccessible: it has no content hash and its
    blocks are not read. CVs stay as they are. Only blocks of links are joined, so CV texts are not shuffled.
    """
    is_cv = F.col("source_type") == "cv"
    links = sources.filter(~is_cv).join(runs.select("run_id", "assessed_at"), "run_id")
    found = retrievals_as_of(links.select("run_id", "source_id", "locator", "assessed_at"), retrievals)
    keys = ["run_id", "source_id"]
    status = F.coalesce("latest.access_status", F.lit("inaccessible"))
    seen = sources.filter(~is_cv).join(found, keys, "left").withColumn("access_status", status).withColumn(
        "content_hash", F.when(status == "accessible", F.col("latest.content_hash"))
    )
    readable = found.filter(F.col("latest.access_status") == "accessible").select(*keys, F.lit(True).alias("_read"))
    link_blocks = blocks.filter(~is_cv).join(readable, keys, "left").withColumn("accessible", F.col("_read").isNotNull())
    return (
        sources.filter(is_cv).unionByName(seen.select(*sources.columns)),
        blocks.filter(is_cv).unionByName(link_blocks.select(*blocks.columns)),
    )
