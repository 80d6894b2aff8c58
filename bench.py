"""Times the headline jobs and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from attesta.plans.assessment import assess
from attesta.operators import evidence, market, posts as O
from attesta.session import local_session, read_table
from attesta.sources import html
from entries import base, post_queries
from entries.base import QUERIES
import entries.assessment_queries  # noqa: F401
import entries.record_queries  # noqa: F401
from pyspark.sql import functions as F


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def jobs(spark, folder):
    """Name and action of each job; every action reads whole tables."""

    def whole_assessment():
        batch = assess(base.runs(spark, folder), base.sources(spark, folder), base.blocks(spark, folder))
        noop(batch.outcomes)

    def plain(name):
        return lambda: noop(QUERIES[name](spark, folder))

    def page_posts():
        pages = html.parse_pages(read_table(spark, folder, "pages")).withColumn("track", F.lit("SE Track"))
        noop(O.extract_posts(pages, F.lit("2026-01-01")))

    yield "l2_evidence_normalisation", lambda: noop(evidence.normalize_evidence(base.blocks(spark, folder)))
    yield "l8_assessment_batch", whole_assessment
    yield "l1_post_extraction", lambda: noop(post_queries.records(spark, folder))
    yield "l1_page_extraction", page_posts
    for name in (
        "a2_visible_blocks", "h2_split_sentences", "c22_duplicate_posts", "m1_label_frequency", "m2_label_pairs",
        "l10_run_store_merge", "d5_line_totals", "f1_line_top5", "h37_line_percent", "e11_latest_run",
        "j1_exactly_once_unlock",
    ):
        yield name, plain(name)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "attesta-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = set(sys.argv[1:])
    times = {}
    for name, run in jobs(spark, folder):
        if only and name not in only:
            continue
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline jobs wall time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": folder.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
