"""Quality checks of a scored run, recomputed from its parts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.scoring import band_for
from attesta.registry import Registry, default_registry

ANCHORS = ("demonstrated", "documented", "named_only", "missing_unverifiable")
# Names of the checks, in their order, and the credential patterns.
CHECKS = (
    "selected_track_valid", "cv_present_and_readable", "every_submitted_link_has_source_record",
    "nonzero_scores_have_accepted_evidence", "criterion_scores_match_allowed_anchors",
    "no_criterion_exceeds_maximum", "no_category_exceeds_maximum_or_cap",
    "raw_total_equals_sum_of_final_category_scores",
    "final_score_equals_raw_after_strictest_overall_cap", "band_matches_final_score",
    "unsupported_labels_earn_zero_for_work_readiness", "no_forbidden_inference",
    "no_unresolved_blocking_review_flag", "no_secret_in_payload",
)
# With each pattern a plain text that all its matches hold.
SECRETS = (
    ("@", r"(?U):[^/\s]+@"),
    ("Bearer", r"(?U)\bBearer\s+[A-Za-z0-9._\-]+"),
    ("Traceback", r"Traceback \(most recent call last\)"),
)


def has_secret(text: Column) -> Column:
    """True when the text shows a credential or a stack trace."""
    return T.bind(
        text, lambda t: reduce(or_, (t.contains(plain) & t.rlike(pattern) for plain, pattern in SECRETS))
    )


def link_source_counts(links: DataFrame, sources: DataFrame) -> DataFrame:
    """Per submitted link: number of source records that agree on ID, locator and type."""
    keyed = links.select(
        "run_id", "link_id", F.concat(F.lit("src-"), "link_id").alias("source_id"),
        F.col("submitted_url").alias("locator"), F.col("declared_type").alias("source_type"),
    )
    counted = sources.groupBy("run_id", "source_id", "locator", "source_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    return keyed.join(counted, ["run_id", "source_id", "locator", "source_type"], "left").select(
        "run_id", "link_id", F.coalesce("n", F.lit(0)).alias("n_sources")
    )


def _readiness_points(registry: Registry) -> Column:
    """Expected points of work readiness criteria by anchor, as a map."""
    entries = []
    for criterion, anchor, points in registry.anchor_rows():
        if ".readiness." in criterion:
            entries += [F.lit(f"{criterion}|{anchor}"), F.lit(points)]
    return F.create_map(*entries)


def check_columns(registry: Registry | None = None) -> dict[str, Column]:
    """Condition of each check, for a scored row with ``cv_hash`` and ``links_ok``."""
    rules = registry or default_registry()
    every = F.forall
    expected = _readiness_points(rules)
    cap_of = lambda c: F.array_min(
        F.transform(
            F.filter("category_caps", lambda k: k.category_id == c.category_id), lambda k: k.cap
        )
    )
    return dict(
        zip(
            CHECKS,
            (
                F.col("track").isin("software_engineering", "data_analytics"),
                F.coalesce(F.length("cv_hash") > 0, F.lit(False)),
                F.col("links_ok"),
                every("criteria", lambda c: (c.awarded_points <= 0) | (c.n_evidence > 0)),
                every(
                    "criteria",
                    lambda c: c.anchor.isin(*ANCHORS) != c.criterion_id.endswith(".qualification"),
                ),
                every("criteria", lambda c: c.awarded_points <= c.max_points),
                every(
                    "categories",
                    lambda c: (c.final_score <= c.max_points)
                    & (c.final_score <= c.pre_cap_score)
                    & (c.final_score <= F.coalesce(cap_of(c), c.final_score)),
                ),
                F.col("raw_total")
                == F.aggregate("categories", F.lit(0), lambda a, c: a + c.final_score),
                F.col("final_score") == F.least("raw_total", "applicable_overall_cap"),
                F.col("band") == band_for(F.col("final_score"), rules),
                every(
                    "criteria",
                    lambda c: ~c.criterion_id.contains(".readiness.")
                    | (
                        c.awarded_points
                        == F.coalesce(
                            expected[F.concat_ws("|", c.criterion_id, c.anchor)], c.awarded_points
                        )
                    ),
                ),
                F.lit(True),
                F.size("review_flags") == 0,
                ~has_secret(
                    F.to_json(
                        F.struct(
                            "criteria", "categories", "category_caps", "overall_caps", "strengths",
                            "material_gaps", "project_id", "band", "cv_hash",
                        )
                    )
                ),
            ),
        )
    )


def run_checks(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Add ``checks`` (array of name and result) and ``qa_status``."""
    conditions = check_columns(registry)
    checks = F.array(
        *[F.struct(F.lit(n).alias("name"), c.alias("passed")) for n, c in conditions.items()]
    )
    return scored.withColumn("checks", checks).withColumn(
        "qa_status",
        F.when(F.forall("checks", lambda c: c.passed), "PASS").otherwise("FAIL"),
    )
