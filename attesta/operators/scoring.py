"""Points, caps, band, strengths, gaps, actions and project per run.

A run has 26 criteria, so they travel as one array of that length. Two shuffles bring the points of
a run together; everything after that is computed inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.binding import PLAIN_SCREENSHOT, SHEETS_CEILING
from attesta.registry import Registry, default_registry
from attesta.registry.rubric_values import NO_PROJECT
from attesta.registry.tables import DA, SE

NONE_ANCHORS = ("missing_unverifiable", "se.qual.none", "da.qual.none")
# Fixed values of two special scoring rules.
SHEETS_POINTS = 5
TOP = 5


def band_for(score: Column, registry: Registry | None = None) -> Column:
    """Band of a final score."""
    chain = F
    for band, _, low, high in (registry or default_registry()).bands:
        chain = chain.when(score.between(low, high), band)
    return chain


def awarded_points(criterion: Column, points: Column, max_points: Column, triggers: Column) -> Column:
    """Points of an anchor after the special rules."""
    capped = F.when(
        (criterion == "da.core.spreadsheets") & F.array_contains(triggers, SHEETS_CEILING),
        F.least(points, F.lit(SHEETS_POINTS)),
    ).when(
        (criterion == "da.projects.context") & F.array_contains(triggers, PLAIN_SCREENSHOT), 0
    ).otherwise(points)
    return F.least(capped, max_points)


def rule_ids(criterion: Column, rule_id: Column, triggers: Column) -> Column:
    """Rules that took part in the points of a criterion."""
    return F.array_compact(
        F.array(
            rule_id,
            F.when(
                (criterion == "da.core.spreadsheets") & F.array_contains(triggers, SHEETS_CEILING),
                SHEETS_CEILING,
            ),
            F.when(
                (criterion == "da.projects.context") & F.array_contains(triggers, PLAIN_SCREENSHOT),
                PLAIN_SCREENSHOT,
            ),
        )
    )


def evidence_note(label: Column, anchor: Column, n_evidence: Column) -> Column:
    return F.when(
        (n_evidence == 0) & anchor.isin(*NONE_ANCHORS),
        F.format_string("No accepted evidence was present for %s.", label),
    ).otherwise(F.format_string("%s scored from locked %s evidence.", label, anchor))


def point_gap(max_points: Column, awarded: Column) -> Column:
    return max_points - awarded


def gap_ratio(max_points: Column, awarded: Column) -> Column:
    return (max_points - awarded).cast("double") / max_points


def project_link_present(registry: Registry) -> Column:
    """An accessible project link of the candidate exists among the sources of a group."""
    return F.bool_or(
        F.col("source_type").isin(*registry.project_source_types)
        & F.col("submitted_by_candidate")
        & (F.col("access_status") == "accessible")
    )


def criterion_points(
    bindings: DataFrame, context: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Awarded points per run and criterion, joined with the small rule tables only."""
    rules = registry or default_registry()
    spark = bindings.sparkSession
    criteria = rules.table(spark, "criterion")
    anchors = rules.table(spark, "criterion_anchor")
    return (
        bindings.join(F.broadcast(criteria), "criterion_id")
        .join(F.broadcast(anchors), ["criterion_id", "anchor"], "left")
        .join(context.select("run_id", "rule_triggers"), "run_id")
        .withColumn(
            "awarded_points",
            awarded_points(F.col("criterion_id"), F.col("points"), F.col("max_points"), F.col("rule_triggers")),
        )
    )


def _criterion_array() -> Column:
    return F.sort_array(
        F.collect_list(
            F.struct(
                "criterion_ord", "criterion_id", "category_id", "max_points", "anchor",
                "awarded_points", "n_evidence", "label", "rule_id",
            )
        )
    )




def ranked(items: Column, key) -> Column:
    """Array sorted ascending by the struct that ``key`` builds for an element.

    No element is null, and then ``sort_array`` gives what ``array_sort`` gives, without a function call per comparison.
    """
    keyed = F.transform(items, lambda x: F.struct(key(x).alias("k"), x.alias("v")))
    return F.transform(F.sort_array(keyed), lambda x: x.v)


def strengths(criteria: Column) -> Column:
    """Best five criteria with points: by share, points, maximum, then name."""
    scored = F.filter(criteria, lambda c: c.awarded_points > 0)
    order = ranked(
        scored,
        lambda c: F.struct(
            (-(c.awarded_points / c.max_points)).alias("a"), (-c.awarded_points).alias("b"),
            (-c.max_points).alias("c"), c.criterion_id.alias("d"),
        ),
    )
    return F.slice(order, 1, TOP)


def gaps(criteria: Column, capped_criteria: Column, capped_categories: Column) -> Column:
    """Criteria below their maximum: capping ones first, then by points missing."""
    open_ones = F.filter(criteria, lambda c: c.awarded_points < c.max_points)
    return ranked(
        open_ones,
        lambda c: F.struct(
            (~F.array_contains(capped_criteria, c.criterion_id)).alias("a"),
            (~F.array_contains(capped_categories, c.category_id)).alias("b"),
            (c.awarded_points - c.max_points).alias("c"), (-c.max_points).alias("d"),
            c.criterion_id.alias("e"),
        ),
    )


def _caps_of(registry: Registry, scope: str) -> list[tuple]:
    return [row for row in registry.cap_rows() if row[1] == scope]


def category_caps(registry: Registry) -> Column:
    """Category caps that apply, for a row with ``track`` and ``has_project_link``."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("track") == track) & ~F.col("has_project_link"),
                    F.struct(
                        F.lit(rule).alias("rule_id"), F.lit(cap).alias("cap"),
                        F.lit(target).alias("category_id"),
                    ),
                )
                for track, _, rule, target, cap in _caps_of(registry, "category")
            ]
        )
    )


def overall_caps(registry: Registry) -> Column:
    """Overall caps that apply: the related criterion has no evidence at all."""
    parts = []
    for track, _, rule, target, cap in _caps_of(registry, "overall"):
        missing = F.exists(
            "criteria",
            lambda c: (c.criterion_id == target) & (c.anchor == "missing_unverifiable"),
        )
        parts.append(
            F.when(
                (F.col("track") == track) & missing,
                F.struct(
                    F.lit(rule).alias("rule_id"), F.lit(cap).alias("cap"),
                    F.lit(target).alias("criterion_id"),
                ),
            )
        )
    return F.array_compact(F.array(*parts))


def category_scores(registry: Registry) -> Column:
    """Array of category sums before and after the cap, in rubric order."""
    rows = []
    for track, category, order, _, points in registry.category_rows():
        total = F.aggregate(
            F.filter("criteria", lambda c: c.category_id == category),
            F.lit(0), lambda acc, c: acc + c.awarded_points,
        )
        cap = F.array_min(
            F.transform(
                F.filter("category_caps", lambda c: c.category_id == category), lambda c: c.cap
            )
        )
        rows.append(
            F.when(
                F.col("track") == track,
                F.struct(
                    F.lit(order).alias("category_ord"), F.lit(category).alias("category_id"),
                    F.lit(points).alias("max_points"), total.alias("pre_cap_score"),
                    F.least(total, F.coalesce(cap, total)).alias("final_score"),
                ),
            )
        )
    return F.array_compact(F.array(*rows))


def project_choice(registry: Registry) -> Column:
    """The project that covers most missing points; the sentinel text when none does."""
    candidates = []
    api_missing = F.exists(
        "criteria",
        lambda c: (c.criterion_id == "se.core.application_systems") & (c.anchor == "missing_unverifiable"),
    )
    for project, track, _, _, core, exclusions in registry.project_rows():
        coverage = F.aggregate(
            "criteria", F.lit(0),
            lambda acc, c: F.when(c.criterion_id.isin(*core), acc + c.max_points - c.awarded_points).otherwise(acc),
        )
        excluded = F.arrays_overlap(
            "project_exclusion_ids", F.array(*[F.lit(e) for e in exclusions])
        )
        allowed = (coverage > 0) & ~excluded
        if "track_mismatch" in exclusions:
            allowed = allowed & (F.col("track") == track)
        if "python_not_explicit" in exclusions:
            allowed = allowed & F.col("python_explicit")
        if "api_foundation_missing_unverifiable" in exclusions:
            allowed = allowed & ~api_missing
        candidates.append(
            F.when(allowed, F.struct((-coverage).alias("c"), F.lit(project).alias("project_id")))
        )
    best = F.array_min(F.array_compact(F.array(*candidates)))
    return F.coalesce(best.project_id, F.lit(NO_PROJECT))


def score_runs(
    bindings: DataFrame,
    context: DataFrame,
    sources: DataFrame,
    registry: Registry | None = None,
) -> DataFrame:
    """One row per run that no review flag blocks, with all parts of its result."""
    rules = registry or default_registry()
    clear = context.filter(F.size("review_flags") == 0)
    points = criterion_points(bindings, clear, rules)
    per_run = points.groupBy("run_id").agg(_criterion_array().alias("criteria"))
    links = sources.groupBy("run_id").agg(project_link_present(rules).alias("has_project_link"))
    base = (
        clear.join(per_run, "run_id")
        .join(links, "run_id", "left")
        .fillna(False, ["has_project_link"])
    )
    return score_rows(base, rules)


def score_rows(base: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Result columns of rows that hold ``criteria``, ``track`` and the run context."""
    rules = registry or default_registry()
    capped = base.withColumn("category_caps", category_caps(rules)).withColumn(
        "overall_caps", overall_caps(rules)
    )
    summed = capped.withColumn("categories", category_scores(rules))
    totals = summed.withColumn(
        "raw_total",
        F.aggregate("categories", F.lit(0), lambda acc, c: acc + c.final_score),
    ).withColumn(
        "applicable_overall_cap",
        F.coalesce(F.array_min(F.transform("overall_caps", lambda c: c.cap)), F.lit(100)),
    )
    scored = totals.withColumn("final_score", F.least("raw_total", "applicable_overall_cap"))
    return (
        scored.withColumn("band", band_for(F.col("final_score"), rules))
        .withColumn("strengths", strengths(F.col("criteria")))
        .withColumn(
            "material_gaps",
            gaps(
                F.col("criteria"),
                F.transform("overall_caps", lambda c: c.criterion_id),
                F.transform("category_caps", lambda c: c.category_id),
            ),
        )
        .withColumn("project_id", project_choice(rules))
    )


def priority_actions(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The catalogue actions for the first five gaps, one row each."""
    rules = registry or default_registry()
    actions = rules.table(scored.sparkSession, "action").withColumnRenamed("current_anchor", "anchor")
    first = scored.select(
        "run_id", F.posexplode(F.slice("material_gaps", 1, TOP)).alias("pos", "gap")
    )
    return (
        first.select(
            "run_id", (F.col("pos") + 1).alias("priority_order"),
            F.col("gap.criterion_id").alias("criterion_id"), F.col("gap.anchor").alias("anchor"),
        )
        .join(F.broadcast(actions), ["criterion_id", "anchor"])
        .withColumnRenamed("anchor", "current_anchor")
    )


def review_outcome(context: DataFrame) -> DataFrame:
    """Runs that a flag blocks: no score, only the flags."""
    return context.filter(F.size("review_flags") > 0).select(
        "run_id", "track", F.lit("REVIEW_REQUIRED").alias("state"),
        F.lit("REVIEW_REQUIRED").alias("error_code"),
        F.element_at("review_flags", 1).alias("review_flag"), "review_flags",
    )
