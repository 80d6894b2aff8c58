"""Report tables: the parts of a result with their labels, and the short preview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.registry import Registry, default_registry
from attesta.registry.rubric_values import CATALOG_VERSION, CONTRACT_VERSION, NO_PROJECT, RUBRIC_VERSION
from attesta.operators.scoring import evidence_note, gap_ratio, priority_actions, rule_ids

REPORT_VERSION = "1.0.0"


def whole_percent(score: Column, points: Column) -> Column:
    """Percentage as a whole number, halves rounded up, computed on decimals."""
    share = score.cast("decimal(12,0)") * F.lit(100).cast("decimal(3,0)") / points.cast("decimal(12,0)")
    return F.round(share, 0).cast("int")


def label_join(df: DataFrame, kind: str, key: str, name: str, registry: Registry | None = None) -> DataFrame:
    """Add the label of an ID; IDs without a label keep null."""
    labels = (registry or default_registry()).table(df.sparkSession, "label")
    small = labels.filter(F.col("label_kind") == kind).select(
        F.col("id").alias(key), F.col("label").alias(name)
    )
    return df.join(F.broadcast(small), key, "left")


def category_breakdown(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    rows = scored.select("run_id", F.explode("categories").alias("c")).select(
        "run_id", "c.category_ord", "c.category_id", F.col("c.final_score").alias("score"),
        "c.max_points", "c.pre_cap_score",
        whole_percent(F.col("c.final_score"), F.col("c.max_points")).alias("percentage"),
    )
    return label_join(rows, "category", "category_id", "category_label", registry)


def strongest_area(categories: Column) -> Column:
    """Category with the highest share of its points, the earlier one on a tie.

    Shares are compared as whole cross products of at most 100 x 100, so no rounding is involved.
    """
    best = F.aggregate(
        categories,
        F.element_at(categories, 1),
        lambda a, c: F.when(
            c.final_score * a.max_points > a.final_score * c.max_points, c
        ).otherwise(a),
    )
    return best


def criterion_breakdown(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    rows = scored.select("run_id", "rule_triggers", F.explode("criteria").alias("c")).select(
        "run_id", "c.criterion_ord", "c.criterion_id", "c.category_id", "c.max_points", "c.anchor",
        "c.awarded_points", "c.n_evidence", F.col("c.label").alias("criterion_label"),
        evidence_note(F.col("c.label"), F.col("c.anchor"), F.col("c.n_evidence")).alias("evidence_note"),
        rule_ids(F.col("c.criterion_id"), F.col("c.rule_id"), F.col("rule_triggers")).alias("rule_ids"),
    )
    labelled = label_join(rows, "category", "category_id", "category_label", registry)
    return label_join(labelled, "anchor", "anchor", "anchor_label", registry)


def _positions(scored: DataFrame, column: str, order: str) -> DataFrame:
    return scored.select("run_id", F.posexplode(column).alias("pos", "c")).select(
        "run_id", (F.col("pos") + 1).alias(order), "c.criterion_id", "c.category_id", "c.anchor",
        "c.awarded_points", "c.max_points", F.col("c.label").alias("criterion_label"),
    )


def gap_rows(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    rows = _positions(scored, "material_gaps", "gap_ord").withColumn(
        "point_gap", F.col("max_points") - F.col("awarded_points")
    ).withColumn("gap_ratio", gap_ratio(F.col("max_points"), F.col("awarded_points")))
    return label_join(rows, "anchor", "anchor", "anchor_label", registry)


def strength_rows(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    return label_join(
        _positions(scored, "strengths", "strength_ord"), "anchor", "anchor", "anchor_label", registry
    )


def action_rows(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    rows = label_join(priority_actions(scored, registry), "criterion", "criterion_id", "criterion_label", registry)
    rows = label_join(rows, "anchor", "current_anchor", "current_anchor_label", registry)
    return label_join(rows, "anchor", "target_anchor", "target_anchor_label", registry)


def action_mismatches(actions: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Actions of results that differ from the catalogue in any of five fields."""
    fields = ("criterion_id", "current_anchor", "target_anchor", "required_output", "completion_check")
    known = (registry or default_registry()).table(actions.sparkSession, "action").select(
        "action_id", *[F.col(f).alias(f"known_{f}") for f in fields]
    )
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"known_{f}"))
    return (
        actions.join(F.broadcast(known), "action_id", "left")
        .filter(~same)
        .select("run_id", "action_id")
    )


def cap_rows(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Category and overall caps that apply, with labels."""
    category = scored.select("run_id", F.explode("category_caps").alias("c")).select(
        "run_id", F.lit("category").alias("scope"), "c.rule_id", F.col("c.category_id").alias("target_id"), "c.cap"
    )
    overall = scored.select("run_id", F.explode("overall_caps").alias("c")).select(
        "run_id", F.lit("overall").alias("scope"), "c.rule_id", F.col("c.criterion_id").alias("target_id"), "c.cap"
    )
    return label_join(category.unionByName(overall), "cap", "rule_id", "cap_label", registry)


def project_coverage(gaps: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Gaps that each project covers, one row per run, project and criterion."""
    rules = registry or default_registry()
    covered = rules.table(gaps.sparkSession, "project").select(
        "project_id", F.explode("core_criterion_ids").alias("criterion_id")
    )
    return gaps.select("run_id", "criterion_id", "point_gap").join(F.broadcast(covered), "criterion_id")


def widest_coverage(coverage: DataFrame) -> DataFrame:
    """Per run the project that covers most missing points, the first one by ID among equals."""
    sums = coverage.groupBy("run_id", "project_id").agg(F.sum("point_gap").alias("coverage"))
    best = F.min_by(F.struct("project_id", "coverage"), F.struct(-F.col("coverage"), "project_id"))
    return sums.groupBy("run_id").agg(best.alias("b")).select("run_id", "b.project_id", "b.coverage")


def project_details(projects: DataFrame, details: DataFrame) -> DataFrame:
    """Recommended projects with what a rule document tells about them.

    ``projects``: see ``project_rows``. ``details``: see ``attesta.registry.load.project_table``, a row per project.
    A recommended project that the document does not know is an invalid rule set.
    """
    known = details.withColumn("known", F.lit(True))
    joined = projects.join(F.broadcast(known), "project_id", "left")
    status = F.when((F.col("status") == "RECOMMENDED") & F.col("known").isNull(), "REPORT_RULESET_INVALID").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("known")


def project_rows(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The recommended project with its catalogue details, or the review status."""
    rules = registry or default_registry()
    known = rules.table(scored.sparkSession, "project").select(
        "project_id", F.col("track").alias("project_track"), "catalog_version", "title"
    )
    joined = scored.select("run_id", "track", "project_id").join(F.broadcast(known), "project_id", "left")
    fits = (F.col("project_track") == F.col("track")) & (F.col("catalog_version") == CATALOG_VERSION)
    status = (
        F.when(F.col("project_id") == NO_PROJECT, "REVIEW_REQUIRED")
        .when(fits, "RECOMMENDED")
        .otherwise("REPORT_RULESET_INVALID")
    )
    return joined.select("run_id", "project_id", status.alias("status"), "title", "catalog_version")


def report_summary(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row per run: the head of the report."""
    rows = scored.withColumn("strongest", strongest_area(F.col("categories"))).select(
        "run_id", "track", "final_score", F.lit(100).alias("score_max"), "raw_total",
        F.col("band").alias("band_id"), "applicable_overall_cap",
        F.col("strongest.category_id").alias("strongest_area"),
        whole_percent(F.col("strongest.final_score"), F.col("strongest.max_points")).alias("strongest_percentage"),
        F.get("material_gaps", F.lit(0))["criterion_id"].alias("priority_gap"),
        F.lit(REPORT_VERSION).alias("report_version"),
        F.lit(CONTRACT_VERSION).alias("contract_version"), F.lit(RUBRIC_VERSION).alias("rubric_version"),
    )
    rows = label_join(rows, "track", "track", "track_label", registry)
    return label_join(rows, "band", "band_id", "band_label", registry)


def preview(report: DataFrame, schema_version: str = "1.0.0") -> DataFrame:
    """The short form of a report: head columns only."""
    return report.select(
        F.lit(schema_version).alias("schema_version"), "report_version", "run_id", "track",
        "track_label", "final_score", "score_max", "band_id", "band_label", "strongest_area",
        "priority_gap",
    )


def result_shape_errors(scored: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Runs whose categories or criteria are not exactly those of their track."""
    rules = registry or default_registry()
    bad = F.lit(False)
    for kind, rows, column in (("criteria", rules.criterion_rows(), "criterion_id"), ("categories", rules.category_rows(), "category_id")):
        for track in sorted({r[0] for r in rows}):
            wanted = F.array(*[F.lit(r[1]) for r in rows if r[0] == track])
            got = F.transform(kind, lambda c: c[column])
            differs = (
                (F.size(F.array_except(wanted, got)) > 0) | (F.size(F.array_except(got, wanted)) > 0)
                | (F.size(got) != F.size(wanted))
            )
            bad = bad | ((F.col("track") == track) & differs)
    return scored.filter(bad).select("run_id", F.lit("REPORT_RULESET_INVALID").alias("error_code"))


def without_identity(result: DataFrame) -> DataFrame:
    """A result without the columns that only tell which run it is."""
    return result.drop("assessment_id", "run_id", "submitted_at", "assessed_at")


def label_gaps(spark, registry: Registry | None = None) -> DataFrame:
    """IDs the rules use that have no label."""
    rules = registry or default_registry()
    wanted = [("anchor", a) for a in ("demonstrated", "documented", "named_only", "missing_unverifiable")]
    wanted += [("anchor", r[0]) for r in rules.routes] + [("cap", c[1]) for c in rules.caps]
    ids = spark.createDataFrame(wanted, "label_kind string, id string")
    labels = rules.table(spark, "label").filter(F.trim("label") != "")
    return ids.join(F.broadcast(labels), ["label_kind", "id"], "left_anti")
