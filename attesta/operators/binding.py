"""Scoring context: which facts count for which criterion, at which level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.evidence import ORDER, level_rank
from attesta.registry import Registry, default_registry
from attesta.registry.tables import DA, SE

LEVEL_NAMES = ("missing_unverifiable", "named_only", "documented", "demonstrated")
CERTIFICATE_SUBJECTS = ("bootcamp", "certificate", "certification", "higher_certificate")
SHEETS_CEILING = "rubric.v2.da.cap.google_sheets_ceiling"
PLAIN_SCREENSHOT = "rubric.v2.da.rule.context_free_dashboard"
QUALIFICATION = {SE: "se.alignment.qualification", DA: "da.alignment.qualification"}
DEPTH_CRITERION = "se.projects.depth_ownership"
FINDINGS_CRITERION = "da.projects.findings"
#: Columns of facts that bindings and context are made from, besides run and order.
USED = (
    "fact_no", "evidence_id", "subject", "fact_type", "explicit_text", "evidence_level", "attribution_status", "rule_id",
)
CONTRADICTION = "MATERIAL_SOURCE_CONTRADICTION"
AMBIGUITY = "MATERIAL_CLASSIFICATION_AMBIGUITY"


def scoreable_source() -> Column:
    """A candidate's own source: the CV, or a link that could be read."""
    return F.col("submitted_by_candidate") & (
        (F.col("source_type") == "cv") | (F.col("access_status") == "accessible")
    )


def scoreable_facts(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts whose source may count."""
    usable = sources.filter(scoreable_source()).select("run_id", "source_id")
    return facts.join(usable, ["run_id", "source_id"], "left_semi")


def fact_errors(facts: DataFrame, sources: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Facts whose subject, rule, combination or source is unknown, with the first error code."""
    rules = registry or default_registry()
    known = rules.table(facts.sparkSession, "provenance")
    checked = (
        facts.join(F.broadcast(known.select("subject").distinct().withColumn("s_ok", F.lit(True))), "subject", "left")
        .join(F.broadcast(known.select("rule_id").distinct().withColumn("r_ok", F.lit(True))), "rule_id", "left")
        .join(
            F.broadcast(known.withColumn("t_ok", F.lit(True))),
            ["subject", "fact_type", "rule_id"],
            "left",
        )
        .join(
            sources.select("run_id", "source_id").distinct().withColumn("src_ok", F.lit(True)),
            ["run_id", "source_id"],
            "left",
        )
    )
    code = (
        F.when(F.col("s_ok").isNull(), "UNKNOWN_SUBJECT")
        .when(F.col("r_ok").isNull(), "UNKNOWN_RULE_ID")
        .when(F.col("t_ok").isNull(), "MISMATCHED_EVIDENCE_FACT")
        .when(F.col("src_ok").isNull(), "UNKNOWN_SOURCE")
    )
    return checked.withColumn("error_code", code).filter(F.col("error_code").isNotNull()).select(
        "run_id", "evidence_id", "error_code"
    )


def bound_facts(
    facts: DataFrame, runs: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Facts joined to the criteria they can serve, primary subjects and fallbacks alike."""
    rules = registry or default_registry()
    spark = facts.sparkSession
    bindings = rules.table(spark, "binding").withColumnRenamed("track", "binding_track")
    known = rules.table(spark, "provenance")
    findings_text = T.has_cue(F.col("explicit_text"), rules.cues["findings_cues"])
    tracked = facts if "track" in facts.columns else facts.join(runs.select("run_id", "track"), "run_id")
    return (
        tracked.join(F.broadcast(bindings), "subject")
        .filter(F.col("track") == F.col("binding_track"))
        .join(F.broadcast(known), ["subject", "fact_type", "rule_id"], "left_semi")
        .filter(
            (F.col("criterion_id") != FINDINGS_CRITERION)
            | (F.col("subject") != "analytics_project_outcome")
            | findings_text
        )
        .filter(
            (F.col("criterion_id") != DEPTH_CRITERION)
            | (F.col("attribution_status") == "attributed")
        )
        .drop("binding_track")
    )


def level_counts(bound: DataFrame) -> DataFrame:
    """Per run and criterion: best level and number of facts at it, fallbacks only when needed.

    Plain counts per level, so partial aggregation keeps a large run small before the shuffle.
    """
    rank = level_rank(F.col("evidence_level"))
    counts = [
        F.count_if((F.col("priority") == p) & (rank == r)).alias(f"n{p}{r}")
        for p in (0, 1)
        for r in (0, 1, 2, 3)
    ]
    grouped = bound.groupBy("run_id", "criterion_id").agg(*counts)
    primary = sum((F.col(f"n0{r}") for r in (1, 2, 3)), F.col("n00"))
    priority = F.when(primary > 0, 0).otherwise(1)
    best = F.lit(0)
    at_best = F.lit(0)
    for r in (1, 2, 3):
        n = F.when(priority == 0, F.col(f"n0{r}")).otherwise(F.col(f"n1{r}"))
        best = F.when(n > 0, r).otherwise(best)
        at_best = F.when(n > 0, n).otherwise(at_best)
    return grouped.select(
        "run_id", "criterion_id", priority.alias("priority"), best.alias("best_rank"),
        at_best.cast("long").alias("n_evidence"),
    )


def level_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in LEVEL_NAMES]), rank + 1)


def winning_facts(bound: DataFrame, levels: DataFrame) -> DataFrame:
    """The facts at the best level of each criterion, one row each."""
    rank = level_rank(F.col("evidence_level"))
    return (
        bound.join(levels, ["run_id", "criterion_id", "priority"])
        .filter((rank == F.col("best_rank")) & (F.col("best_rank") > 0))
        .select("run_id", "criterion_id", *ORDER, "fact_no", "evidence_id")
    )


def qualification_route(registry: Registry, applied: Column) -> Column:
    """Route suffix told by one qualification fact; ``ambiguous`` when its wording conflicts."""
    text = F.col("explicit_text")
    se_fields = T.has_cue(text, registry.cues["se_relevant_fields"])
    da_fields = T.has_cue(text, registry.cues["da_relevant_fields"])
    relevant = F.when(F.col("track") == SE, se_fields).otherwise(da_fields)
    done = T.has_cue(text, registry.cues["completed_cues"])
    doing = T.has_cue(text, registry.cues["in_progress_cues"])
    course = F.col("subject").isin(*CERTIFICATE_SUBJECTS) & applied
    named = (relevant & (done | doing)).cast("int") + course.cast("int")
    return (
        F.when(relevant & done & doing, "ambiguous")
        .when(named > 1, "ambiguous")
        .when(relevant & done, "completed")
        .when(relevant & doing, "in_progress")
        .when(course, "bootcamp")
    )


def qualification_facts(
    facts: DataFrame, runs: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Qualification facts with the route each of them tells (null when none)."""
    rules = registry or default_registry()
    applied = (
        facts.groupBy("run_id")
        .agg(F.bool_or(F.col("fact_type").isin("skill_application", "tool_application")).alias("applied"))
    )
    return (
        facts.filter(F.col("fact_type") == "qualification")
        .join(runs.select("run_id", "track"), "run_id")
        .join(applied, "run_id")
        .withColumn("route", qualification_route(rules, F.col("applied")))
        .select("run_id", "track", *ORDER, "fact_no", "evidence_id", "subject", "explicit_text", "route")
    )


def best_route(routed: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Per run: the best route, its points and evidence; one ambiguous fact voids all."""
    rules = registry or default_registry()
    routes = rules.table(routed.sparkSession, "route")
    scored = routed.filter(F.col("route").isNotNull()).join(
        F.broadcast(routes), ["track", "route"], "left"
    )
    per_route = scored.groupBy("run_id", "track", "route", "route_id", "route_ord", "points").agg(
        F.count(F.lit(1)).alias("n_evidence")
    )
    per_run = per_route.groupBy("run_id", "track").agg(
        F.bool_or(F.col("route") == "ambiguous").alias("ambiguous"),
        F.max_by(
            F.struct("route_id", "n_evidence"),
            F.when(
                F.col("route_id").isNotNull(), F.struct("points", (-F.col("route_ord")).alias("o"))
            ),
        ).alias("best"),
    )
    none = F.when(F.col("track") == SE, "se.qual.none").otherwise("da.qual.none")
    return per_run.select(
        "run_id", "ambiguous",
        F.when(F.col("ambiguous"), none).otherwise(F.col("best.route_id")).alias("anchor"),
        F.when(F.col("ambiguous"), 0).otherwise(F.col("best.n_evidence")).cast("long").alias("n_evidence"),
    )


def run_signals(facts: DataFrame) -> DataFrame:
    """Per run: the yes-no signals that rule triggers, exclusions and flags need."""
    present = F.col("evidence_level") != "missing_unverifiable"
    sheets = (F.col("subject") == "google_sheets") & (F.col("evidence_level") == "demonstrated")
    return facts.groupBy("run_id").agg(
        F.bool_or(sheets).alias("sheets_shown"),
        F.bool_or((F.col("subject") == "excel") & present).alias("excel_present"),
        F.bool_or(F.col("subject") == "context_free_dashboard_screenshot").alias("plain_screenshot"),
        F.bool_or(F.col("subject") == "python").alias("python_any"),
        F.bool_or(
            (F.lower("subject") == "python") & present
            & F.col("fact_type").isin("skill_name", "skill_application")
        ).alias("python_explicit"),
        F.bool_or(F.col("attribution_status") == "conflicting").alias("conflicting"),
    )


def compact_names(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def rule_triggers(track: Column) -> Column:
    da = track == DA
    return compact_names(
        (da & F.col("sheets_shown") & ~F.col("excel_present"), SHEETS_CEILING),
        (da & F.col("plain_screenshot"), PLAIN_SCREENSHOT),
    )


def ordered_flags(flags: Column, registry: Registry) -> Column:
    """Flags without duplicates, in the fixed order."""
    return compact_names(*[(F.array_contains(flags, f), f) for f in registry.flag_order])


def bind(
    facts: DataFrame,
    sources: DataFrame,
    runs: DataFrame,
    mismatched: DataFrame,
    registry: Registry | None = None,
    stage=lambda df: df,
) -> tuple[DataFrame, DataFrame]:
    """Bindings (one row per run and criterion) and run context (one row per run).

    Every criterion of the track appears: runs contribute empty rows, and one aggregation merges
    them with the facts, so filling the gaps needs no join. ``stage`` may write the facts that count and the levels to
    the shared folder; they are read three times and twice.
    """
    rules = registry or default_registry()
    spark = facts.sparkSession
    read = ["run_id", *ORDER, *USED, *(["track"] if "track" in facts.columns else [])]
    usable = stage(scoreable_facts(facts, sources).select(*read))
    criteria = rules.table(spark, "criterion").filter(F.col("scoring") == "evidence_anchors")
    ordinary = runs.select("run_id", "track").join(
        F.broadcast(criteria.select("track", "criterion_id")), "track"
    )
    bound = bound_facts(usable, runs, rules).select("run_id", "criterion_id", "priority", "evidence_level")
    empty = ordinary.select(
        "run_id", "criterion_id", F.lit(0).alias("priority"), F.lit(None).cast("string").alias("evidence_level")
    )
    levels = stage(level_counts(bound.unionByName(empty)))
    routes = best_route(qualification_facts(usable, runs, rules), rules)
    qualification = runs.select("run_id", "track").join(routes, "run_id", "left").select(
        "run_id",
        F.when(F.col("track") == SE, QUALIFICATION[SE]).otherwise(QUALIFICATION[DA]).alias("criterion_id"),
        F.coalesce(
            "anchor", F.when(F.col("track") == SE, "se.qual.none").otherwise("da.qual.none")
        ).alias("anchor"),
        F.coalesce("n_evidence", F.lit(0).cast("long")).alias("n_evidence"),
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"),
    )
    bindings = levels.select(
        "run_id", "criterion_id", level_name(F.col("best_rank")).alias("anchor"), "n_evidence"
    ).unionByName(qualification.drop("ambiguous"))
    return bindings, run_context(
        usable, runs, levels, qualification.select("run_id", "ambiguous"), mismatched, rules
    )


def run_context(
    usable: DataFrame,
    runs: DataFrame,
    levels: DataFrame,
    ambiguous: DataFrame,
    mismatched: DataFrame,
    rules: Registry,
) -> DataFrame:
    """Rule triggers, review flags and project exclusions per run."""
    signals = run_signals(usable)
    booleans = [c for c in signals.columns if c != "run_id"]
    api = levels.filter(F.col("criterion_id") == "se.core.application_systems").select(
        "run_id", (F.col("best_rank") == 0).alias("api_missing")
    )
    joined = (
        runs.select("run_id", "track")
        .join(signals, "run_id", "left")
        .join(ambiguous, "run_id", "left")
        .join(api, "run_id", "left")
        .join(mismatched.withColumn("mismatch", F.lit(True)), "run_id", "left")
        .fillna(False, [*booleans, "ambiguous", "api_missing", "mismatch"])
    )
    flags = F.array_compact(
        F.array(
            F.when(F.col("mismatch"), "TRACK_MISMATCH"),
            F.when(F.col("conflicting"), CONTRADICTION),
            F.when(F.col("ambiguous"), AMBIGUITY),
        )
    )
    recognised = {e for p in rules.project_rows() for e in p[5]}
    conditions = [
        (F.size("review_flags") > 0, "blocking_review_unresolved"),
        (F.col("mismatch"), "track_mismatch"),
        (~F.col("python_any"), "python_not_explicit"),
        ((F.col("track") == SE) & F.col("api_missing"), "api_foundation_missing_unverifiable"),
    ]
    return joined.withColumn("review_flags", ordered_flags(flags, rules)).select(
        "run_id", "track",
        rule_triggers(F.col("track")).alias("rule_triggers"),
        "review_flags",
        compact_names(*[(c, n) for c, n in conditions if n in recognised]).alias(
            "project_exclusion_ids"
        ),
        "python_explicit",
    )


def binding_evidence(
    facts: DataFrame, sources: DataFrame, runs: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """One row per run, criterion and fact that supports it, in evidence order."""
    rules = registry or default_registry()
    usable = scoreable_facts(facts, sources)
    bound = bound_facts(usable, runs, rules)
    ordinary = winning_facts(bound, level_counts(bound))
    routed = qualification_facts(usable, runs, rules)
    chosen = best_route(routed, rules).filter(~F.col("ambiguous")).select("run_id", "anchor")
    by_route = (
        routed.filter(F.col("route").isNotNull())
        .withColumn("anchor", F.concat_ws(".", F.substring(F.when(F.col("track") == SE, "se").otherwise("da"), 1, 2), F.lit("qual"), F.col("route")))
        .join(chosen, ["run_id", "anchor"], "left_semi")
        .select(
            "run_id",
            F.when(F.col("track") == SE, QUALIFICATION[SE]).otherwise(QUALIFICATION[DA]).alias("criterion_id"),
            *ORDER, "fact_no", "evidence_id",
        )
    )
    return ordinary.unionByName(by_route)


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """Evidence IDs per run and criterion as one ordered array, the shape of a stored context."""
    return evidence.groupBy("run_id", "criterion_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("fact_no", "evidence_id"))), lambda e: e.evidence_id
        ).alias("evidence_ids")
    )
