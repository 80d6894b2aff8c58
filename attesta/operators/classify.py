"""Derived facts from sentences: project work, behaviour, target role and document quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators.evidence import (
    APPLICATION_TYPES,
    FACT_COLUMNS,
    NAME_TYPES,
    ORDER,
    attribution,
    dedup_facts,
    evidence_id,
)
from attesta.operators.ordering import number_rows
from attesta.registry import Registry, default_registry
from attesta.registry.tables import DA, SE

BEHAVIOUR_GROUPS = (
    "collaboration_cues", "communication_cues", "initiative_cues", "self_management_cues",
    "problem_solving_cues", "attention_cues",
)
EMPLOYMENT_PHRASES = (" at ", "employed", "experience as", "work history")
# A block longer than this hurts readability; a claim is specific from six words.
LONG_BLOCK = 1200
CLAIM_WORDS = 6
AT_END = 2**31 - 1
TARGET = {SE: "software_engineering_target", DA: "data_analytics_target"}


def has(group: str) -> Column:
    return F.array_contains("cues", group)


def is_project_source(registry: Registry) -> Column:
    return F.col("source_type").isin(*registry.project_source_types)


def is_bounded(registry: Registry) -> Column:
    """The sentence speaks about a project: by its source or by an artifact cue."""
    return is_project_source(registry) | has("artifact_markers")


def derived_level(source_type: Column, ownership: Column, fact_type: Column) -> Column:
    """Level of a derived fact. Only document quality on a CV, or owned links, are demonstrated."""
    return F.when(
        F.when(source_type == "cv", fact_type == "document_quality").otherwise(
            ownership == "attributed"
        ),
        "demonstrated",
    ).otherwise("documented")


def employment_text(col: Column) -> Column:
    """The text looks like work history: a year, or an employment phrase."""
    padded = F.concat(F.lit(" "), F.lower(col), F.lit(" "))
    found = col.rlike(T.YEAR)
    for phrase in EMPLOYMENT_PHRASES:
        found = found | padded.contains(phrase)
    return found


def label_only(text_has=has) -> Column:
    """A buzzword without any action cue."""
    action = text_has(BEHAVIOUR_GROUPS[0])
    for group in BEHAVIOUR_GROUPS[1:]:
        action = action | text_has(group)
    return text_has("forbidden_labels") & ~action


def _emit(position: int, when: Column, subject: Column | str, level: Column | None = None) -> Column:
    name = F.lit(subject) if isinstance(subject, str) else subject
    return F.when(
        when,
        F.struct(
            F.lit(position).alias("emit_ord"),
            name.alias("subject"),
            (level if level is not None else F.lit(None).cast("string")).alias("own_level"),
        ),
    )


def _typed(registry: Registry, raw: DataFrame) -> DataFrame:
    """Add fact type, rule, level and attribution to emitted subjects."""
    types = raw.sparkSession.createDataFrame(
        [(s, t, f"classify.v1.{t}.{s}") for s, t in registry.derived_types().items()],
        "subject string, fact_type string, rule_id string",
    )
    level = F.coalesce(
        "own_level",
        derived_level(F.col("source_type"), F.col("ownership_status"), F.col("fact_type")),
    )
    return raw.join(F.broadcast(types), "subject").select(
        "run_id", *ORDER, "source_id", "locator", "fact_type", "subject", "explicit_text",
        level.alias("evidence_level"),
        attribution(F.col("source_type"), F.col("ownership_status")).alias("attribution_status"),
        "rule_id",
    )


def sentence_emissions(registry: Registry) -> list[Column]:
    """Facts that one sentence yields by its own cues, in their fixed order."""
    se, da = F.col("track") == SE, F.col("track") == DA
    cv = F.col("source_type") == "cv"
    bounded = is_bounded(registry)
    text = F.col("sentence_text")
    by_track = lambda s, d: F.when(se, s).otherwise(d)
    lowered = F.lower("sentence")
    speaks = ~label_only()
    exposed = has("professional_context_markers") & (
        has("collaboration_cues") | has("communication_cues") | has("initiative_cues")
        | has("self_management_cues") | has("problem_solving_cues")
        | F.lower(text).contains("responsible for")
    )
    selected = F.when(se, has("se_target_phrases")).otherwise(has("da_target_phrases"))
    opposite = F.when(se, has("da_target_phrases")).otherwise(has("se_target_phrases"))
    aims = has("target_cues")
    mismatch = aims & opposite & ~selected
    cv_level = F.when(cv, "documented")
    headline = selected & ~aims & cv & ~employment_text(text)
    return [
        _emit(
            0,
            cv & has("artifact_markers") & (has("url_prefixes") | has("repository_markers")),
            "cv_project_reference",
        ),
        _emit(
            1, bounded & has("context_markers"),
            by_track("software_project_context", "analytics_project_context"),
        ),
        _emit(
            6, bounded & has("documentation_cues"),
            by_track("project_documentation", "project_reproducibility"),
        ),
        _emit(
            7, bounded & has("outcome_markers"),
            by_track("software_project_outcome", "analytics_project_outcome"),
        ),
        _emit(
            8,
            da & bounded & has("outcome_markers") & has("findings_cues") & has("visual_cues"),
            "analytics_findings_visual_communication",
        ),
        _emit(
            9,
            da & bounded & lowered.contains("dashboard") & lowered.contains("screenshot"),
            "context_free_dashboard_screenshot",
        ),
        _emit(
            10, speaks & se & (has("self_management_cues") | has("problem_solving_cues")),
            "self_management_problem_solving",
        ),
        _emit(11, speaks & has("collaboration_cues"), "collaboration"),
        _emit(12, speaks & has("communication_cues"), "communication"),
        _emit(13, speaks & has("initiative_cues"), "initiative"),
        _emit(14, speaks & exposed, "professional_exposure"),
        _emit(15, speaks & da & has("problem_solving_cues"), "problem_solving"),
        _emit(16, speaks & da & has("self_management_cues"), "self_management"),
        _emit(17, speaks & da & has("attention_cues"), "attention_to_detail"),
        _emit(18, mismatch, by_track(TARGET[DA], TARGET[SE]), cv_level),
        _emit(18, selected & aims, by_track(TARGET[SE], TARGET[DA]), cv_level),
        _emit(18, headline, by_track(TARGET[SE], TARGET[DA]), F.lit("named_only")),
    ]


def sentence_facts(sentences: DataFrame, registry: Registry | None = None) -> DataFrame:
    """Facts told by the cues of single sentences. Narrow: no shuffle."""
    rules = registry or default_registry()
    emitted = sentences.filter(F.size("cues") > 0).select(
        "run_id", "source_id", "source_ord", "source_type", "ownership_status", "block_ord",
        "locator", "sent_ord", F.col("sentence_text").alias("explicit_text"),
        F.explode(F.array_compact(F.array(*sentence_emissions(rules)))).alias("e"),
    )
    return _typed(rules, emitted.select("*", "e.*").drop("e"))


def application_matches(
    sentences: DataFrame, facts: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Application facts of the same place whose text is, holds or lies in a project sentence.

    The equi part is (run, source, locator); facts per run are limited, so no key can explode.
    """
    rules = registry or default_registry()
    here = sentences.filter(is_bounded(rules)).select(
        "run_id", "track", "source_id", "source_ord", "source_type", "ownership_status",
        "block_ord", "sent_ord", "locator", "sentence", "sentence_text", "cues",
    )
    applied = facts.filter(F.col("fact_type").isin(*APPLICATION_TYPES)).select(
        "run_id", "source_id", "locator", "subject", "fact_type",
        F.col("explicit_text").alias("fact_text"),
    )
    same = (
        (F.col("fact_text") == F.col("sentence_text"))
        | F.col("sentence").contains(F.col("fact_text"))
        | F.col("fact_text").contains(F.col("sentence_text"))
    )
    return here.join(applied, ["run_id", "source_id", "locator"]).filter(same)


def process_facts(
    sentences: DataFrame, facts: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """Facts on technical or analytical process, told by the application facts of a sentence."""
    rules = registry or default_registry()
    is_tool = F.col("fact_type") == "tool_application"
    grouped = (
        application_matches(sentences, facts, rules)
        .groupBy(
            "run_id", "track", "source_id", "source_ord", "source_type", "ownership_status",
            "block_ord", "sent_ord", "locator", "sentence", "sentence_text", "cues",
        )
        .agg(
            F.collect_set("subject").alias("subjects"),
            F.collect_set(F.when(is_tool, F.col("subject"))).alias("tools"),
        )
    )
    se, da = F.col("track") == SE, F.col("track") == DA
    analysis = F.arrays_overlap(
        "subjects", F.array(*[F.lit(s) for s in rules.analysis_subjects])
    )
    joined = has("integration_cues") | F.col("sentence").rlike(T.FROM_TO)
    emissions = [
        _emit(2, se, "se_technical_process"),
        _emit(
            3, se & ((F.size("subjects") >= 2) | has("architecture_cues")),
            "se_technical_depth_ownership",
        ),
        _emit(4, da & analysis, "da_analysis_process"),
        _emit(5, da & (F.size("tools") >= 2) & joined, "da_tool_integration"),
    ]
    emitted = grouped.select(
        "run_id", "source_id", "source_ord", "source_type", "ownership_status", "block_ord",
        "locator", "sent_ord", F.col("sentence_text").alias("explicit_text"),
        F.explode(F.array_compact(F.array(*emissions))).alias("e"),
    )
    return _typed(rules, emitted.select("*", "e.*").drop("e"))


def source_summary(blocks: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One row per source: its headings, number of blocks, longest block and first block.

    The only reading of block texts besides the sentence scan; everything else about blocks comes from here.
    """
    names = [h.lower() for h in (registry or default_registry()).cues["heading_cues"]]
    # a heading is short, so long texts are not normalised for the comparison
    short = F.length("text") <= 2 * max(map(len, names))
    heading = F.when(short, F.lower(T.normalize_text(F.col("text"))))
    return blocks.groupBy("run_id", "source_id", "source_ord", "source_type", "ownership_status", "accessible").agg(
        F.collect_set(F.when(heading.isin(*names), heading)).alias("heads"),
        F.count(F.lit(1)).alias("n_blocks"),
        F.max(F.length("text")).alias("longest"),
        F.min_by(F.struct("block_ord", "locator", F.col("text").alias("first_text")), "block_ord").alias("first"),
    )


def submitted_work_facts(summary: DataFrame, registry: Registry | None = None) -> DataFrame:
    """One fact per readable project link, quoting its first block. ``summary``: see ``source_summary``."""
    rules = registry or default_registry()
    emitted = summary.filter(
        (F.col("source_type") != "cv") & F.col("accessible") & is_project_source(rules)
    ).select(
        "run_id", "source_id", "source_ord", "source_type", "ownership_status",
        F.lit(-1).alias("block_ord"), F.lit(0).alias("sent_ord"), F.lit(0).alias("emit_ord"),
        F.col("first.locator").alias("locator"), T.quote_text(F.col("first.first_text")).alias("explicit_text"),
        F.lit("accessible_submitted_work").alias("subject"),
        F.lit(None).cast("string").alias("own_level"),
    )
    return _typed(rules, emitted)


def drop_explained_screenshots(facts: DataFrame) -> DataFrame:
    """Remove a context-free screenshot when its source also shows project context.

    Only screenshot rows take part in the anti join, the others pass through.
    """
    shot = F.col("subject") == "context_free_dashboard_screenshot"
    context = facts.filter(F.col("subject") == "analytics_project_context").select(
        "run_id", "source_id"
    )
    kept = facts.filter(shot).join(context.distinct(), ["run_id", "source_id"], "left_anti")
    return facts.filter(~shot).unionByName(kept)


def readability(summary: DataFrame) -> DataFrame:
    """Readability level per run from headings, block count and block length of the CV.

    ``summary``: see ``source_summary``.
    """
    counted = (
        summary.filter(F.col("source_type") == "cv")
        .groupBy("run_id")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("heads")))).alias("headings"),
            F.sum("n_blocks").alias("n_blocks"),
            F.max("longest").alias("longest"),
            F.min_by(F.struct("first.locator", "first.first_text", "source_id"), "first.block_ord").alias("b"),
        )
    )
    level = (
        F.when(
            (F.col("headings") >= 3) & (F.col("n_blocks") >= 6) & (F.col("longest") <= LONG_BLOCK),
            "demonstrated",
        )
        .when((F.col("headings") >= 2) & (F.col("n_blocks") >= 4), "documented")
        .when(F.col("headings") >= 1, "named_only")
    )
    return counted.select(
        "run_id", "headings", "n_blocks", "longest", level.alias("level"),
        F.col("b.source_id").alias("source_id"), F.col("b.locator").alias("locator"),
        T.normalize_text(F.col("b.first_text")).alias("explicit_text"),
    )


def claim_specificity(cv_facts: DataFrame) -> DataFrame:
    """Specificity level per run. Two steps, so that a large run is merged per locator first."""
    applied = F.col("fact_type").isin(*APPLICATION_TYPES)
    long_text = applied & T.has_words(F.col("explicit_text"), CLAIM_WORDS)
    per_place = cv_facts.groupBy("run_id", "locator").agg(
        F.count_if(applied).alias("applied"),
        F.count_if(long_text).alias("long"),
        F.count_if(F.col("fact_type").isin(*NAME_TYPES)).alias("named"),
    )
    per_run = per_place.groupBy("run_id").agg(
        F.sum("applied").alias("applications"),
        F.count_if(F.col("applied") > 0).alias("places"),
        F.sum("long").alias("qualifying"),
        F.sum("named").alias("names"),
    )
    level = (
        F.when(
            (F.col("applications") >= 3) & (F.col("places") >= 2) & (F.col("qualifying") >= 2),
            "demonstrated",
        )
        .when(F.col("qualifying") >= 1, "documented")
        .when(F.col("names") + F.col("applications") >= 1, "named_only")
    )
    return per_run.withColumn("level", level)


def description_evidence(cv_facts: DataFrame) -> DataFrame:
    """Description level per run: places that show applied work together with its context."""
    applied = F.col("fact_type").isin(*APPLICATION_TYPES, "project_process")
    around = F.col("fact_type").isin("project_context", "project_outcome", "professional_behaviour")
    per_place = cv_facts.groupBy("run_id", "locator").agg(
        F.bool_or(applied).alias("applied"), F.bool_or(around).alias("around")
    )
    per_run = per_place.groupBy("run_id").agg(
        F.count_if(F.col("applied") & F.col("around")).alias("both"),
        F.count_if(F.col("applied")).alias("applied_places"),
    )
    level = (
        F.when(F.col("both") >= 2, "demonstrated")
        .when(F.col("both") >= 1, "documented")
        .when(F.col("applied_places") >= 1, "named_only")
    )
    return per_run.withColumn("level", level)


def quality_facts(
    summary: DataFrame, facts: DataFrame, derived: DataFrame, registry: Registry | None = None
) -> DataFrame:
    """The three document-quality facts of each CV."""
    rules = registry or default_registry()
    base = readability(summary)
    cv = base.select("run_id", F.col("source_id").alias("cv_id"))
    own = lambda d: d.join(cv, "run_id").filter(F.col("source_id") == F.col("cv_id"))
    columns = ["run_id", "source_id", "locator", "fact_type", "explicit_text"]
    mine = own(facts.select(*columns))
    all_mine = mine.unionByName(own(derived.select(*columns)))
    levels = (
        base.join(
            claim_specificity(mine).select("run_id", F.col("level").alias("claim")), "run_id", "left"
        ).join(
            description_evidence(all_mine).select("run_id", F.col("level").alias("description")),
            "run_id",
            "left",
        )
    )
    parts = F.array(
        _emit(0, F.col("level").isNotNull(), "structured_readability", F.col("level")),
        _emit(1, F.col("claim").isNotNull(), "claim_specificity", F.col("claim")),
        _emit(2, F.col("description").isNotNull(), "description_evidence", F.col("description")),
    )
    emitted = levels.select(
        "run_id", "source_id", F.lit(AT_END).alias("source_ord"), F.lit("cv").alias("source_type"),
        F.lit("attributed").alias("ownership_status"), F.lit(0).alias("block_ord"),
        F.lit(0).alias("sent_ord"), "locator", "explicit_text",
        F.explode(F.array_compact(parts)).alias("e"),
    )
    return _typed(rules, emitted.select("*", "e.*").drop("e"))


def derived_facts(
    summary: DataFrame,
    sentences: DataFrame,
    facts: DataFrame,
    registry: Registry | None = None,
    stage=lambda df: df,
) -> DataFrame:
    """All derived facts of every run, merged and numbered after the technical ones.

    ``summary``: see ``source_summary``. ``stage`` may write an intermediate result to the shared folder; it is read three times.
    """
    rules = registry or default_registry()
    emitted = drop_explained_screenshots(
        stage(
            sentence_facts(sentences, rules)
            .unionByName(process_facts(sentences, facts, rules))
            .unionByName(submitted_work_facts(summary, rules))
        )
    )
    quality = quality_facts(summary, facts, emitted, rules)
    merged = stage(dedup_facts(emitted.unionByName(quality), by_locator=True))
    numbered = number_rows(
        merged, ["run_id"], ORDER, [F.col("source_ord"), F.floor(F.col("block_ord") / 64)], "new_no"
    )
    highest = facts.groupBy("run_id").agg(F.max("fact_no").alias("highest"))
    return (
        numbered.join(highest, "run_id", "left")
        .withColumn("fact_no", F.col("new_no") + F.coalesce("highest", F.lit(0)))
        .withColumn("evidence_id", evidence_id(F.col("fact_no")))
        .select("run_id", *ORDER, *FACT_COLUMNS, "raw_facts", "fact_no", "evidence_id")
    )


def track_mismatch(derived: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs that aim at the other track and nowhere at their own."""
    targets = derived.filter(F.col("fact_type") == "role_alignment").select("run_id", "subject")
    own = F.when(F.col("track") == SE, TARGET[SE]).otherwise(TARGET[DA])
    return (
        targets.join(runs.select("run_id", "track"), "run_id")
        .groupBy("run_id")
        .agg(F.bool_or(F.col("subject") == own).alias("own"))
        .filter(~F.col("own"))
        .select("run_id")
    )
