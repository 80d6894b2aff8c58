"""Registered queries of the assessment: facts, bindings, scores, checks and reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from attesta.operators import binding, classify, evidence, qa, report, scoring
from attesta.registry import load
from attesta.registry.tables import DA, SE
from attesta.session import shared_folder
from entries import base, chain
from entries.base import q, register, sql_in
from entries.chain import RULES, sql, staged

FACT = "run_id, source_id, locator, fact_type, subject, explicit_text, evidence_level, attribution_status, rule_id"
FACT_COLS = FACT.split(", ")


def technical(spark, folder):
    return staged(spark, folder).technical


def derived(spark, folder):
    return staged(spark, folder).facts.filter(F.col("rule_id").startswith("classify."))


# hits and technical facts -------------------------------------------------------------------------


@register("c1_alias_match", sql("sentences", "SELECT run_id, source_ord, block_ord, sent_ord, k AS hit_no, subject FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM scanned) JOIN alias ON alias_key = lower(hits[k])", chain.ALIAS))
def c1(spark, folder):
    alias = RULES.table(spark, "alias").select(F.lower("alias").alias("key"), "subject")
    hits = staged(spark, folder).sentences.select(
        "run_id", "source_ord", "block_ord", "sent_ord", F.posexplode("hits").alias("p", "hit")
    )
    return hits.join(F.broadcast(alias), F.lower("hit") == F.col("key")).select(
        "run_id", "source_ord", "block_ord", "sent_ord", (F.col("p") + 1).alias("hit_no"), "subject"
    )


@register("f5_longest_first_hits", sql("sentences", "SELECT run_id, source_ord, block_ord, sent_ord, array_to_string(hits, '|') AS hits FROM scanned WHERE len(hits) > 0"))
def f5(spark, folder):
    return staged(spark, folder).sentences.filter(F.size("hits") > 0).select(
        "run_id", "source_ord", "block_ord", "sent_ord", F.array_join("hits", "|").alias("hits")
    )


@register("h6_application_cue", sql("sentences", "SELECT run_id, source_ord, block_ord, sent_ord, applied FROM scanned WHERE len(hits) > 0"))
def h6(spark, folder):
    return staged(spark, folder).sentences.filter(F.size("hits") > 0).select(
        "run_id", "source_ord", "block_ord", "sent_ord", "applied"
    )


@register("i1_technical_facts", sql("raw", f"SELECT {FACT} FROM raw_facts WHERE fact_type <> 'qualification'"))
def i1(spark, folder):
    raw = evidence.raw_technical_facts(staged(spark, folder).sentences)
    return raw.filter(F.col("fact_type") != "qualification").select(*FACT_COLS)


@register("i2_qualification_facts", sql("raw", f"SELECT {FACT} FROM raw_facts WHERE fact_type = 'qualification'"))
def i2(spark, folder):
    raw = evidence.raw_technical_facts(staged(spark, folder).sentences)
    return raw.filter(F.col("fact_type") == "qualification").select(*FACT_COLS)


@register("h30_technical_level", sql("raw", "SELECT fact_type, evidence_level, attribution_status, count(*) AS n FROM raw_facts GROUP BY ALL"))
@register("h32_fact_type", sql("raw", "SELECT fact_type, evidence_level, attribution_status, count(*) AS n FROM raw_facts GROUP BY ALL"))
def h30(spark, folder):
    raw = evidence.raw_technical_facts(staged(spark, folder).sentences)
    return raw.groupBy("fact_type", "evidence_level", "attribution_status").agg(F.count(F.lit(1)).alias("n"))


@register("d1_fact_dedup", sql("technical", f"SELECT {FACT}, copies FROM merged_facts"))
def d1(spark, folder):
    merged = evidence.dedup_facts(evidence.raw_technical_facts(staged(spark, folder).sentences))
    return merged.select(*FACT_COLS, F.col("raw_facts").alias("copies"))


@register("e1_evidence_numbering", sql("technical", "SELECT run_id, printf('ev-%04d', fact_no) AS evidence_id, subject, fact_type FROM technical"))
def e1(spark, folder):
    merged = evidence.dedup_facts(evidence.raw_technical_facts(staged(spark, folder).sentences))
    return evidence.number_facts(merged).select("run_id", "evidence_id", "subject", "fact_type")


@register("d17_fact_limit", sql("raw", "SELECT r.run_id, coalesce(n, 0) AS raw_facts, CASE WHEN n > 5000 THEN 'FACT_LIMIT_EXCEEDED' END AS error_code FROM runs r LEFT JOIN (SELECT run_id, count(*) AS n FROM raw_facts GROUP BY 1) USING (run_id)"))
def d17(spark, folder):
    counts = evidence.raw_technical_facts(staged(spark, folder).sentences).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    n = F.coalesce("n", F.lit(0))
    return base.runs(spark, folder).join(counts, "run_id", "left").select(
        "run_id", n.alias("raw_facts"),
        F.when(n > evidence.FACT_LIMIT, "FACT_LIMIT_EXCEEDED").alias("error_code"),
    )


@register("l2_evidence_normalisation", sql("technical", f"SELECT {FACT}, printf('ev-%04d', fact_no) AS evidence_id FROM technical"))
def l2(spark, folder):
    return evidence.normalize_evidence(
        base.blocks(spark, folder), None, staged(spark, folder).sentences
    ).select(*FACT_COLS, "evidence_id")


# derived facts ------------------------------------------------------------------------------------


def _cue_facts(name, subjects):
    text = sql("cue_facts", f"SELECT {FACT} FROM cue_facts WHERE subject IN {sql_in(subjects)}")

    @register(name, text)
    def run(spark, folder):
        facts = classify.sentence_facts(staged(spark, folder).sentences)
        return facts.filter(F.col("subject").isin(*subjects)).select(*FACT_COLS)


def _process_facts(name, subject):
    text = sql("process", f"SELECT {FACT} FROM process_facts WHERE subject = {q(subject)}")

    @register(name, text)
    def run(spark, folder):
        facts = classify.process_facts(staged(spark, folder).sentences, technical(spark, folder))
        return facts.filter(F.col("subject") == subject).select(*FACT_COLS)


_cue_facts("i4_cv_project_reference", ["cv_project_reference"])
_cue_facts("i5_project_context", ["software_project_context", "analytics_project_context"])
_process_facts("i6_technical_process", "se_technical_process")
_process_facts("i7_technical_depth", "se_technical_depth_ownership")
_process_facts("i8_analysis_process", "da_analysis_process")
_process_facts("i9_tool_integration", "da_tool_integration")
_cue_facts("i10_project_documentation", ["project_documentation", "project_reproducibility"])
_cue_facts("i11_project_outcome", ["software_project_outcome", "analytics_project_outcome"])
_cue_facts("i12_findings_visual", ["analytics_findings_visual_communication"])
_cue_facts("i13_plain_screenshot", ["context_free_dashboard_screenshot"])
_cue_facts("i14_behaviour", ["collaboration", "communication", "initiative"])
_cue_facts("i15_professional_exposure", ["professional_exposure"])
_cue_facts("i16_self_management_se", ["self_management_problem_solving"])
_cue_facts("i17_behaviour_da", ["problem_solving", "self_management", "attention_to_detail"])
_cue_facts("i18_target_role", list(classify.TARGET.values()))


@register("i3_submitted_work", sql("work", f"SELECT {FACT} FROM work_facts"))
def i3(spark, folder):
    return classify.submitted_work_facts(classify.source_summary(base.blocks(spark, folder))).select(*FACT_COLS)


@register("b4_accessible_links", sql("blocks", "SELECT source_type, accessible, count(*) AS n, bool_and(source_type = 'cv' OR accessible) AS emits FROM blocks GROUP BY 1, 2"))
def b4(spark, folder):
    blocks = base.blocks(spark, folder).withColumn("emits", (F.col("source_type") == "cv") | F.col("accessible"))
    return blocks.groupBy("source_type", "accessible").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and("emits").alias("emits")
    )


@register("b11_label_only", sql("sentences", "SELECT run_id, source_ord, block_ord, sent_ord, sentence FROM scanned WHERE c_forbidden_labels AND NOT (c_collaboration_cues OR c_communication_cues OR c_initiative_cues OR c_self_management_cues OR c_problem_solving_cues OR c_attention_cues)"))
def b11(spark, folder):
    return staged(spark, folder).sentences.filter(classify.label_only()).select(
        "run_id", "source_ord", "block_ord", "sent_ord", "sentence"
    )


@register("b12_employment_text", sql("blocks", f"SELECT run_id, block_ord, source_ord, (regexp_matches(text, '\\b(?:19|20)\\d{{2}}\\b') OR {' OR '.join('contains(chr(32) || lower(text) || chr(32), ' + q(p) + ')' for p in classify.EMPLOYMENT_PHRASES)}) AS employed FROM blocks"))
def b12(spark, folder):
    return base.blocks(spark, folder).select(
        "run_id", "block_ord", "source_ord", classify.employment_text(F.col("text")).alias("employed")
    )


@register("b13_project_bounded", sql("sentences", "SELECT source_type, bounded, count(*) AS n FROM scanned WHERE len(hits) > 0 GROUP BY 1, 2"))
def b13(spark, folder):
    rows = staged(spark, folder).sentences.filter(F.size("hits") > 0)
    return rows.groupBy("source_type", classify.is_bounded(RULES).alias("bounded")).agg(F.count(F.lit(1)).alias("n"))


@register("h3_cue_groups", sql("sentences", " UNION ALL ".join(f"SELECT {q(g)} AS cue_group, count(*) AS n FROM scanned WHERE {c}" for g, c in chain.CUE.items())))
def h3(spark, folder):
    rows = staged(spark, folder).sentences.select(F.explode("cues").alias("cue_group"))
    return rows.filter(F.col("cue_group") != "action").groupBy("cue_group").agg(F.count(F.lit(1)).alias("n"))


@register("h7_from_to", sql("sentences", r"SELECT run_id, source_ord, block_ord, sent_ord FROM sentences WHERE regexp_matches(m, '(?i)\bfrom\s+\S.{0,80}?\s+to\b')"))
def h7(spark, folder):
    from attesta.functions import text as T

    parts = base.blocks(spark, folder).filter((F.col("source_type") == "cv") | F.col("accessible")).select(
        "run_id", "source_ord", "block_ord", F.posexplode(T.split_sentences(F.col("text"))).alias("sent_ord", "s")
    )
    return parts.filter(F.col("s").rlike(T.FROM_TO)).drop("s")


@register("h31_derived_level", sql("cue_facts", "SELECT fact_type, evidence_level, attribution_status, count(*) AS n FROM cue_facts GROUP BY ALL"))
def h31(spark, folder):
    return classify.sentence_facts(staged(spark, folder).sentences).groupBy(
        "fact_type", "evidence_level", "attribution_status"
    ).agg(F.count(F.lit(1)).alias("n"))


@register("c14_sentence_containment", sql("process", "SELECT run_id, source_ord, block_ord, sent_ord, fact_subject FROM matches"))
def c14(spark, folder):
    rows = classify.application_matches(staged(spark, folder).sentences, technical(spark, folder))
    return rows.select("run_id", "source_ord", "block_ord", "sent_ord", F.col("subject").alias("fact_subject"))


@register("d6_distinct_subjects", sql("process", "SELECT run_id, source_ord, block_ord, sent_ord, n_subjects, n_tools FROM process_rows"))
def d6(spark, folder):
    rows = classify.application_matches(staged(spark, folder).sentences, technical(spark, folder))
    tool = F.when(F.col("fact_type") == "tool_application", F.col("subject"))
    return rows.groupBy("run_id", "source_ord", "block_ord", "sent_ord").agg(
        F.size(F.collect_set("subject")).alias("n_subjects"), F.size(F.collect_set(tool)).alias("n_tools")
    )


def _emitted(spark, folder):
    st = staged(spark, folder)
    tech = technical(spark, folder)
    return classify.drop_explained_screenshots(
        classify.sentence_facts(st.sentences)
        .unionByName(classify.process_facts(st.sentences, tech))
        .unionByName(classify.submitted_work_facts(classify.source_summary(base.blocks(spark, folder))))
    )


@register("c15_screenshot_anti", sql("emitted", f"SELECT {FACT} FROM emitted WHERE subject = 'context_free_dashboard_screenshot'"))
def c15(spark, folder):
    facts = classify.drop_explained_screenshots(classify.sentence_facts(staged(spark, folder).sentences))
    return facts.filter(F.col("subject") == "context_free_dashboard_screenshot").select(*FACT_COLS)


@register("d9_readability", sql("quality", "SELECT run_id, headings, n_blocks, longest FROM readability"))
def d9(spark, folder):
    return classify.readability(classify.source_summary(base.cv_blocks(spark, folder))).select("run_id", "headings", "n_blocks", "longest")


def _cv_only(facts):
    return facts.filter(F.col("source_id") == F.concat(F.lit("doc-"), "run_id"))


@register("d7_claim_specificity", sql("quality", "SELECT run_id, applications, places, qualifying, names FROM claims"))
def d7(spark, folder):
    return classify.claim_specificity(_cv_only(technical(spark, folder))).select(
        "run_id", "applications", "places", "qualifying", "names"
    )


@register("d8_description_evidence", sql("quality", "SELECT run_id, n_both AS both_shown, applied_places FROM description"))
def d8(spark, folder):
    columns = ["run_id", "source_id", "locator", "fact_type"]
    facts = technical(spark, folder).select(*columns).unionByName(_emitted(spark, folder).select(*columns))
    return classify.description_evidence(_cv_only(facts)).select(
        "run_id", F.col("both").alias("both_shown"), "applied_places"
    )


@register("i20_document_quality", sql("quality", f"SELECT {FACT} FROM quality_facts"))
def i20(spark, folder):
    return classify.quality_facts(
        classify.source_summary(base.blocks(spark, folder)), technical(spark, folder), _emitted(spark, folder)
    ).select(*FACT_COLS)


@register("d2_derived_dedup", sql("facts", f"SELECT {FACT}, copies FROM merged_new"))
def d2(spark, folder):
    return derived(spark, folder).select(*FACT_COLS, F.col("raw_facts").alias("copies"))


@register("e2_continued_numbering", sql("facts", "SELECT run_id, printf('ev-%04d', fact_no) AS evidence_id, subject, locator FROM numbered_new"))
def e2(spark, folder):
    return derived(spark, folder).select("run_id", "evidence_id", "subject", "locator")


@register("g1_fact_union", sql("facts", "SELECT run_id, evidence_id, fact_type, subject FROM facts"))
def g1(spark, folder):
    return staged(spark, folder).facts.select("run_id", "evidence_id", "fact_type", "subject")


@register("l3_derived_classification", sql("facts", f"SELECT {FACT}, printf('ev-%04d', fact_no) AS evidence_id FROM numbered_new"))
def l3(spark, folder):
    st = staged(spark, folder)
    return classify.derived_facts(
        classify.source_summary(base.blocks(spark, folder)), st.sentences, technical(spark, folder)
    ).select(*FACT_COLS, "evidence_id")


@register("i19_mismatch_clearing", sql("context", "SELECT run_id FROM targets WHERE NOT own"))
def i19(spark, folder):
    return classify.track_mismatch(staged(spark, folder).facts, base.runs(spark, folder))


# bindings -----------------------------------------------------------------------------------------


def _usable(spark, folder):
    return binding.scoreable_facts(staged(spark, folder).facts, base.sources(spark, folder))


def _bound(spark, folder):
    return binding.bound_facts(_usable(spark, folder), base.runs(spark, folder))


@register("b5_scoreable_sources", sql("sources", "SELECT run_id, source_id, (submitted_by_candidate AND (source_type = 'cv' OR access_status = 'accessible')) AS scoreable FROM sources"))
def b5(spark, folder):
    return base.sources(spark, folder).select("run_id", "source_id", binding.scoreable_source().alias("scoreable"))


@register("c2_fact_binding", sql("bound", "SELECT run_id, evidence_id, criterion_id, priority FROM bound"))
def c2(spark, folder):
    return _bound(spark, folder).select("run_id", "evidence_id", "criterion_id", "priority")


@register("c3_fallback_binding", sql("bound", "SELECT DISTINCT run_id, criterion_id, p AS priority FROM chosen"))
def c3(spark, folder):
    return binding.level_counts(_bound(spark, folder)).select("run_id", "criterion_id", "priority")


@register("d3_best_level", sql("bound", "SELECT run_id, criterion_id, any_value(evidence_level) AS anchor, string_agg(evidence_id, ',' ORDER BY fact_no) AS evidence_ids FROM winners GROUP BY 1, 2"))
def d3(spark, folder):
    bound = _bound(spark, folder)
    levels = binding.level_counts(bound)
    lists = binding.evidence_lists(binding.winning_facts(bound, levels))
    return lists.join(levels, ["run_id", "criterion_id"]).select(
        "run_id", "criterion_id", binding.level_name(F.col("best_rank")).alias("anchor"),
        F.array_join("evidence_ids", ",").alias("evidence_ids"),
    )


@register("c4_provenance", sql("facts", "SELECT f.subject, f.fact_type, f.rule_id, count(*) AS n FROM facts f SEMI JOIN provenance p ON p.subject = f.subject AND p.fact_type = f.fact_type AND p.rule_id = f.rule_id GROUP BY ALL", chain.PROVENANCE))
def c4(spark, folder):
    known = RULES.table(spark, "provenance")
    return staged(spark, folder).facts.join(
        F.broadcast(known), ["subject", "fact_type", "rule_id"], "left_semi"
    ).groupBy("subject", "fact_type", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@register("c5_orphan_facts", sql("facts", "SELECT run_id, evidence_id FROM facts f WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.run_id)"))
def c5(spark, folder):
    known = base.read_table(spark, folder, "labels").select(F.col("doc_id").alias("run_id"))
    return staged(spark, folder).facts.join(known, "run_id", "left_anti").select("run_id", "evidence_id")


@register("h38_qualification_route", sql("qualification", "SELECT run_id, evidence_id, subject, route FROM qual_routes"))
def h38(spark, folder):
    rows = binding.qualification_facts(_usable(spark, folder), base.runs(spark, folder))
    return rows.select("run_id", "evidence_id", "subject", "route")


@register("d10_route_choice", sql("qualification", "SELECT run_id, anchor FROM qual_best"))
def d10(spark, folder):
    rows = binding.qualification_facts(_usable(spark, folder), base.runs(spark, folder))
    return binding.best_route(rows).filter(~F.col("ambiguous")).select("run_id", "anchor")


@register("c16_sheets_without_excel", sql("context", "SELECT run_id, sheets AND NOT excel AS sheets_only FROM signals"))
def c16(spark, folder):
    return binding.run_signals(_usable(spark, folder)).select(
        "run_id", (F.col("sheets_shown") & ~F.col("excel_present")).alias("sheets_only")
    )


@register("b6_conflicting_attribution", sql("context", "SELECT run_id, conflict AS conflicting FROM signals"))
def b6(spark, folder):
    return binding.run_signals(_usable(spark, folder)).select("run_id", "conflicting")


@register("i21_rule_triggers", sql("context", "SELECT run_id, triggers AS rule_triggers FROM context"))
def i21(spark, folder):
    return staged(spark, folder).context.select("run_id", F.array_join("rule_triggers", ",").alias("rule_triggers"))


@register("d11_ordered_flags", sql("context", "SELECT run_id, flags FROM context"))
def d11(spark, folder):
    return staged(spark, folder).context.select("run_id", F.array_join("review_flags", ",").alias("flags"))


@register("b7_blocking_route", sql("context", "SELECT run_id, track, 'REVIEW_REQUIRED' AS state, string_split(flags, ',')[1] AS review_flag FROM context WHERE blocked"))
def b7(spark, folder):
    return scoring.review_outcome(staged(spark, folder).context).select("run_id", "track", "state", "review_flag")


@register("i22_project_exclusions", sql("context", f"SELECT run_id, concat_ws(',', CASE WHEN blocked THEN 'blocking_review_unresolved' END, CASE WHEN contains(flags, 'TRACK_MISMATCH') THEN 'track_mismatch' END, CASE WHEN NOT python THEN 'python_not_explicit' END, CASE WHEN track = {q(SE)} AND api_missing THEN 'api_foundation_missing_unverifiable' END) AS exclusions FROM context"))
def i22(spark, folder):
    return staged(spark, folder).context.select("run_id", F.array_join("project_exclusion_ids", ",").alias("exclusions"))


@register("c7_criterion_densify", sql("bindings", "SELECT run_id, criterion_id, anchor, n_evidence FROM bindings"))
@register("l4_context_assembly", sql("bindings", "SELECT run_id, criterion_id, anchor, n_evidence FROM bindings"))
def l4(spark, folder):
    return staged(spark, folder).bindings.select("run_id", "criterion_id", "anchor", "n_evidence")


@register("g8_binding_coverage", sql("bindings", "SELECT b.run_id, string_agg(b.criterion_id, ',' ORDER BY criterion_ord) AS criteria, count(*) = 26 AS complete FROM bindings b JOIN criterion USING (criterion_id) GROUP BY 1"))
def g8(spark, folder):
    order = RULES.table(spark, "criterion").select("criterion_id", "criterion_ord")
    return staged(spark, folder).bindings.join(F.broadcast(order), "criterion_id").groupBy("run_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("criterion_ord", "criterion_id"))), lambda x: x.criterion_id), ",").alias("criteria"),
        (F.count(F.lit(1)) == 26).alias("complete"),
    )


# scores -------------------------------------------------------------------------------------------


def scored(spark, folder):
    return staged(spark, folder).scored


def criteria(spark, folder):
    return report.criterion_breakdown(scored(spark, folder))


@register("c8_anchor_points", sql("points", "SELECT run_id, p.criterion_id, p.anchor, a.points FROM points p JOIN criterion_anchor a ON a.criterion_id = p.criterion_id AND a.anchor = p.anchor"))
def c8(spark, folder):
    st = staged(spark, folder)
    clear = st.context.filter(F.size("review_flags") == 0)
    return scoring.criterion_points(st.bindings, clear).select("run_id", "criterion_id", "anchor", "points")


@register("c9_route_points", sql("points", "SELECT run_id, anchor, awarded_points FROM points WHERE criterion_id LIKE '%.qualification'"))
def c9(spark, folder):
    return criteria(spark, folder).filter(F.col("criterion_id").endswith(".qualification")).select("run_id", "anchor", "awarded_points")


@register("h34_award_points", sql("points", "SELECT run_id, criterion_id, anchor, awarded_points FROM points"))
def h34(spark, folder):
    return criteria(spark, folder).select("run_id", "criterion_id", "anchor", "awarded_points")


@register("h35_evidence_note", sql("points", "SELECT run_id, criterion_id, CASE WHEN n_evidence = 0 AND anchor IN ('missing_unverifiable', 'se.qual.none', 'da.qual.none') THEN 'No accepted evidence was present for ' || label || '.' ELSE label || ' scored from locked ' || anchor || ' evidence.' END AS evidence_note FROM points"))
def h35(spark, folder):
    return criteria(spark, folder).select("run_id", "criterion_id", "evidence_note")


@register("c10_category_cap", sql("scores", "SELECT run_id, rule_id, category_id, cap_points AS cap FROM category_caps"))
def c10(spark, folder):
    rows = report.cap_rows(scored(spark, folder)).filter(F.col("scope") == "category")
    return rows.select("run_id", "rule_id", F.col("target_id").alias("category_id"), "cap")


@register("c11_overall_cap", sql("scores", "SELECT run_id, rule_id, criterion_id, cap_points AS cap FROM overall_caps"))
def c11(spark, folder):
    rows = report.cap_rows(scored(spark, folder)).filter(F.col("scope") == "overall")
    return rows.select("run_id", "rule_id", F.col("target_id").alias("criterion_id"), "cap")


@register("d4_category_sum", sql("scores", "SELECT run_id, category_id, pre_cap_score, final_score FROM category_scores"))
def d4(spark, folder):
    return scored(spark, folder).select("run_id", F.explode("categories").alias("c")).select(
        "run_id", "c.category_id", "c.pre_cap_score", "c.final_score"
    )


@register("d5_totals", sql("scores", "SELECT run_id, raw_total, applicable_overall_cap, final_score FROM totals"))
def d5(spark, folder):
    return scored(spark, folder).select("run_id", "raw_total", "applicable_overall_cap", "final_score")


@register("h29_band", sql("scores", "SELECT run_id, final_score, band FROM scored"))
def h29(spark, folder):
    return scored(spark, folder).select("run_id", "final_score", "band")


@register("f1_strength_order", sql("scores", "SELECT run_id, strength_ord, criterion_id, awarded_points, max_points FROM strength_rows"))
def f1(spark, folder):
    return report.strength_rows(scored(spark, folder)).select("run_id", "strength_ord", "criterion_id", "awarded_points", "max_points")


@register("f2_gap_order", sql("scores", "SELECT run_id, gap_ord, criterion_id, point_gap FROM gap_rows"))
def f2(spark, folder):
    return report.gap_rows(scored(spark, folder)).select("run_id", "gap_ord", "criterion_id", "point_gap")


@register("h36_gap_ratio", sql("scores", "SELECT run_id, criterion_id, point_gap, point_gap / max_points AS gap_ratio FROM gap_rows"))
def h36(spark, folder):
    return report.gap_rows(scored(spark, folder)).select("run_id", "criterion_id", "point_gap", "gap_ratio")


ACTIONS = "SELECT run_id, gap_ord AS priority_order, action_id, a.criterion_id, a.current_anchor, a.target_anchor, a.required_output, a.completion_check, a.candidate_instruction, a.action_type FROM gap_rows g JOIN action a ON a.criterion_id = g.criterion_id AND a.current_anchor = g.anchor WHERE gap_ord <= 5"


@register("c12_action_lookup", sql("scores", ACTIONS, chain.ACTION))
def c12(spark, folder):
    return scoring.priority_actions(scored(spark, folder)).select(
        "run_id", "priority_order", "action_id", "criterion_id", "current_anchor", "target_anchor",
        "required_output", "completion_check", "candidate_instruction", "action_type",
    )


@register("f3_action_top5", sql("scores", "SELECT run_id, gap_ord AS priority_order, criterion_id FROM gap_rows WHERE gap_ord <= 5"))
@register("e3_priority_order", sql("scores", "SELECT run_id, gap_ord AS priority_order, criterion_id FROM gap_rows WHERE gap_ord <= 5"))
def f3(spark, folder):
    return scoring.priority_actions(scored(spark, folder)).select("run_id", "priority_order", "criterion_id")


@register("f4_project_choice", sql("scores", "SELECT run_id, project_id FROM choices"))
def f4(spark, folder):
    return scored(spark, folder).select("run_id", "project_id")


@register("c13_project_coverage", sql("scores", "SELECT g.run_id, j.project_id, g.criterion_id, g.point_gap FROM gap_rows g JOIN project j ON list_contains(j.core_criterion_ids, g.criterion_id)"))
def c13(spark, folder):
    return report.project_coverage(report.gap_rows(scored(spark, folder))).select("run_id", "project_id", "criterion_id", "point_gap")


@register("d12_coverage_argmax", sql("scores", "SELECT run_id, project_id, coverage FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coverage DESC, project_id) AS rn FROM (SELECT g.run_id, j.project_id, sum(g.point_gap)::BIGINT AS coverage FROM gap_rows g JOIN project j ON list_contains(j.core_criterion_ids, g.criterion_id) GROUP BY 1, 2)) WHERE rn = 1"))
def d12(spark, folder):
    return report.widest_coverage(report.project_coverage(report.gap_rows(scored(spark, folder))))


@register("g3_exclusion_overlap", sql("context", "SELECT x.run_id, j.project_id FROM context x JOIN project j ON j.track = x.track WHERE list_has_any(exclusion_conditions, list_filter([CASE WHEN blocked THEN 'blocking_review_unresolved' END, CASE WHEN contains(flags, 'TRACK_MISMATCH') THEN 'track_mismatch' END, CASE WHEN NOT python THEN 'python_not_explicit' END, CASE WHEN x.track = 'software_engineering' AND api_missing THEN 'api_foundation_missing_unverifiable' END], lambda z: z IS NOT NULL))", chain.PROJECT))
def g3(spark, folder):
    projects = RULES.table(spark, "project").select("project_id", "track", "exclusion_conditions")
    return staged(spark, folder).context.join(F.broadcast(projects), "track").filter(
        F.arrays_overlap("exclusion_conditions", "project_exclusion_ids")
    ).select("run_id", "project_id")


@register("l5_scoring", sql("scores", "SELECT s.run_id, raw_total, final_score, band, project_id, (SELECT string_agg(criterion_id, ',' ORDER BY strength_ord) FROM strength_rows x WHERE x.run_id = s.run_id) AS strengths, (SELECT string_agg(criterion_id, ',' ORDER BY gap_ord) FROM gap_rows x WHERE x.run_id = s.run_id) AS gaps FROM scored s JOIN choices USING (run_id)"))
def l5(spark, folder):
    st = staged(spark, folder)
    rows = scoring.score_runs(st.bindings, st.context.drop("cv_hash", "links_ok"), base.sources(spark, folder))
    ids = lambda c: F.nullif(F.array_join(F.transform(c, lambda x: x.criterion_id), ","), F.lit(""))
    return rows.select("run_id", "raw_total", "final_score", "band", "project_id", ids("strengths").alias("strengths"), ids("material_gaps").alias("gaps"))


@register("d23_source_snapshot", sql("sources", "SELECT run_id, max(CASE WHEN source_type = 'cv' THEN content_hash END) AS cv_hash, coalesce(string_agg(CASE WHEN source_type <> 'cv' THEN content_hash END, ',' ORDER BY source_ord), '') AS link_hashes FROM sources GROUP BY 1"))
def d23(spark, folder):
    from attesta.operators.sources import source_snapshot

    return source_snapshot(base.sources(spark, folder)).select(
        "run_id", "cv_hash", F.array_join("link_content_hashes", ",").alias("link_hashes")
    )


# checks and reports -------------------------------------------------------------------------------


BROKEN = {1: "band_matches_final_score", 2: "cv_present_and_readable", 3: "every_submitted_link_has_source_record", 4: "no_secret_in_payload"}


def broken(spark, folder):
    """Scored runs of which most break one check, by their key."""
    n = F.pmod("run_id", F.lit(5))
    rows = scored(spark, folder).drop("checks", "qa_status")
    return qa.run_checks(
        rows.withColumn("band", F.when(n == 1, "no_band").otherwise(F.col("band")))
        .withColumn("cv_hash", F.when(n == 2, "").when(n == 4, "Bearer abc.def").otherwise(F.col("cv_hash")))
        .withColumn("links_ok", F.col("links_ok") & (n != 3))
    )


@register("d13_qa_rollup", sql("scores", "SELECT run_id, CASE WHEN run_id % 5 = 0 THEN 'PASS' ELSE 'FAIL' END AS qa_status FROM scored"))
def d13(spark, folder):
    return broken(spark, folder).select("run_id", "qa_status")


@register("l6_quality_checks", sql("scores", f"SELECT run_id, n AS check_name, NOT ({' OR '.join(f'(run_id % 5 = {k} AND n = {q(v)})' for k, v in BROKEN.items())}) AS passed FROM scored, (VALUES {', '.join('(' + q(n) + ')' for n in qa.CHECKS)}) v(n)"))
def l6(spark, folder):
    return broken(spark, folder).select("run_id", F.explode("checks").alias("c")).select(
        "run_id", F.col("c.name").alias("check_name"), "c.passed"
    )


@register("d14_nonzero_evidence", sql("points", "SELECT run_id, bool_and(awarded_points <= 0 OR n_evidence > 0) AS passed FROM points GROUP BY 1"))
def d14(spark, folder):
    return criteria(spark, folder).groupBy("run_id").agg(
        F.bool_and((F.col("awarded_points") <= 0) | (F.col("n_evidence") > 0)).alias("passed")
    )


@register("d15_category_bounds", sql("scores", "SELECT s.run_id, bool_and(final_score <= max_points AND final_score <= pre_cap_score AND final_score <= coalesce(cap_points, final_score)) AS passed FROM category_scores s LEFT JOIN category_caps k ON k.run_id = s.run_id AND k.category_id = s.category_id GROUP BY 1"))
def d15(spark, folder):
    return scored(spark, folder).select("run_id", qa.check_columns()[qa.CHECKS[6]].alias("passed"))


@register("c6_link_sources", sql("sources", "SELECT l.run_id, l.link_id, count(s.run_id) AS n_sources FROM link_rows l LEFT JOIN sources s ON s.run_id = l.run_id AND s.source_id = 'src-' || l.link_id AND s.locator = l.submitted_url AND s.source_type = l.declared_type GROUP BY 1, 2"))
def c6(spark, folder):
    return qa.link_source_counts(base.link_rows(spark, folder), base.sources(spark, folder))


@register("b16_secret_scan", "SELECT doc_id, regexp_matches(text, ':[^/\\s]+@') OR regexp_matches(text, '\\bBearer\\s+[A-Za-z0-9._\\-]+') OR regexp_matches(text, 'Traceback \\(most recent call last\\)') AS secret FROM documents")
def b16(spark, folder):
    return base.read_table(spark, folder, "documents").select("doc_id", qa.has_secret(F.col("text")).alias("secret"))


@register("h37_whole_percent", sql("scores", "SELECT run_id, category_id, ((final_score * 200 + max_points) // (max_points * 2))::INT AS percentage FROM category_scores"))
def h37(spark, folder):
    return report.category_breakdown(scored(spark, folder)).select("run_id", "category_id", "percentage")


@register("e9_strongest_area", sql("scores", "SELECT run_id, category_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY final_score / max_points DESC, category_ord) AS rn FROM category_scores) WHERE rn = 1"))
def e9(spark, folder):
    return scored(spark, folder).select("run_id", report.strongest_area(F.col("categories")).category_id.alias("category_id"))


@register("c17_label_join", sql("points", "SELECT run_id, criterion_id, p.label AS criterion_label, c.label AS category_label, a.label AS anchor_label FROM points p JOIN label c ON c.label_kind = 'category' AND c.id = p.category_id JOIN label a ON a.label_kind = 'anchor' AND a.id = p.anchor", chain.LABEL))
def c17(spark, folder):
    return criteria(spark, folder).select("run_id", "criterion_id", "criterion_label", "category_label", "anchor_label")


@register("c18_action_check", sql("scores", "SELECT gap_ord AS priority_order, count(*) AS n, count(*) FILTER (run_id % 4 = 1) AS mismatches FROM gap_rows WHERE gap_ord <= 5 GROUP BY 1"))
def c18(spark, folder):
    actions = scoring.priority_actions(scored(spark, folder))
    changed = F.when(F.pmod("run_id", F.lit(4)) == 1, "something else").otherwise(F.col("required_output"))
    actions = actions.withColumn("required_output", changed)
    wrong = report.action_mismatches(actions).withColumn("wrong", F.lit(1))
    return actions.join(wrong, ["run_id", "action_id"], "left").groupBy("priority_order").agg(
        F.count(F.lit(1)).alias("n"), F.count("wrong").alias("mismatches")
    )


@register("c19_project_detail", sql("scores", """SELECT run_id, c.project_id, CASE WHEN j.project_id IS NULL THEN 'REVIEW_REQUIRED' WHEN contains(j.project_id, '02') THEN 'REPORT_RULESET_INVALID' ELSE 'RECOMMENDED' END AS status, title,
  CASE WHEN NOT contains(j.project_id, '02') THEN 'About ' || title END AS scenario, CASE WHEN NOT contains(j.project_id, '02') THEN 'out of ' || j.project_id || ',report' END AS outputs FROM choices c LEFT JOIN project j USING (project_id)"""))
def c19(spark, folder):
    """Details come from a catalogue document that does not know the second projects."""
    known = [(p[0], p[3]) for p in RULES.project_rows() if "02" not in p[0]]
    document = {"projects": [
        {
            "project_id": p, "scenario": f"About {title}", "required_foundations": ["a"], "required_outputs": [f"out of {p}", "report"],
            "completion_checks": ["b"], "optional_criterion_ids": [],
        } for p, title in known
    ]}
    path = f"{shared_folder(spark)}/attesta/{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(document),)], "value string").write.text(path)
    details = load.project_table(load.read_document(spark, path))
    rows = report.project_details(report.project_rows(scored(spark, folder)), details)
    return rows.select("run_id", "project_id", "status", "title", "scenario", F.array_join("required_outputs", ",").alias("outputs"))


@register("g4_result_shape", sql("points", "SELECT run_id, CASE WHEN count(DISTINCT criterion_id) = 26 AND run_id % 9 <> 0 AND run_id % 9 <> 4 THEN 'complete' ELSE 'incomplete' END AS shape FROM points GROUP BY 1"))
def g4(spark, folder):
    n = F.pmod("run_id", F.lit(9))  # every ninth run lacks a criterion, every ninth has one twice
    criteria = F.when(n == 0, F.slice("criteria", 2, 100)).when(n == 4, F.concat("criteria", F.slice("criteria", 1, 1)))
    rows = scored(spark, folder).withColumn("criteria", criteria.otherwise(F.col("criteria")))
    wrong = report.result_shape_errors(rows)
    return rows.select("run_id").join(wrong, "run_id", "left").select(
        "run_id", F.when(F.col("error_code").isNull(), "complete").otherwise("incomplete").alias("shape")
    )


@register("c26_label_completeness", sql("points", "SELECT anchor, count(*) AS n, bool_and(a.label IS NOT NULL) AS labelled FROM points p LEFT JOIN label a ON a.label_kind = 'anchor' AND a.id = p.anchor GROUP BY 1", chain.LABEL))
def c26(spark, folder):
    missing = report.label_gaps(spark).filter(F.col("label_kind") == "anchor").select(F.col("id").alias("anchor"), F.lit(1).alias("gap"))
    return criteria(spark, folder).join(F.broadcast(missing), "anchor", "left").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("gap").isNull()).alias("labelled")
    )


REPORT = f"""SELECT s.run_id, r.track, s.final_score, 100 AS score_max, raw_total, band AS band_id, applicable_overall_cap, b.label AS band_label,
  t.label AS track_label, a.category_id AS strongest_area, ((a.final_score * 200 + a.max_points) // (a.max_points * 2))::INT AS strongest_percentage, g.criterion_id AS priority_gap
FROM scored s JOIN runs r USING (run_id) JOIN label b ON b.label_kind = 'band' AND b.id = band JOIN label t ON t.label_kind = 'track' AND t.id = r.track
JOIN (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY final_score / max_points DESC, category_ord) AS rn FROM category_scores) a ON a.run_id = s.run_id AND a.rn = 1
LEFT JOIN gap_rows g ON g.run_id = s.run_id AND gap_ord = 1"""


@register("l7_report", sql("scores", REPORT, chain.LABEL))
def l7(spark, folder):
    return report.report_summary(scored(spark, folder)).drop("report_version", "contract_version", "rubric_version")


@register("b9_preview", sql("scores", f"SELECT '1.0.0' AS schema_version, '1.0.0' AS report_version, run_id, track, track_label, final_score, score_max, band_id, band_label, strongest_area, priority_gap FROM ({REPORT})", chain.LABEL))
def b9(spark, folder):
    return report.preview(report.report_summary(scored(spark, folder)))


@register("b10_without_identity", sql("scores", "SELECT raw_total, final_score, band, project_id FROM scored JOIN choices USING (run_id)"))
def b10(spark, folder):
    return report.without_identity(scored(spark, folder).select("run_id", "raw_total", "final_score", "band", "project_id"))


OUTCOMES = """SELECT r.run_id, CASE WHEN o.run_id IS NOT NULL THEN 'ASSESSMENT_PIPELINE_FAILED' WHEN blocked THEN 'REVIEW_REQUIRED' ELSE 'COMPLETED' END AS state,
  CASE WHEN o.run_id IS NOT NULL THEN 'EVIDENCE_NORMALIZATION_FAILED' WHEN blocked THEN 'REVIEW_REQUIRED' END AS error_code, s.final_score::DOUBLE AS final_score, s.band
FROM runs r JOIN context x USING (run_id) LEFT JOIN scored s USING (run_id) LEFT JOIN (SELECT run_id FROM raw_facts GROUP BY 1 HAVING count(*) > 5000) o USING (run_id)"""


@register("b8_state_gates", sql("scores", f"SELECT state, error_code, count(*) AS n FROM ({OUTCOMES}) GROUP BY 1, 2"))
def b8(spark, folder):
    return staged(spark, folder).outcomes.groupBy("state", "error_code").agg(F.count(F.lit(1)).alias("n"))


@register("l8_assessment_batch", sql("scores", OUTCOMES))
def l8(spark, folder):
    return staged(spark, folder).outcomes.withColumn(
        "final_score", F.col("final_score").cast("double")
    )
