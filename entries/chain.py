"""The assessment in SQL, stage by stage, written apart from the Spark plans.

Each stage is a list of CTE texts; ``upto("facts")`` gives everything a query on facts needs.
Sentences hold no underscore, so the SQL word boundary equals the letter-and-digit boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.operators import binding, classify, evidence, qa, scoring
from attesta.operators.ordering import cut
from attesta.plans.assessment import Assessment, assess
from attesta.registry import default_registry
from attesta.registry.rubric_values import NO_PROJECT
from attesta.registry.tables import DA, SE
from entries import base
from entries.base import q, sql_in, sql_values

RULES = default_registry()


# Spark side: one staged assessment per data folder ------------------------------------------------

_STAGED: dict[tuple, Assessment] = {}


def staged(spark: SparkSession, folder: str) -> Assessment:
    """The assessment tables of a data folder, built once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _STAGED:
        _STAGED[key] = assess(
            base.runs(spark, folder), base.sources(spark, folder), base.blocks(spark, folder)
        )
    return _STAGED[key]


# SQL side -----------------------------------------------------------------------------------------


def re2_quote(text: str) -> str:
    import re

    return re.sub(r"([^A-Za-z0-9\s])", r"\\\1", text)


def edge(char: str) -> str:
    return r"\b" if char.isalnum() else r"\B"


def re2_tokens(phrases, closed: bool = True) -> str:
    ordered = sorted(dict.fromkeys(phrases), key=lambda p: (-len(p), p))
    parts = [
        edge(p[0]) + re2_quote(p) + (edge(p[-1]) if closed else "") for p in ordered
    ]
    return "(?:" + "|".join(parts) + ")"


def sql_cue(col: str, phrases, closed: bool = True) -> str:
    return f"regexp_matches({col}, {q('(?i)' + re2_tokens(phrases, closed))})"


def alias_regex() -> str:
    rows = sorted(RULES.alias_rows(), key=lambda r: (-len(r[3]), r[3]))
    parts = []
    for _, _, _, alias, exact in rows:
        body = edge(alias[0]) + re2_quote(alias) + edge(alias[-1])
        parts.append(body if exact else f"(?i:{body})")
    return "(?:" + "|".join(parts) + ")"


CUE = {g: f"c_{g}" for g in evidence.SCANNED_GROUPS}
PROJECT_TYPES = sql_in(RULES.project_source_types)


def _scan_columns() -> str:
    cols = [
        f"{sql_cue('m', RULES.cues[g], closed=g != 'url_prefixes')} AS {c}" for g, c in CUE.items()
    ]
    cols.append(f"{sql_cue('m', RULES.action_cues)} AS applied")
    return ",\n    ".join(cols)


ALIAS = sql_values(
    "alias", "subject, kind, rule_id, alias_key",
    [(s, k, r, a.lower()) for s, k, r, a, _ in RULES.alias_rows()],
)
QUALIFYING = base.sql_list([r[3].lower() for r in RULES.alias_rows() if r[1] == "qualification"])

SENTENCES = f"""split AS (
  SELECT *, CASE WHEN length(text) <= 240 THEN text END AS block_quote,
    {base.sql_sentences('text')} AS s
  FROM blocks WHERE source_type = 'cv' OR accessible),
sentences AS (
  SELECT run_id, track, source_id, source_ord, source_type, ownership_status, block_ord, locator,
    block_quote, i - 1 AS sent_ord, s[i] AS sentence, replace(s[i], '_', '-') AS m
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM split)),
scanned AS MATERIALIZED (
  SELECT *, list_has_any(list_transform(hits, lambda h: lower(h)), {QUALIFYING}) AS qualified,
    bounded_by_type OR c_artifact_markers AS bounded
  FROM (SELECT *, regexp_extract_all(m, {q(alias_regex())}) AS hits,
    source_type IN {PROJECT_TYPES} AS bounded_by_type,
    {_scan_columns()}
  FROM sentences))"""

PLACE = "(source_ord::BIGINT * 1000000000000000 + (block_ord + 1)::BIGINT * 10000000000 + sent_ord::BIGINT * 1000 + emit_ord)"
RANK = """CASE evidence_level WHEN 'demonstrated' THEN 3 WHEN 'documented' THEN 2
    WHEN 'named_only' THEN 1 ELSE 0 END"""
ATTR_RANK = """CASE attribution_status WHEN 'attributed' THEN 3 WHEN 'unclear' THEN 2 ELSE 1 END"""

RAW = f"""{ALIAS},
raw_facts AS (
  SELECT run_id, {PLACE} AS place, source_id, locator, fact_type, subject, explicit_text,
    evidence_level, attribution_status, rule_id
  FROM (SELECT t.*, k - 1 AS emit_ord, a.subject, a.rule_id,
    CASE WHEN kind = 'qualification' THEN kind ELSE kind || CASE WHEN applied THEN '_application' ELSE '_name' END END AS fact_type,
    CASE WHEN kind = 'qualification' OR applied THEN sentence ELSE coalesce(block_quote, hits[k]) END AS explicit_text,
    CASE WHEN kind = 'qualification' THEN 'documented' WHEN NOT applied THEN 'named_only'
      WHEN source_type <> 'cv' AND ownership_status = 'attributed' THEN 'demonstrated'
      ELSE 'documented' END AS evidence_level,
    CASE WHEN source_type = 'cv' THEN 'attributed' ELSE ownership_status END AS attribution_status
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM scanned WHERE len(hits) > 0) t
    JOIN alias a ON a.alias_key = lower(hits[k])
    WHERE NOT qualified OR (kind = 'qualification' AND source_type = 'cv')))"""


def _dedup(source: str, target: str, keys: str) -> str:
    return f"""{target} AS (
  SELECT run_id, first_place AS place, source_id, locator, fact_type, subject, explicit_text,
    evidence_level, attribution_status, rule_id, copies FROM (
  SELECT *, min(place) OVER (PARTITION BY {keys}) AS first_place,
    count(*) OVER (PARTITION BY {keys}) AS copies,
    row_number() OVER (PARTITION BY {keys} ORDER BY {RANK} DESC, {ATTR_RANK} DESC, place) AS rn
  FROM {source}) WHERE rn = 1)"""


FACTS = (
    _dedup("raw_facts", "merged_facts", "run_id, subject, fact_type, lower(explicit_text)")
    + """,
technical AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY place) AS fact_no FROM merged_facts
  WHERE run_id NOT IN (SELECT run_id FROM raw_facts GROUP BY 1 HAVING count(*) > 5000))"""
)

DERIVED_TYPES = sql_values(
    "derived_type", "subject, fact_type, rule_id",
    [(s, t, f"classify.v1.{t}.{s}") for s, t in RULES.derived_types().items()],
)


def _item(order: int, condition: str, subject: str, level: str = "NULL") -> str:
    return (
        f"CASE WHEN {condition} THEN {{'e': {order}, 's': {subject}, 'l': {level}::VARCHAR}} END"
    )


def _emissions() -> str:
    se, da = f"track = {q(SE)}", f"track = {q(DA)}"
    pick = lambda a, b: f"CASE WHEN {se} THEN {q(a)} ELSE {q(b)} END"
    speaks = (
        "NOT (c_forbidden_labels AND NOT (c_collaboration_cues OR c_communication_cues OR "
        "c_initiative_cues OR c_self_management_cues OR c_problem_solving_cues OR c_attention_cues))"
    )
    selected = f"CASE WHEN {se} THEN c_se_target_phrases ELSE c_da_target_phrases END"
    opposite = f"CASE WHEN {se} THEN c_da_target_phrases ELSE c_se_target_phrases END"
    own = pick("software_engineering_target", "data_analytics_target")
    other = pick("data_analytics_target", "software_engineering_target")
    cv_level = "CASE WHEN source_type = 'cv' THEN 'documented' END"
    low = "lower(sentence)"
    work = (
        "regexp_matches(sentence, '\\b(?:19|20)\\d{2}\\b') OR "
        + " OR ".join(f"contains(' ' || {low} || ' ', {q(p)})" for p in classify.EMPLOYMENT_PHRASES)
    )
    return ",\n    ".join(
        [
            _item(0, "source_type = 'cv' AND c_artifact_markers AND (c_url_prefixes OR c_repository_markers)", q("cv_project_reference")),
            _item(1, "bounded AND c_context_markers", pick("software_project_context", "analytics_project_context")),
            _item(6, "bounded AND c_documentation_cues", pick("project_documentation", "project_reproducibility")),
            _item(7, "bounded AND c_outcome_markers", pick("software_project_outcome", "analytics_project_outcome")),
            _item(8, f"{da} AND bounded AND c_outcome_markers AND c_findings_cues AND c_visual_cues", q("analytics_findings_visual_communication")),
            _item(9, f"{da} AND bounded AND contains({low}, 'dashboard') AND contains({low}, 'screenshot')", q("context_free_dashboard_screenshot")),
            _item(10, f"{speaks} AND {se} AND (c_self_management_cues OR c_problem_solving_cues)", q("self_management_problem_solving")),
            _item(11, f"{speaks} AND c_collaboration_cues", q("collaboration")),
            _item(12, f"{speaks} AND c_communication_cues", q("communication")),
            _item(13, f"{speaks} AND c_initiative_cues", q("initiative")),
            _item(14, f"{speaks} AND c_professional_context_markers AND (c_collaboration_cues OR c_communication_cues OR c_initiative_cues OR c_self_management_cues OR c_problem_solving_cues OR contains({low}, 'responsible for'))", q("professional_exposure")),
            _item(15, f"{speaks} AND {da} AND c_problem_solving_cues", q("problem_solving")),
            _item(16, f"{speaks} AND {da} AND c_self_management_cues", q("self_management")),
            _item(17, f"{speaks} AND {da} AND c_attention_cues", q("attention_to_detail")),
            _item(18, f"c_target_cues AND ({opposite}) AND NOT ({selected})", other, cv_level),
            _item(18, f"c_target_cues AND ({selected})", own, cv_level),
            _item(18, f"NOT c_target_cues AND ({selected}) AND source_type = 'cv' AND NOT ({work})", own, "'named_only'"),
        ]
    )


def _typed(inner: str) -> str:
    """Facts from emitted rows that have ``e`` and the place columns."""
    return f"""SELECT run_id, {PLACE} AS place, source_id, locator, d.fact_type, d.subject, explicit_text,
    coalesce(x.own_level, CASE WHEN (source_type = 'cv' AND d.fact_type = 'document_quality')
      OR (source_type <> 'cv' AND ownership_status = 'attributed') THEN 'demonstrated'
      ELSE 'documented' END) AS evidence_level,
    CASE WHEN source_type = 'cv' THEN 'attributed' ELSE ownership_status END AS attribution_status,
    d.rule_id
  FROM ({inner}) x JOIN derived_type d ON d.subject = x.emitted"""


_COLS = "run_id, source_id, source_ord, source_type, ownership_status, block_ord, locator, sent_ord"

CUE_FACTS = f"""{DERIVED_TYPES},
cue_facts AS (
  {_typed(f'''SELECT {_COLS}, sentence AS explicit_text, x.e AS emit_ord, x.s AS emitted, x.l AS own_level
    FROM (SELECT *, unnest(list_filter([{_emissions()}], lambda z: z IS NOT NULL)) AS x FROM scanned)''')})"""

PROCESS = f"""matches AS MATERIALIZED (
  SELECT t.*, f.subject AS fact_subject, f.fact_type AS fact_kind
  FROM scanned t JOIN technical f USING (run_id, source_id, locator)
  WHERE bounded AND f.fact_type IN ('skill_application', 'tool_application')
    AND (contains(sentence, f.explicit_text) OR contains(f.explicit_text, sentence))),
process_rows AS (
  SELECT {_COLS}, track, sentence, any_value(m) AS m,
    count(DISTINCT fact_subject) AS n_subjects,
    count(DISTINCT CASE WHEN fact_kind = 'tool_application' THEN fact_subject END) AS n_tools,
    bool_or(fact_subject IN {sql_in(RULES.analysis_subjects)}) AS analysis,
    bool_or(c_architecture_cues) AS architecture, bool_or(c_integration_cues) AS integration
  FROM matches GROUP BY ALL),
process_facts AS (
  {_typed(f'''SELECT {_COLS}, sentence AS explicit_text, x.e AS emit_ord, x.s AS emitted, x.l AS own_level
    FROM (SELECT *, unnest(list_filter([
      {_item(2, f"track = {q(SE)}", q("se_technical_process"))},
      {_item(3, f"track = {q(SE)} AND (n_subjects >= 2 OR architecture)", q("se_technical_depth_ownership"))},
      {_item(4, f"track = {q(DA)} AND analysis", q("da_analysis_process"))},
      {_item(5, f"track = {q(DA)} AND n_tools >= 2 AND (integration OR regexp_matches(m, '(?i){chr(92)}bfrom{chr(92)}s+{chr(92)}S.{{0,80}}?{chr(92)}s+to{chr(92)}b'))", q("da_tool_integration"))}
    ], lambda z: z IS NOT NULL)) AS x FROM process_rows)''')})"""

WORK = f"""work_facts AS (
  {_typed(f'''SELECT run_id, source_id, source_ord, source_type, ownership_status, -1 AS block_ord, 0 AS sent_ord, 0 AS emit_ord,
      locator, trim(substr(text, 1, 240)) AS explicit_text, 'accessible_submitted_work' AS emitted, NULL::VARCHAR AS own_level
    FROM (SELECT *, row_number() OVER (PARTITION BY run_id, source_id ORDER BY block_ord) AS rn FROM blocks
      WHERE source_type IN {PROJECT_TYPES} AND accessible) WHERE rn = 1''')})"""

EMITTED = """all_emitted AS (SELECT * FROM cue_facts UNION ALL SELECT * FROM process_facts UNION ALL SELECT * FROM work_facts),
emitted AS MATERIALIZED (
  SELECT * FROM all_emitted a WHERE NOT (subject = 'context_free_dashboard_screenshot' AND EXISTS (
    SELECT 1 FROM all_emitted b WHERE b.run_id = a.run_id AND b.source_id = a.source_id
      AND b.subject = 'analytics_project_context')))"""

QUALITY = f"""readability AS (
  SELECT run_id, count(DISTINCT CASE WHEN heading THEN lower(text) END) AS headings,
    count(*) AS n_blocks, max(length(text)) AS longest,
    arg_min(locator, block_ord) AS locator, arg_min(text, block_ord) AS first_text
  FROM (SELECT *, lower(text) IN {sql_in(h.lower() for h in RULES.cues['heading_cues'])} AS heading
    FROM blocks WHERE source_type = 'cv') GROUP BY 1),
cv_facts AS (SELECT * FROM technical WHERE source_id = 'doc-' || run_id),
claims AS (
  SELECT run_id, count(*) FILTER (app) AS applications,
    count(DISTINCT CASE WHEN app THEN locator END) AS places,
    count(*) FILTER (app AND len(string_split(explicit_text, ' ')) >= 6) AS qualifying,
    count(*) FILTER (fact_type IN ('skill_name', 'tool_name')) AS names
  FROM (SELECT *, fact_type IN ('skill_application', 'tool_application') AS app FROM cv_facts) GROUP BY 1),
description AS (
  SELECT run_id, count(*) FILTER (app AND around) AS n_both, count(*) FILTER (app) AS applied_places FROM (
    SELECT run_id, locator,
      bool_or(fact_type IN ('skill_application', 'tool_application', 'project_process')) AS app,
      bool_or(fact_type IN ('project_context', 'project_outcome', 'professional_behaviour')) AS around
    FROM (SELECT run_id, locator, fact_type FROM cv_facts UNION ALL
      SELECT run_id, locator, fact_type FROM emitted WHERE source_id = 'doc-' || run_id) GROUP BY 1, 2) GROUP BY 1),
quality_levels AS (
  SELECT r.run_id, r.locator, r.first_text,
    CASE WHEN headings >= 3 AND n_blocks >= 6 AND longest <= 1200 THEN 'demonstrated'
      WHEN headings >= 2 AND n_blocks >= 4 THEN 'documented' WHEN headings >= 1 THEN 'named_only' END AS readable,
    CASE WHEN applications >= 3 AND places >= 2 AND qualifying >= 2 THEN 'demonstrated'
      WHEN qualifying >= 1 THEN 'documented' WHEN names + applications >= 1 THEN 'named_only' END AS claim,
    CASE WHEN n_both >= 2 THEN 'demonstrated' WHEN n_both >= 1 THEN 'documented'
      WHEN applied_places >= 1 THEN 'named_only' END AS described
  FROM readability r LEFT JOIN claims USING (run_id) LEFT JOIN description USING (run_id)),
quality_facts AS (
  {_typed(f'''SELECT run_id, 'doc-' || run_id AS source_id, 9 AS source_ord, 'cv' AS source_type, 'attributed' AS ownership_status,
      0 AS block_ord, 0 AS sent_ord, locator, first_text AS explicit_text, x.e AS emit_ord, x.s AS emitted, x.l AS own_level
    FROM (SELECT *, unnest(list_filter([
      {_item(0, "readable IS NOT NULL", q("structured_readability"), "readable")},
      {_item(1, "claim IS NOT NULL", q("claim_specificity"), "claim")},
      {_item(2, "described IS NOT NULL", q("description_evidence"), "described")}
    ], lambda z: z IS NOT NULL)) AS x FROM quality_levels)''')})"""

ALL_FACTS = f"""new_facts AS (SELECT * FROM emitted UNION ALL SELECT * FROM quality_facts),
{_dedup("new_facts", "merged_new", "run_id, fact_type, subject, lower(explicit_text), locator")},
numbered_new AS (
  SELECT n.*, row_number() OVER (PARTITION BY n.run_id ORDER BY place) + coalesce(h.highest, 0) AS fact_no
  FROM merged_new n LEFT JOIN (SELECT run_id, max(fact_no) AS highest FROM technical GROUP BY 1) h USING (run_id)),
facts AS MATERIALIZED (
  SELECT *, printf('ev-%04d', fact_no) AS evidence_id
  FROM (SELECT * FROM technical UNION ALL SELECT * FROM numbered_new))"""

BINDING = sql_values("binding", "track, criterion_id, subject, priority", RULES.binding_rows())
ROUTE = sql_values("route", "track, route_id, route, route_ord, points", RULES.route_rows())
CRITERION = sql_values(
    "criterion", "track, criterion_id, category_id, criterion_ord, label, max_points, scoring, rule_id",
    RULES.criterion_rows(),
)
ANCHOR = sql_values("criterion_anchor", "criterion_id, anchor, points", RULES.anchor_rows())
CATEGORY = sql_values("category", "track, category_id, category_ord, label, max_points", RULES.category_rows())
CAP = sql_values("cap", "track, scope, rule_id, target_id, cap_points", RULES.cap_rows())
PROJECT = sql_values(
    "project", "project_id, track, catalog_version, title, core_criterion_ids, exclusion_conditions",
    RULES.project_rows(),
)
ACTION = sql_values(
    "action", "action_id, criterion_id, current_anchor, target_anchor, action_type, candidate_instruction, required_output, completion_check",
    RULES.action_rows(),
)
LABEL = sql_values("label", "label_kind, id, label", RULES.label_rows())
PROVENANCE = sql_values("provenance", "subject, fact_type, rule_id", RULES.provenance_rows())


def _cues(group: str) -> str:
    return sql_cue("replace(explicit_text, '_', '-')", RULES.cues[group])


BOUND = f"""{BINDING},
usable AS (
  SELECT f.*, r.track FROM facts f JOIN runs r USING (run_id) WHERE EXISTS (
    SELECT 1 FROM sources s WHERE s.run_id = f.run_id AND s.source_id = f.source_id
      AND s.submitted_by_candidate AND (s.source_type = 'cv' OR s.access_status = 'accessible'))),
bound AS (
  SELECT u.*, b.criterion_id, b.priority, {RANK} AS lvl FROM usable u
  JOIN binding b ON b.subject = u.subject AND b.track = u.track
  WHERE NOT (criterion_id = 'da.projects.findings' AND u.subject = 'analytics_project_outcome'
      AND NOT {_cues('findings_cues')})
    AND NOT (criterion_id = 'se.projects.depth_ownership' AND attribution_status <> 'attributed')),
chosen AS (
  SELECT * FROM (SELECT *, min(priority) OVER (PARTITION BY run_id, criterion_id) AS p FROM bound)
  WHERE priority = p),
winners AS (
  SELECT * FROM (SELECT *, max(lvl) OVER (PARTITION BY run_id, criterion_id) AS best FROM chosen)
  WHERE lvl = best AND lvl > 0)"""

QUALIFICATION = f"""{ROUTE},
qual AS (
  SELECT *, CASE WHEN track = {q(SE)} THEN {_cues('se_relevant_fields')} ELSE {_cues('da_relevant_fields')} END AS relevant,
    {_cues('completed_cues')} AS done, {_cues('in_progress_cues')} AS doing,
    subject IN {sql_in(binding.CERTIFICATE_SUBJECTS)} AND run_id IN (
      SELECT run_id FROM usable WHERE fact_type IN ('skill_application', 'tool_application')) AS course
  FROM usable WHERE fact_type = 'qualification'),
qual_routes AS (
  SELECT *, CASE WHEN relevant AND done AND doing THEN 'ambiguous'
      WHEN relevant AND (done OR doing) AND course THEN 'ambiguous'
      WHEN relevant AND done THEN 'completed' WHEN relevant AND doing THEN 'in_progress'
      WHEN course THEN 'bootcamp' END AS route FROM qual),
qual_ambiguous AS (SELECT DISTINCT run_id FROM qual_routes WHERE route = 'ambiguous'),
qual_best AS (
  SELECT run_id, arg_max(route_id, points * 100 - route_ord) AS anchor
  FROM qual_routes JOIN route USING (track, route)
  WHERE run_id NOT IN (SELECT run_id FROM qual_ambiguous) GROUP BY 1)"""

BINDINGS = f"""{CRITERION},
level_rows AS (SELECT run_id, criterion_id, max(evidence_level) AS anchor, count(*) AS n_evidence FROM winners GROUP BY 1, 2),
bindings AS MATERIALIZED (
  SELECT r.run_id, c.criterion_id, coalesce(l.anchor, 'missing_unverifiable') AS anchor, coalesce(n_evidence, 0) AS n_evidence
  FROM runs r JOIN criterion c ON c.track = r.track AND scoring = 'evidence_anchors'
  LEFT JOIN level_rows l ON l.run_id = r.run_id AND l.criterion_id = c.criterion_id
  UNION ALL
  SELECT r.run_id, substr(replace(r.track, 'software_engineering', 'se'), 1, 2) || '.alignment.qualification',
    coalesce(b.anchor, substr(replace(r.track, 'software_engineering', 'se'), 1, 2) || '.qual.none'),
    (SELECT count(*) FROM qual_routes x JOIN route y USING (track, route) WHERE x.run_id = r.run_id AND y.route_id = b.anchor)
  FROM runs r LEFT JOIN qual_best b USING (run_id))"""

CONTEXT = f"""targets AS (
  SELECT run_id, bool_or(subject = CASE WHEN track = {q(SE)} THEN 'software_engineering_target' ELSE 'data_analytics_target' END) AS own
  FROM facts JOIN runs USING (run_id) WHERE fact_type = 'role_alignment' GROUP BY 1),
signals AS (
  SELECT run_id, bool_or(subject = 'google_sheets' AND evidence_level = 'demonstrated') AS sheets,
    bool_or(subject = 'excel') AS excel, bool_or(subject = 'context_free_dashboard_screenshot') AS shot,
    bool_or(subject = 'python') AS python, bool_or(attribution_status = 'conflicting') AS conflict
  FROM usable GROUP BY 1),
context AS MATERIALIZED (
  SELECT *, flags <> '' AS blocked FROM (
    SELECT r.run_id, r.track, coalesce(python, FALSE) AS python,
      concat_ws(',', CASE WHEN r.track = {q(DA)} AND sheets AND NOT excel THEN {q(binding.SHEETS_CEILING)} END,
        CASE WHEN r.track = {q(DA)} AND shot THEN {q(binding.PLAIN_SCREENSHOT)} END) AS triggers,
      concat_ws(',', CASE WHEN NOT t.own THEN 'TRACK_MISMATCH' END,
        CASE WHEN conflict THEN 'MATERIAL_SOURCE_CONTRADICTION' END,
        CASE WHEN r.run_id IN (SELECT run_id FROM qual_ambiguous) THEN 'MATERIAL_CLASSIFICATION_AMBIGUITY' END) AS flags,
      (SELECT anchor = 'missing_unverifiable' FROM bindings b WHERE b.run_id = r.run_id AND b.criterion_id = 'se.core.application_systems') AS api_missing
    FROM runs r LEFT JOIN targets t USING (run_id) LEFT JOIN signals USING (run_id)))"""

POINTS = f"""{ANCHOR},
points AS MATERIALIZED (
  SELECT b.run_id, x.track, c.criterion_id, c.category_id, c.criterion_ord, c.label, c.max_points, c.rule_id, b.anchor, b.n_evidence,
    least(c.max_points, CASE
      WHEN c.criterion_id = 'da.core.spreadsheets' AND contains(triggers, {q(binding.SHEETS_CEILING)}) THEN least(a.points, 5)
      WHEN c.criterion_id = 'da.projects.context' AND contains(triggers, {q(binding.PLAIN_SCREENSHOT)}) THEN 0
      ELSE a.points END) AS awarded_points
  FROM bindings b JOIN context x USING (run_id) JOIN criterion c USING (criterion_id)
  JOIN criterion_anchor a ON a.criterion_id = b.criterion_id AND a.anchor = b.anchor
  WHERE NOT blocked)"""

SCORES = f"""{CATEGORY},
{CAP},
{PROJECT},
linked AS (
  SELECT DISTINCT run_id FROM sources WHERE source_type IN {PROJECT_TYPES} AND submitted_by_candidate AND access_status = 'accessible'),
category_caps AS (
  SELECT x.run_id, k.rule_id, k.target_id AS category_id, k.cap_points FROM context x JOIN cap k ON k.track = x.track AND scope = 'category'
  WHERE NOT blocked AND x.run_id NOT IN (SELECT run_id FROM linked)),
overall_caps AS (
  SELECT p.run_id, k.rule_id, k.target_id AS criterion_id, k.cap_points FROM points p JOIN cap k ON k.target_id = p.criterion_id AND scope = 'overall'
  WHERE p.anchor = 'missing_unverifiable'),
category_scores AS MATERIALIZED (
  SELECT p.run_id, p.category_id, c.category_ord, c.max_points, pre_cap_score, least(pre_cap_score, coalesce(k.cap_points, pre_cap_score)) AS final_score
  FROM (SELECT run_id, category_id, sum(awarded_points)::BIGINT AS pre_cap_score FROM points GROUP BY 1, 2) p
  JOIN category c USING (category_id) LEFT JOIN category_caps k ON k.run_id = p.run_id AND k.category_id = p.category_id),
totals AS (
  SELECT run_id, raw_total, coalesce(cap, 100) AS applicable_overall_cap, least(raw_total, coalesce(cap, 100)) AS final_score
  FROM (SELECT run_id, sum(final_score)::BIGINT AS raw_total FROM category_scores GROUP BY 1)
  LEFT JOIN (SELECT run_id, min(cap_points) AS cap FROM overall_caps GROUP BY 1) USING (run_id)),
scored AS MATERIALIZED (
  SELECT *, CASE WHEN final_score <= 39 THEN 'limited_application_evidence' WHEN final_score <= 59 THEN 'foundation_visible'
    WHEN final_score <= 79 THEN 'developing_application_readiness' ELSE 'strong_application_evidence' END AS band FROM totals),
gap_rows AS MATERIALIZED (
  SELECT p.*, p.max_points - awarded_points AS point_gap, row_number() OVER (PARTITION BY p.run_id ORDER BY
    CASE WHEN o.run_id IS NULL THEN 1 ELSE 0 END, CASE WHEN k.run_id IS NULL THEN 1 ELSE 0 END,
    p.max_points - awarded_points DESC, p.max_points DESC, p.criterion_id) AS gap_ord
  FROM points p LEFT JOIN overall_caps o ON o.run_id = p.run_id AND o.criterion_id = p.criterion_id
  LEFT JOIN category_caps k ON k.run_id = p.run_id AND k.category_id = p.category_id WHERE p.max_points > awarded_points),
strength_rows AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY awarded_points / max_points DESC, awarded_points DESC,
    max_points DESC, criterion_id) AS strength_ord FROM points WHERE awarded_points > 0) WHERE strength_ord <= 5),
coverage AS (
  SELECT x.run_id, j.project_id, sum(g.point_gap)::BIGINT AS coverage FROM context x JOIN project j ON j.track = x.track
  JOIN gap_rows g ON g.run_id = x.run_id AND list_contains(j.core_criterion_ids, g.criterion_id)
  WHERE NOT blocked AND NOT (list_contains(exclusion_conditions, 'python_not_explicit') AND NOT python)
    AND NOT (list_contains(exclusion_conditions, 'api_foundation_missing_unverifiable') AND coalesce(api_missing, FALSE)) GROUP BY 1, 2),
choices AS (
  SELECT s.run_id, coalesce(c.project_id, {q(NO_PROJECT)}) AS project_id FROM scored s LEFT JOIN (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY coverage DESC, project_id) AS rn FROM coverage) WHERE rn = 1) c USING (run_id))"""

STAGES = [
    ("blocks", base.SQL_BLOCKS), ("sources", base.SQL_SOURCES), ("sentences", SENTENCES),
    ("raw", RAW), ("technical", FACTS), ("cue_facts", CUE_FACTS), ("process", PROCESS),
    ("work", WORK), ("emitted", EMITTED), ("quality", QUALITY), ("facts", ALL_FACTS),
    ("bound", BOUND), ("qualification", QUALIFICATION), ("bindings", BINDINGS),
    ("context", CONTEXT), ("points", POINTS), ("scores", SCORES),
]


def sql(stage: str, select: str, *more: str) -> str:
    """SELECT over everything up to a stage, with further CTEs if given."""
    names = [n for n, _ in STAGES]
    parts = [text for _, text in STAGES[: names.index(stage) + 1]]
    return "WITH " + ",\n".join([*parts, *more]) + "\n" + select
