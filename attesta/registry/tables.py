"""The rule set as one value object, and every rule table as a small DataFrame.

All rule tables together hold a few hundred rows whatever the data size, so joining them with
``F.broadcast`` is safe. Operators take a :class:`Registry`; pass another one to change the rules.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from attesta.registry import action_values, evidence_values, rubric_values

SE, DA = rubric_values.TRACKS
PREFIX = {"se": SE, "da": DA}
ANCHORS = ("demonstrated", "documented", "named_only", "missing_unverifiable")
KIND_FACT_TYPES = {
    "skill": ("skill_name", "skill_application"),
    "tool": ("tool_name", "tool_application"),
    "qualification": ("qualification",),
}


def track_of(rule_name: str) -> str:
    """Track of a criterion, category, route or project, told by the first name part."""
    return PREFIX[rule_name.split(".")[0]]


@dataclass(frozen=True)
class Registry:
    """One rule set. The defaults are the published fixed values."""

    action_cues: tuple = evidence_values.ACTION_CUES
    subject_aliases: tuple = evidence_values.SUBJECT_ALIASES
    case_sensitive: tuple = evidence_values.CASE_SENSITIVE_ALIASES
    cues: dict = field(default_factory=lambda: evidence_values.CUES)
    project_source_types: tuple = evidence_values.PROJECT_SOURCE_TYPES
    analysis_subjects: tuple = evidence_values.DA_ANALYSIS_SUBJECTS
    derived_fact_types: dict = field(default_factory=lambda: evidence_values.DERIVED_FACT_TYPES)
    bands: tuple = rubric_values.BANDS
    categories: tuple = rubric_values.CATEGORIES
    criteria: tuple = rubric_values.CRITERIA
    routes: tuple = rubric_values.ROUTES
    caps: tuple = rubric_values.CAPS
    special_rules: tuple = rubric_values.SPECIAL_RULES
    bindings: tuple = rubric_values.BINDINGS
    flag_order: tuple = rubric_values.FLAG_ORDER
    projects: tuple = rubric_values.PROJECTS
    matrix: tuple = action_values.MATRIX

    # plain rows -------------------------------------------------------------------------------

    def alias_rows(self) -> list[tuple]:
        return [
            (subject, kind, f"normalize.v1.{kind}.{subject}", alias, alias in self.case_sensitive)
            for kind, subject, aliases in self.subject_aliases
            for alias in aliases
        ]

    def cue_rows(self) -> list[tuple]:
        return [(group, phrase) for group, phrases in self.cues.items() for phrase in phrases]

    def derived_types(self) -> dict[str, str]:
        return {s: t for t, subjects in self.derived_fact_types.items() for s in subjects}

    def provenance_rows(self) -> list[tuple]:
        found = [
            (subject, fact_type, f"normalize.v1.{kind}.{subject}")
            for kind, subject, _ in self.subject_aliases
            for fact_type in KIND_FACT_TYPES[kind]
        ]
        return found + [(s, t, f"classify.v1.{t}.{s}") for s, t in self.derived_types().items()]

    def binding_rows(self) -> list[tuple]:
        rows = []
        for criterion, primary, fallback in self.bindings:
            for priority, subjects in enumerate((primary, fallback)):
                rows += [(track_of(criterion), criterion, s, priority) for s in subjects]
        return rows

    def criterion_rows(self) -> list[tuple]:
        rows = []
        for track in PREFIX.values():
            mine = [c for c in self.criteria if track_of(c[0]) == track]
            for order, (criterion, label, points, documented, _) in enumerate(mine):
                scoring = "qualification_routes" if documented is None else "evidence_anchors"
                rows.append(
                    (
                        track, criterion, criterion.rsplit(".", 1)[0], order, label, points,
                        scoring, f"rubric.v2.{criterion}",
                    )
                )
        return rows

    def anchor_rows(self) -> list[tuple]:
        rows = []
        for criterion, _, top, documented, named in self.criteria:
            if documented is not None:
                rows += [(criterion, a, p) for a, p in zip(ANCHORS, (top, documented, named, 0))]
        for route, points in self.routes:
            rows.append((f"{route.split('.')[0]}.alignment.qualification", route, points))
        return rows

    def category_rows(self) -> list[tuple]:
        seen: dict[str, int] = {}
        rows = []
        for category, label, points in self.categories:
            track = track_of(category)
            rows.append((track, category, seen.get(track, 0), label, points))
            seen[track] = seen.get(track, 0) + 1
        return rows

    def route_rows(self) -> list[tuple]:
        seen: dict[str, int] = {}
        rows = []
        for route, points in self.routes:
            track = track_of(route)
            rows.append((track, route, route.rsplit(".", 1)[1], seen.get(track, 0), points))
            seen[track] = seen.get(track, 0) + 1
        return rows

    def cap_rows(self) -> list[tuple]:
        return [(track_of(target), scope, rule, target, cap) for scope, rule, target, cap in self.caps]

    def project_rows(self) -> list[tuple]:
        rows = []
        for project, title, core in self.projects:
            track = track_of(project)
            exclusions = rubric_values.PROJECT_EXCLUSIONS_ALL + (
                rubric_values.PROJECT_EXCLUSIONS_EXTRA.get(project, ())
            )
            rows.append((project, track, rubric_values.CATALOG_VERSION, title, list(core), list(exclusions)))
        return rows

    def action_rows(self) -> list[tuple]:
        """The 212 actions: 50 criteria x 4 anchors and 12 qualification routes."""
        labels = {c[0]: c[1] for c in self.criteria}
        rows = []
        for criterion, target, output, check in self.matrix:
            for anchor, kind, template in action_values.TEMPLATES:
                proof = ".projects." in criterion or anchor in ("documented", "demonstrated")
                rows.append(
                    (
                        f"action.v1.{criterion}.{anchor}", criterion, anchor,
                        "demonstrated" if proof else "documented", kind,
                        template.format(label=labels.get(criterion, criterion), target=target), output, check,
                    )
                )
        for prefix in PREFIX:
            criterion = f"{prefix}.alignment.qualification"
            for route, kind, instruction, output, check in action_values.ROUTE_ACTIONS:
                anchor = f"{prefix}.qual.{route}"
                rows.append(
                    (
                        f"action.v1.{criterion}.{route}", criterion, anchor, anchor, kind,
                        instruction, output, check,
                    )
                )
        return rows

    def label_rows(self) -> list[tuple]:
        rows = [("track", t, n) for t, n in zip(PREFIX.values(), ("Software Engineering", "Data Analytics"))]
        rows += [("category", c, n) for c, n, _ in self.categories]
        rows += [("criterion", c[0], c[1]) for c in self.criteria]
        rows += [("band", b, n) for b, n, _, _ in self.bands]
        rows += [("anchor", a, n) for a, n in rubric_values.ANCHOR_LABELS.items()]
        rows += [("anchor", r, n) for r, n in rubric_values.ROUTE_LABELS.items()]
        return rows + [("cap", c, n) for c, n in rubric_values.CAP_LABELS.items()]

    def recognised_rules(self) -> list[str]:
        return sorted(
            [f"rubric.v2.{c[0]}" for c in self.criteria]
            + [c[1] for c in self.caps]
            + list(self.special_rules)
        )

    # DataFrames -------------------------------------------------------------------------------

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One rule table as a DataFrame, by its name in :data:`SCHEMAS`."""
        rows, schema = SCHEMAS[name]
        return spark.createDataFrame(rows(self), schema)


SCHEMAS = {
    "alias": (
        Registry.alias_rows,
        "subject string, kind string, rule_id string, alias string, case_sensitive boolean",
    ),
    "cue": (Registry.cue_rows, "cue_group string, phrase string"),
    "provenance": (Registry.provenance_rows, "subject string, fact_type string, rule_id string"),
    "binding": (
        Registry.binding_rows,
        "track string, criterion_id string, subject string, priority int",
    ),
    "criterion": (
        Registry.criterion_rows,
        "track string, criterion_id string, category_id string, criterion_ord int, label string, "
        "max_points int, scoring string, rule_id string",
    ),
    "criterion_anchor": (
        Registry.anchor_rows, "criterion_id string, anchor string, points int",
    ),
    "category": (
        Registry.category_rows,
        "track string, category_id string, category_ord int, label string, max_points int",
    ),
    "route": (
        Registry.route_rows,
        "track string, route_id string, route string, route_ord int, points int",
    ),
    "cap": (
        Registry.cap_rows,
        "track string, scope string, rule_id string, target_id string, cap_points int",
    ),
    "band": (
        lambda r: list(r.bands), "band string, label string, min_score int, max_score int",
    ),
    "project": (
        Registry.project_rows,
        "project_id string, track string, catalog_version string, title string, "
        "core_criterion_ids array<string>, exclusion_conditions array<string>",
    ),
    "action": (
        Registry.action_rows,
        "action_id string, criterion_id string, current_anchor string, target_anchor string, "
        "action_type string, candidate_instruction string, required_output string, "
        "completion_check string",
    ),
    "label": (Registry.label_rows, "label_kind string, id string, label string"),
}


@lru_cache(maxsize=1)
def default_registry() -> Registry:
    return Registry()
