"""A rule set from seven rule documents, and the documents of a rule set.

Rule documents are configuration: one JSON object each, a few hundred entries, read with Spark from any path it
reaches. Operators take the loaded registry like any other, so their scanners and rule tables follow the documents.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession

from attesta.registry import rubric_values
from attesta.registry.tables import PREFIX, Registry, track_of

#: The documents by role. Each is ``<name>.json`` below the folder given to :func:`load_registry`.
NAMES = (
    "evidence_rules", "higher_order_rules", "criterion_binding_rules", "rubric", "action_catalog", "project_catalog",
    "report_copy",
)
ACTION_FIELDS = (
    "action_id", "criterion_id", "current_anchor", "target_anchor", "action_type", "candidate_instruction",
    "required_output", "completion_check",
)
#: Lists of the higher-order document that are no cues.
NOT_CUES = ("project_source_types", "da_analysis_subjects")
#: No document of configuration is larger; a larger one is refused before it reaches the driver.
MAX_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class LoadedRegistry(Registry):
    """A rule set whose actions, projects and labels are rows of documents."""

    actions: tuple = ()
    catalogue: tuple = ()
    labels: tuple = ()

    def action_rows(self) -> list[tuple]:
        return list(self.actions)

    def project_rows(self) -> list[tuple]:
        return [(*row[:4], list(row[4]), list(row[5])) for row in self.catalogue]

    def label_rows(self) -> list[tuple]:
        return list(self.labels)


def read_json(spark: SparkSession, path: str) -> dict:
    """One document. The size is looked at before the content is fetched."""
    files = spark.read.format("binaryFile").load(path).select("length", "content")
    sizes = [r["length"] for r in files.select("length").collect()]
    if len(sizes) != 1 or sizes[0] > MAX_BYTES:
        raise ValueError(f"{path}: one file of at most {MAX_BYTES} bytes is wanted")
    document = json.loads(bytes(files.select("content").first()["content"]).decode("utf-8"))
    if not isinstance(document, dict):
        raise ValueError(f"{path}: no JSON object")
    return document


def load_registry(spark: SparkSession, folder: str) -> LoadedRegistry:
    """The rule set in the documents of a folder. A document that contradicts the naming of rules is refused."""
    return registry_of({name: read_json(spark, f"{folder}/{name}.json") for name in NAMES})


def named(expected: str, found: str) -> None:
    if expected != found:
        raise ValueError(f"rule {found} should be named {expected}")


def registry_of(documents: dict[str, dict]) -> LoadedRegistry:
    evidence, higher, binding, rubric, actions, projects, copy = (documents[n] for n in NAMES)
    aliases, exact = [], []
    for entry in evidence["subjects"] + evidence["qualifications"]:
        named(f"normalize.v1.{entry['kind']}.{entry['subject']}", entry["rule_id"])
        aliases.append((entry["kind"], entry["subject"], tuple(a["text"] for a in entry["aliases"])))
        exact += [a["text"] for a in entry["aliases"] if a["case_sensitive"]]
    types: dict[str, list[str]] = {}
    for subject, rule in higher["rules"].items():
        fact_type = rule.split(".")[2]
        named(f"classify.v1.{fact_type}.{subject}", rule)
        types.setdefault(fact_type, []).append(subject)
    categories, criteria, routes, caps, special, tracks = [], [], [], [], [], []
    for track, rules in rubric["tracks"].items():
        tracks.append(("track", track, rules["display_name"]))
        categories += [(c["id"], c["display_name"], c["max_points"]) for c in rules["categories"]]
        for c in rules["criteria"]:
            named(f"rubric.v2.{c['id']}", c["rule_id"])
            named(c["category_id"], c["id"].rsplit(".", 1)[0])
            named(track, track_of(c["id"]))
            anchors = c.get("evidence_anchors") or {}
            criteria.append((c["id"], c["display_name"], c["max_points"], anchors.get("documented"), anchors.get("named_only")))
        routes += [(r["id"], r["points"]) for r in rules["qualification_routes"]]
        caps += [("category", c["rule_id"], c["category_id"], c["cap_points"]) for c in rules["category_caps"]]
        caps += [("overall", c["rule_id"], c["related_criterion_id"], c["cap_points"]) for c in rules["overall_caps"]]
        caps += [("criterion", c["rule_id"], c["criterion_id"], c["cap_points"]) for c in rules["criterion_caps"]]
        special += [r["rule_id"] for r in rules["special_rules"]]
    bands = [(b["id"], b["label"], b["min"], b["max"]) for b in rubric["score_bands"]]
    anchors = [("anchor", k, v) for part in ("evidence_anchor_labels", "qualification_route_labels") for k, v in copy[part].items()]
    return LoadedRegistry(
        action_cues=tuple(evidence["action_cues"]), subject_aliases=tuple(aliases), case_sensitive=tuple(exact),
        cues={k: tuple(v) for k, v in higher.items() if isinstance(v, list) and k not in NOT_CUES},
        project_source_types=tuple(higher["project_source_types"]), analysis_subjects=tuple(higher["da_analysis_subjects"]),
        derived_fact_types={t: tuple(s) for t, s in types.items()}, bands=tuple(bands), categories=tuple(categories),
        criteria=tuple(criteria), routes=tuple(routes), caps=tuple(caps), special_rules=tuple(special),
        bindings=tuple(
            (c["criterion_id"], tuple(c["subjects"]), tuple(c.get("fallback_subjects", ())))
            for rules in binding["tracks"].values() for c in rules["criteria"] if "subjects" in c
        ),
        flag_order=tuple(binding["flag_order"]),
        projects=tuple((p["project_id"], p["title"], tuple(p["core_criterion_ids"])) for p in projects["projects"]),
        actions=tuple(tuple(a[f] for f in ACTION_FIELDS) for a in actions["actions"]),
        catalogue=tuple(
            (p["project_id"], p["track"], p["catalog_version"], p["title"], tuple(p["core_criterion_ids"]), tuple(p["exclusion_conditions"]))
            for p in projects["projects"]
        ),
        labels=(
            *tracks, *(("category", c, n) for c, n, _ in categories), *(("criterion", c[0], c[1]) for c in criteria),
            *(("band", b, n) for b, n, _, _ in bands), *anchors, *(("cap", k, v) for k, v in copy["cap_rule_labels"].items()),
        ),
    )


def documents_of(registry: Registry) -> dict[str, dict]:
    """The seven documents of a rule set, so that rules can be exported, edited and loaded again."""
    of = lambda rows, track: [r for r in rows if track_of(r[0]) == track]
    label = lambda kind: {i: n for k, i, n in registry.label_rows() if k == kind}
    points: dict[str, dict] = {}
    for criterion, anchor, value in registry.anchor_rows():
        points.setdefault(criterion, {})[anchor] = value
    subjects = [
        {
            "subject": subject, "kind": kind, "rule_id": f"normalize.v1.{kind}.{subject}",
            "aliases": [{"text": a, "case_sensitive": a in registry.case_sensitive} for a in texts],
        }
        for kind, subject, texts in registry.subject_aliases
    ]
    targets = {"category": "category_id", "overall": "related_criterion_id", "criterion": "criterion_id"}

    def cap_list(track: str, scope: str) -> list[dict]:
        return [
            {"rule_id": rule, "track": track, targets[scope]: target, "cap_points": cap}
            for owner, kind, rule, target, cap in registry.cap_rows() if owner == track and kind == scope
        ]

    def track_rules(track: str) -> dict:
        return {
            "id": track, "display_name": label("track")[track],
            "categories": [{"id": c, "display_name": n, "max_points": p} for c, n, p in of(registry.categories, track)],
            "criteria": [
                {
                    "id": c, "category_id": category, "display_name": name, "max_points": top, "scoring": scoring, "rule_id": rule,
                    **({"evidence_anchors": points[c]} if scoring == "evidence_anchors" else {}),
                }
                for owner, c, category, _, name, top, scoring, rule in registry.criterion_rows() if owner == track
            ],
            "qualification_routes": [{"id": r, "points": p} for r, p in of(registry.routes, track)],
            "category_caps": cap_list(track, "category"), "overall_caps": cap_list(track, "overall"),
            "criterion_caps": cap_list(track, "criterion"),
            "special_rules": [{"rule_id": r} for r in registry.special_rules if track_of(r.split(".", 2)[2]) == track],
        }

    tracks = list(PREFIX.values())
    versions = {"contract_version": rubric_values.CONTRACT_VERSION}
    anchors, routes = label("anchor"), {r for r, _ in registry.routes}
    return {
        "evidence_rules": versions | {
            "action_cues": list(registry.action_cues),
            "subjects": [s for s in subjects if s["kind"] != "qualification"],
            "qualifications": [s for s in subjects if s["kind"] == "qualification"],
        },
        "higher_order_rules": versions | {
            **{k: list(v) for k, v in registry.cues.items()},
            "project_source_types": list(registry.project_source_types), "da_analysis_subjects": list(registry.analysis_subjects),
            "rules": {s: f"classify.v1.{t}.{s}" for s, t in registry.derived_types().items()},
        },
        "criterion_binding_rules": versions | {
            "flag_order": list(registry.flag_order),
            "tracks": {
                t: {"criteria": [{"criterion_id": c, "subjects": list(s), "fallback_subjects": list(f)} for c, s, f in of(registry.bindings, t)]}
                for t in tracks
            },
        },
        "rubric": versions | {
            "rubric_version": rubric_values.RUBRIC_VERSION, "supported_tracks": tracks,
            "score_bands": [{"id": b, "label": n, "min": low, "max": high} for b, n, low, high in registry.bands],
            "tracks": {t: track_rules(t) for t in tracks},
        },
        "action_catalog": versions | {"actions": [dict(zip(ACTION_FIELDS, a)) for a in registry.action_rows()]},
        "project_catalog": versions | {
            "projects": [
                dict(zip(("project_id", "track", "catalog_version", "title", "core_criterion_ids", "exclusion_conditions"), p))
                for p in registry.project_rows()
            ]
        },
        "report_copy": {
            "evidence_anchor_labels": {k: v for k, v in anchors.items() if k not in routes},
            "qualification_route_labels": {k: v for k, v in anchors.items() if k in routes}, "cap_rule_labels": label("cap"),
        },
    }


def write_documents(registry: Registry, spark: SparkSession, folder: str) -> None:
    """The documents as files below a folder of any file system Spark reaches."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name, document in documents_of(registry).items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        out = path.getFileSystem(conf).create(path, True)
        try:
            out.write(bytearray(json.dumps(document, ensure_ascii=False).encode("utf-8")))
        finally:
            out.close()
