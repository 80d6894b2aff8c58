import json

import pytest

from attesta.operators import evidence
from attesta.plans.assessment import assess
from attesta.registry import default_registry, documents
from attesta.registry.tables import SCHEMAS
from tests.test_assessment import cv
from tests.test_store import batch_of


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("rules"))
    documents.write_documents(default_registry(), spark, folder)
    return documents.load_registry(spark, folder)


def test_all_tables_survive(loaded):
    default = default_registry()
    for name, (rows, _) in SCHEMAS.items():
        assert sorted(map(repr, rows(loaded))) == sorted(map(repr, rows(default))), name
    for name in ("action_cues", "cues", "project_source_types", "analysis_subjects", "flag_order", "special_rules", "bindings"):
        assert getattr(loaded, name) == getattr(default, name), name


def test_assessment_with_loaded_rules(spark, loaded):
    runs, sources, batch = batch_of(spark)
    blocks = cv(spark, ["Built a REST API in Python", "Java and SQL"]).unionByName(cv(spark, ["Likes long walks"], run=2))
    again = assess(runs, sources, blocks, loaded)
    for name in ("facts", "bindings", "outcomes"):
        one, two = getattr(batch, name), getattr(again, name)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, two.select(*one.columns).collect())), name


def test_changed_documents_change_the_scan(spark):
    rules = documents.documents_of(default_registry())
    rules["evidence_rules"]["subjects"].append(
        {"subject": "walks", "kind": "skill", "rule_id": "normalize.v1.skill.walks", "aliases": [{"text": "long walks", "case_sensitive": False}]}
    )
    facts = evidence.normalize_evidence(cv(spark, ["Likes long walks"]), documents.registry_of(rules)).collect()
    assert [(f.subject, f.rule_id) for f in facts] == [("walks", "normalize.v1.skill.walks")]


def test_contradictions_are_refused(spark, tmp_path):
    rules = documents.documents_of(default_registry())
    rules["rubric"]["tracks"]["data_analytics"]["criteria"][0]["rule_id"] = "other"
    with pytest.raises(ValueError, match="other"):
        documents.registry_of(rules)
    (tmp_path / "list.json").write_text(json.dumps([1]))
    with pytest.raises(ValueError, match="no JSON object"):
        documents.read_json(spark, str(tmp_path / "list.json"))
