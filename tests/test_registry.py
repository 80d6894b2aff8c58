from attesta.operators import rulecheck
from attesta.registry import Registry, default_registry
from attesta.registry.tables import SCHEMAS


def test_sizes():
    rules = default_registry()
    sizes = {name: len(rows(rules)) for name, (rows, _) in SCHEMAS.items()}
    assert sizes["action"] == 212 and sizes["criterion"] == 52 and sizes["project"] == 8
    assert sizes["alias"] == 130 and sizes["route"] == 12
    assert len({r[0] for r in rules.action_rows()}) == 212


def test_published_rules_hold(spark):
    assert rulecheck.validate_ruleset(spark).count() == 0


def test_broken_rules_are_found(spark):
    rules = Registry()
    broken = Registry(
        bands=rules.bands[:-1],
        criteria=rules.criteria[1:],
        subject_aliases=rules.subject_aliases + (("tool", "other", ("python",)),),
    )
    found = {r.violation for r in rulecheck.validate_ruleset(spark, broken).collect()}
    assert {"band_coverage", "criteria_not_100", "category_sum", "action_criterion", "alias_with_two_owners"} <= found


def test_tables_have_their_schema(spark):
    for name in SCHEMAS:
        assert default_registry().table(spark, name).columns
