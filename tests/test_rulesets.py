from pyspark.sql import functions as F

from attesta.operators import rulesets


def sets(spark, n):
    return spark.range(n).withColumnRenamed("id", "ruleset_id")


def found(tables, keys):
    return sorted(tuple(r) for r in rulesets.rule_violations(tables, keys).collect())


def test_published_rules_hold_for_every_set(spark):
    keys = sets(spark, 5)
    assert found(rulesets.rule_tables(spark, keys), keys) == []


def test_faults_stay_in_their_set(spark):
    keys = sets(spark, 4)
    tables = rulesets.rule_tables(spark, keys)
    own = F.col("ruleset_id")
    band = F.when((own == 1) & (F.col("min_score") == 40), 38).otherwise(F.col("min_score"))
    tables["band"] = tables["band"].withColumn("min_score", band)
    tables["category"] = tables["category"].filter((own != 2) | (F.col("category_id") != "da.tools"))
    tables["action"] = tables["action"].withColumn(
        "current_anchor", F.when((own == 3) & F.col("action_id").endswith("core.sql.named_only"), "odd").otherwise(F.col("current_anchor"))
    )
    assert found(tables, keys) == [
        (1, "band_coverage", "38"), (1, "band_coverage", "39"),
        (2, "categories_not_100", "data_analytics"), (2, "unknown_category", "da.tools"),
        (3, "unknown_anchor", "odd"),
    ]


def test_set_without_rows_is_found(spark):
    """A set that no table mentions breaks every check on sums, sizes and coverage."""
    keys = sets(spark, 2)
    tables = {n: t.filter("ruleset_id = 0") for n, t in rulesets.rule_tables(spark, keys).items()}
    rows = found(tables, keys)
    assert {r[0] for r in rows} == {1}
    names = [r[1] for r in rows]
    assert names.count("band_coverage") == 101 and names.count("size") == 2 and names.count("best_route") == 2


def test_one_shuffle(spark):
    keys = sets(spark, 3)
    plan = rulesets.rule_violations(rulesets.rule_tables(spark, keys), keys)._jdf.queryExecution().executedPlan().toString()
    # one for the gathering, one for the distinct alias owners; rule tables are only broadcast
    assert plan.count("Exchange hashpartitioning") <= 2 and "SortMergeJoin" not in plan and "Cartesian" not in plan


def test_dealt_sets_are_gathered_where_they_lie(spark):
    """Only the rule sets are shuffled, in as many tasks as their number asks for; their violations stay the same."""
    keys = sets(spark, rulesets.TASK_RULESETS * 9).filter("ruleset_id < 3 OR ruleset_id > 20")
    held = rulesets.dealt(keys)
    tables = rulesets.rule_tables(spark, held)
    tables["band"] = tables["band"].filter((F.col("ruleset_id") != 30) | (F.col("min_score") != 80))
    checked = rulesets.rule_violations(tables, held)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM")
    assert held.rdd.getNumPartitions() >= 9
    assert sorted(tuple(r) for r in checked.collect()) == [(30, "band_coverage", str(n)) for n in range(100, 101)] + [
        (30, "band_coverage", str(n)) for n in range(80, 100)
    ]


def test_carried_columns_go_to_all_rule_rows(spark):
    keys = sets(spark, 2).withColumn("size", F.col("ruleset_id") + 5)
    rows = rulesets.rule_tables(spark, keys, carried=("size",))["criterion"]
    assert rows.columns[:2] == ["ruleset_id", "size"]
    assert rows.filter("size <> ruleset_id + 5").isEmpty() and rows.count() == 2 * 52


def test_null_claims_make_no_violation(spark):
    """A label without text owns no key, and a cap that is not fixed weighs nothing."""
    keys = sets(spark, 2)
    tables = rulesets.rule_tables(spark, keys)
    empty = (F.col("ruleset_id") == 1) & (F.col("id") == "se.core")
    tables["label"] = tables["label"].withColumn("label", F.when(empty, " ").otherwise(F.col("label")))
    assert found(tables, keys) == [(1, "missing_label", "category|se.core")]
