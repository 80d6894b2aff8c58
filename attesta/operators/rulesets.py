"""Checks of many rule sets at once: every rule table carries the key of its rule set.

What has to hold is declared as rows (:data:`CHECKS`). All tables emit claims (who names a key, who owns it, what it
weighs) into one relation, one aggregation per rule set, space and key gathers them, and each check is a condition on
a gathered row. So any number of rule sets costs one shuffle, with partial aggregation for frequent keys, and no join.
Rule sets that were dealt out by their key before their tables are made (:func:`dealt`) are gathered where they lie:
then only the rule sets are shuffled, and no rule row and no claim.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.registry import Registry, default_registry
from attesta.registry.tables import ANCHORS, DA, SE

# Sizes, best routes and two overall caps that a published rule set has.
SIZES = {"action": 212, "project": 8}
BEST_ROUTE = {SE: 10, DA: 7}
FIXED_CAPS = {(SE, "no_language"): 59, (DA, "no_sql"): 79}

# violation, space, broken when. Gathered columns: owners, users, weight (sum), top (largest use), bound.
CHECKS = (
    ("double_criterion", "criterion", "owners > 1"),
    ("double_category", "category", "owners > 1"),
    ("double_rule", "rule", "owners > 1"),
    ("double_action", "action", "owners > 1"),
    ("double_project", "project", "owners > 1"),
    ("unknown_criterion", "criterion", "users > 0 AND owners = 0"),
    ("unknown_category", "category", "users > 0 AND owners = 0"),
    ("unknown_anchor", "anchor", "users > 0 AND owners = 0"),
    ("unknown_track", "track", "users > 0 AND owners = 0"),
    ("alias_with_two_owners", "alias", "users > 1"),
    ("missing_label", "label", "users > 0 AND owners = 0"),
    ("criteria_not_100", "criteria_sum", "weight IS DISTINCT FROM bound"),
    ("categories_not_100", "categories_sum", "weight IS DISTINCT FROM bound"),
    ("category_sum", "category_weight", "bound IS NOT NULL AND coalesce(weight, 0) <> bound"),
    ("band_coverage", "score", "users <> 1"),
    ("cap_above_maximum", "cap", "top > bound"),
    ("fixed_cap", "fixed_cap", "weight IS DISTINCT FROM bound"),
    ("best_route", "best_route", "top IS DISTINCT FROM bound"),
    ("size", "size", "weight IS DISTINCT FROM bound"),
)
BY = "ruleset_id"
VERSION = "V2"
READ = {
    "criterion": ("track", "criterion_id", "category_id", "max_points", "rule_id"),
    "category": ("track", "category_id", "max_points"),
    "band": ("band", "min_score", "max_score"),
    "action": ("action_id", "criterion_id", "current_anchor"),
    "project": ("project_id", "track", "core_criterion_ids"),
    "cap": ("track", "scope", "rule_id", "target_id", "cap_points"),
    "route": ("track", "route_id", "points"),
    "alias": ("alias", "subject", "case_sensitive"),
    "label": ("label_kind", "id", "label"),
}


#: Rule sets of a task; a rule set makes about 1600 claims.
TASK_RULESETS = 250


def dealt(rulesets: DataFrame) -> DataFrame:
    """The rule sets hashed by their key to so many tasks that none gets much more than ``TASK_RULESETS`` of them."""
    cores = rulesets.sparkSession.sparkContext.defaultParallelism
    return rulesets.repartition(max(cores, -(-rulesets.count() // TASK_RULESETS)), BY)


def rule_tables(
    spark: SparkSession, rulesets: DataFrame, registry: Registry | None = None, carried: tuple[str, ...] = ()
) -> dict[str, DataFrame]:
    """The tables of a rule set, once for each row of ``rulesets`` (ruleset_id), as a start for variants.

    ``rulesets`` names the published version each set derives from (``version``; without that column the registry's
    own). Rule tables are broadcast, a few hundred rows each, so the rule sets stay where they lie. Columns that no
    check reads, such as instructions, are left out. Columns ``carried`` of ``rulesets`` go to all rule rows.
    """
    rules = registry or default_registry()
    keyed = rulesets.select(BY, *carried, F.col("version") if "version" in rulesets.columns else F.lit(VERSION).alias("version"))
    rows = {name: rules.table(spark, name).select(*columns) for name, columns in READ.items()}
    rows["special"] = spark.createDataFrame([(r,) for r in rules.special_rules], "rule_id string")
    published = {name: F.broadcast(table.withColumn("version", F.lit(VERSION))) for name, table in rows.items()}
    return {name: keyed.join(table, "version").drop("version") for name, table in published.items()}


def _claim(space: str, key: Column | str, owners=0, users=0, weight=None, top=None, bound=None) -> Column:
    number = lambda v, name: (v if isinstance(v, Column) else F.lit(v)).cast("long").alias(name)
    name = F.col(key) if isinstance(key, str) else key
    return F.struct(
        F.lit(space).alias("space"), name.cast("string").alias("key"), number(owners, "owners"), number(users, "users"),
        number(weight, "weight"), number(top, "top"), number(bound, "bound"),
    )


def _label(kind: str, key: str) -> Column:
    return _claim("label", F.concat(F.lit(f"{kind}|"), key), users=1)


def constant_claims() -> list[Column]:
    """What every rule set has to hold, whatever its rows are."""
    found = [_claim("score", F.lit(n)) for n in range(101)]
    for track in (SE, DA):
        found.append(_claim("track", F.lit(track), owners=1))
        found += [_claim(space, F.lit(track), bound=100) for space in ("criteria_sum", "categories_sum")]
        found.append(_claim("best_route", F.lit(track), bound=BEST_ROUTE[track]))
    for anchor in ANCHORS:
        found += [_claim("anchor", F.lit(anchor), owners=1), _claim("label", F.lit(f"anchor|{anchor}"), users=1)]
    found += [_claim("size", F.lit(n), bound=v) for n, v in SIZES.items()]
    found += [_claim("fixed_cap", F.lit(f"{track}.{name}"), bound=v) for (track, name), v in FIXED_CAPS.items()]
    return found + [_claim("cap", F.lit("overall"), bound=100)]


def row_claims() -> dict[str, list[Column]]:
    """What one row of each table says. A claim that does not apply to a row is null."""
    points = F.col("max_points")
    overall = F.col("scope") == "overall"
    named = F.concat_ws(".", "track", F.substring_index("rule_id", ".", -1))
    return {
        "criterion": [
            _claim("criterion", "criterion_id", owners=1), _claim("category", "category_id", users=1),
            _claim("rule", "rule_id", owners=1), _claim("criteria_sum", "track", weight=points),
            _claim("category_weight", "category_id", weight=points), _claim("cap", "criterion_id", bound=points),
            _label("criterion", "criterion_id"),
        ],
        "category": [
            _claim("category", "category_id", owners=1), _claim("categories_sum", "track", weight=points),
            _claim("category_weight", "category_id", bound=points), _claim("cap", "category_id", bound=points),
            _label("category", "category_id"),
        ],
        "action": [
            _claim("action", "action_id", owners=1), _claim("criterion", "criterion_id", users=1),
            _claim("anchor", "current_anchor", users=1), _claim("size", F.lit("action"), weight=1),
        ],
        "project": [
            _claim("project", "project_id", owners=1), _claim("track", "track", users=1),
            _claim("size", F.lit("project"), weight=1),
        ],
        "cap": [
            _claim("rule", "rule_id", owners=1),
            _claim("cap", F.when(overall, F.lit("overall")).otherwise(F.col("target_id")), top=F.col("cap_points")),
            F.when(
                overall & named.isin(*[f"{track}.{name}" for track, name in FIXED_CAPS]),
                _claim("fixed_cap", named, weight=F.col("cap_points")),
            ),
            _label("cap", "rule_id"),
        ],
        "route": [
            _claim("anchor", "route_id", owners=1), _claim("best_route", "track", top=F.col("points")),
            _label("anchor", "route_id"),
        ],
        "special": [_claim("rule", "rule_id", owners=1)],
        "band": [_label("band", "band")],
        "label": [
            F.when(F.trim("label") != "", _claim("label", F.concat_ws("|", "label_kind", "id"), owners=1)),
        ],
    }


def claims(tables: dict[str, DataFrame], rulesets: DataFrame) -> DataFrame:
    """What every rule row says about keys: (ruleset_id, space, key, owners, users, weight, top, bound)."""
    rows = row_claims()
    several = {  # claims from the items of an array in the row
        "project": F.transform("core_criterion_ids", lambda c: _claim("criterion", c, users=1)),
        "band": F.when(
            F.col("max_score") >= F.col("min_score"),
            F.transform(F.sequence("min_score", "max_score"), lambda n: _claim("score", n, users=1)),
        ),
    }
    parts = [rulesets.select(BY, F.inline(F.array(*constant_claims())))]
    for name, said in rows.items():
        # generated code makes the claims; a null one becomes a row without a space
        made = tables[name].select(BY, F.inline(F.array(*said)))
        parts.append(made.filter(F.col("space").isNotNull()))
        if name in several:
            parts.append(tables[name].select(BY, F.inline(several[name])))
    owned = tables["alias"].select(
        BY, F.when(F.col("case_sensitive"), F.col("alias")).otherwise(F.lower("alias")).alias("alias"), "subject"
    ).distinct()
    parts.append(owned.select(BY, F.inline(F.array(_claim("alias", "alias", users=1)))))
    return reduce(DataFrame.unionByName, parts)


def rule_violations(tables: dict[str, DataFrame], rulesets: DataFrame) -> DataFrame:
    """(ruleset_id, violation, id) of everything that breaks a check; a sound rule set has no row.

    ``tables``: the tables of :func:`rule_tables`, each with ``ruleset_id``. ``rulesets``: all rule sets, so that one
    without any row in a table is found as well.
    """
    gathered = claims(tables, rulesets).groupBy(BY, "space", "key").agg(
        F.sum("owners").alias("owners"), F.sum("users").alias("users"), F.sum("weight").alias("weight"),
        F.max("top").alias("top"), F.max("bound").alias("bound"),
    )
    breaks = {code: (F.col("space") == space) & F.expr(when) for code, space, when in CHECKS}
    broken = F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in breaks.items()]))
    # few rows break a check, so all others leave before the list of broken checks is made
    odd = gathered.filter(reduce(Column.__or__, breaks.values()))
    return odd.select(BY, F.explode(broken).alias("violation"), F.col("key").alias("id"))
