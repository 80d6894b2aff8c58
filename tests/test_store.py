import json

from pyspark.sql import functions as F

from attesta.operators import store
from attesta.plans.assessment import assess
from tests.test_assessment import SOURCES, cv


def batch_of(spark):
    blocks = cv(spark, ["Built a REST API in Python", "Java and SQL"]).unionByName(cv(spark, ["Likes long walks"], run=2))
    sources = spark.createDataFrame([(r, "cv", 0, "cv", True, "accessible", "attributed") for r in (1, 2)], SOURCES)
    sources = sources.withColumn("locator", F.lit("page 1")).withColumn("content_hash", F.lit("0"))
    runs = blocks.select("run_id", "track").distinct().withColumn("cv_hash", F.lit("0" * 64)).withColumn("links_ok", F.lit(True))
    return runs, sources, assess(runs, sources, blocks)


def test_context_and_result_are_stored(spark):
    runs, _, batch = batch_of(spark)
    stored = store.stored_runs(runs, batch.bindings, batch.context, batch.scored, batch.outcomes)
    states = stored.withColumns({"context": F.col("scoring_context"), "n_flags": F.size("review_flags")})
    assert states.filter(~store.run_state_consistent()).count() == 0
    wanted = {r.run_id: r for r in batch.scored.collect()}
    for row in stored.collect():
        context = json.loads(row.scoring_context)
        assert set(context) == set(store.CONTEXT_FIELDS) and len(context["criterion_bindings"]) == 26
        assert list(row.stages) == list(store.STAGES)
        if row.state == "COMPLETED":
            result = json.loads(row.result)
            assert set(result) == set(store.RESULT_FIELDS)
            assert result["final_score"] == wanted[row.run_id].final_score == row.final_score


def test_failed_and_held_runs(spark):
    """A run that failed early has neither context nor result; one under review has flags and no result."""
    runs, _, batch = batch_of(spark)
    outcomes = batch.outcomes.withColumn("state", F.when(F.col("run_id") == 1, "ASSESSMENT_PIPELINE_FAILED").otherwise("REVIEW_REQUIRED"))
    outcomes = outcomes.withColumn("error_code", F.when(F.col("run_id") == 1, "EVIDENCE_NORMALIZATION_FAILED").otherwise("REVIEW_REQUIRED"))
    context = batch.context.filter("run_id = 2").withColumn("review_flags", F.array(F.lit("TRACK_MISMATCH")))
    rows = {r.run_id: r for r in store.stored_runs(runs, batch.bindings, context, batch.scored, outcomes).collect()}
    assert rows[1].scoring_context is None and rows[1].result is None and rows[1].review_flags == [] and rows[1].stages[-1] == "normalize_evidence"
    assert rows[2].result is None and rows[2].review_flags == ["TRACK_MISMATCH"] and len(rows[2].stages) == 8


def test_children_of_a_large_run_stay_rows(spark, tmp_path):
    n = 5000
    evidence = spark.range(n).select(
        F.when(F.col("id") < n - 3, 1).otherwise(2).alias("run_id"), F.format_string("ev-%05d", "id").alias("evidence_id"), F.lit("cv").alias("source_id")
    )
    sources = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "a")], "run_id int, source_id string")
    children = store.run_children({"sources": sources, "evidence": evidence})
    assert "collect" not in children._jdf.queryExecution().optimizedPlan().toString().lower()
    store.write_children(children, str(tmp_path / "children"))
    kept = spark.read.parquet(str(tmp_path / "children"))
    assert kept.filter("run_id = 1 AND part = 'sources'").orderBy("child_no").select("child_no", "child_id").collect() == [(1, "a"), (2, "b")]
    assert kept.filter("run_id = 2 AND part = 'sources'").agg(F.max("child_no")).first()[0] == 2  # copies keep a place each
    numbered = kept.filter("run_id = 1 AND part = 'evidence'").orderBy("child_no").collect()
    assert [r.child_no for r in numbered] == list(range(1, n - 2)) and [r.child_id for r in numbered] == [f"ev-{i:05d}" for i in range(n - 3)]
    assert json.loads(numbered[0].body)["evidence_id"] == "ev-00000"
    assert store.run_children({"sources": sources.limit(0), "evidence": evidence.limit(0)}).count() == 0
