from pyspark.sql import functions as F

from attesta.operators import store


def test_results_do_not_pass_through_the_driver(spark, tmp_path, capsys):
    """The JSON of a result is far longer than the stored columns a join would judge it by."""
    runs = spark.createDataFrame([(1, "t")], "run_id long, track string")
    outcomes = spark.createDataFrame(
        [(1, "COMPLETED", None, 5, "b")], "run_id long, state string, error_code string, final_score int, band string"
    )
    bindings = spark.createDataFrame([(1, "c", "a", 1)], "run_id long, criterion_id string, anchor string, n_evidence long")
    context = spark.createDataFrame(
        [(1, "t", [], [], [])],
        "run_id long, track string, rule_triggers array<string>, review_flags array<string>, project_exclusion_ids array<string>",
    )
    scored = spark.range(1, 2).select(
        F.col("id").alias("run_id"), *[F.lit("x").alias(c) for c in store.RESULT_FIELDS if c != "run_id"]
    )
    scored.write.parquet(f"{tmp_path}/scored")
    rows = store.stored_runs(runs, bindings, context, spark.read.parquet(f"{tmp_path}/scored"), outcomes)
    rows.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert rows.first()["result"].startswith("{")
