"""Run history: writing a run tree, reading it back, comparing and merging runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.urls import normalize_submitted_url
from attesta.operators.ordering import number_in_ranges

SOURCE_FIELDS = (
    "source_id", "source_type", "submitted_by_candidate", "access_status", "ownership_status",
    "retrieved_at", "content_hash", "extractor_version", "locator", "notes",
)
EVIDENCE_FIELDS = (
    "evidence_id", "source_id", "locator", "fact_type", "subject", "explicit_text",
    "evidence_level", "attribution_status", "rule_id", "review_status",
)
RUN_FIELDS = (
    "assessment_id", "state", "error_code", "pipeline_version", "contract_version",
    "rubric_version", "track", "assessment_input", "scoring_context", "result", "review_flags", "stages",
)
CONTEXT_FIELDS = ("contract_version", "rubric_version", "track", "criterion_bindings", "rule_triggers", "review_flags", "project_exclusion_ids")
RESULT_FIELDS = (
    "track", "categories", "criteria", "category_caps", "raw_total", "overall_caps", "applicable_overall_cap",
    "final_score", "band", "strengths", "material_gaps", "project_id", "qa_status",
)
# Versions of the contract and rubric, and the stages of a run in their order.
CONTRACT, RUBRIC = "1.2.0", "V2"
STAGES = (
    "validate_input", "verify_cv_hash", "extract_cv", "retrieve_links", "normalize_evidence", "classify_higher_order",
    "assemble_scoring_context", "score_assessment",
)
#: The stage a run ends with by its error code; all others reach the last one.
ENDS_WITH = {"EVIDENCE_NORMALIZATION_FAILED": "normalize_evidence"}
DOCUMENT_FIELDS = ("document_id", "storage_path", "original_filename", "media_type", "sha256", "byte_size")


def with_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``run_id`` and the fields; one that the table does not have is null."""
    return df.select("run_id", *[F.col(f) if f in df.columns else F.lit(None).cast("string").alias(f) for f in fields])


def canonical_json(columns: list[str]) -> Column:
    """JSON text with sorted keys; equal values give equal text."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def content_hash(columns: list[str]) -> Column:
    return F.sha2(canonical_json(columns), 256)


def row_digest(columns: list[str]) -> Column:
    """Two independent 64-bit hashes of a row's canonical JSON."""
    text = canonical_json(columns)
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def given_id(prefix: str, *columns: str) -> Column:
    """An ID that follows from a row's values, so a repeated batch gives the same one."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 12))


def group_digest(hash_col: str = "_h") -> Column:
    """Digest of a group of rows that does not depend on their order.

    Sums and a count merge in partial aggregation, so a group of any size stays one row per task.
    """
    total = lambda part: F.sum(F.col(f"{hash_col}.{part}").cast("decimal(38,0)"))
    return F.concat_ws("-", F.count(F.lit(1)), total("a"), total("b"))


def run_digests(runs: DataFrame, sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """One digest per run over all fields that make two runs equal: its own, its sources' and its evidence's."""
    own = with_fields(runs, RUN_FIELDS).select("run_id", content_hash(list(RUN_FIELDS)).alias("own"))
    child = lambda df, fields, name: (
        with_fields(df, fields).select("run_id", row_digest(list(fields)).alias("_h"))
        .groupBy("run_id")
        .agg(group_digest().alias(name))
    )
    return (
        own.join(child(sources, SOURCE_FIELDS, "sources_digest"), "run_id", "left")
        .join(child(evidence, EVIDENCE_FIELDS, "evidence_digest"), "run_id", "left")
        .select(
            "run_id",
            F.sha2(F.concat_ws("|", "own", F.coalesce("sources_digest", F.lit("")), F.coalesce("evidence_digest", F.lit(""))), 256).alias("digest"),
        )
    )


def document_hash(documents: DataFrame) -> DataFrame:
    """(run_id, document_hash) over all fields of a run's document."""
    return with_fields(documents, DOCUMENT_FIELDS).select("run_id", content_hash(list(DOCUMENT_FIELDS)).alias("document_hash"))


def merge_runs(incoming: DataFrame, existing: DataFrame, order: str = "run_id") -> DataFrame:
    """Outcome of writing runs one after the other: inserted, noop for an identical replay, conflict otherwise.

    Both sides: run_id, assessment_id, candidate_ref, track, document_hash, digest; ``order`` gives the sequence of
    the incoming rows. An assessment belongs to the candidate, track and document of its first run, stored or incoming;
    a run that differs from them is a conflict. A run written again has to be equal to the first one.
    """
    known = existing.groupBy("assessment_id").agg(F.min_by(belongs(), "run_id").alias("known"))
    return merge_into(incoming, existing, known.select("assessment_id", "known.*"), order)


def belongs() -> Column:
    """What all runs of an assessment share."""
    return F.struct("candidate_ref", "track", "document_hash")


def merge_into(incoming: DataFrame, stored_runs: DataFrame, assessments: DataFrame, order: str) -> DataFrame:
    """``merge_runs`` against stored runs (run_id, assessment_id, digest) and what their assessments belong to
    (assessment_id, candidate_ref, track, document_hash), each once; rows of other keys do no harm.

    The first row of an assessment and of a run come from aggregations, so neither a frequent assessment nor a run
    that is replayed very often meets in one task.
    """
    own = belongs()
    stored = stored_runs.select(
        "run_id", F.col("assessment_id").alias("old_assessment"), F.col("digest").alias("old_digest"), F.lit(True).alias("is_stored")
    )
    known = assessments.select("assessment_id", own.alias("known"))
    rows = incoming.join(stored, "run_id", "left").join(known, "assessment_id", "left")
    unseen = rows.filter("is_stored IS NULL")
    begins = unseen.groupBy("run_id").agg(F.min(order).alias("begin"))
    opened = (
        unseen.filter("known IS NULL").join(begins, "run_id").filter(F.col(order) == F.col("begin"))
        .groupBy("assessment_id").agg(F.min_by(own, order).alias("opened"))
    )
    judged = rows.join(opened, "assessment_id", "left").withColumn(
        "fits", F.coalesce("known", "opened").eqNullSafe(own)
    )
    place = F.struct(F.col(order).alias("at"), F.col("assessment_id"), F.col("digest"))
    written = judged.filter("is_stored IS NULL AND fits").groupBy("run_id").agg(F.min(place).alias("written"))
    same = lambda assessment, digest: (
        (F.col(assessment) == F.col("assessment_id")) & F.col(digest).eqNullSafe(F.col("digest"))
    )
    status = (
        F.when(~F.col("fits"), "conflict")
        .when(F.col("is_stored"), F.when(same("old_assessment", "old_digest"), "noop").otherwise("conflict"))
        .when(F.col("written.at") == F.col(order), "inserted")
        .when(same("written.assessment_id", "written.digest"), "noop")
        .otherwise("conflict")
    )
    return judged.join(written, "run_id", "left").select(*incoming.columns, status.alias("status"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last written run per assessment: an aggregate, so frequent assessments cost no sort."""
    return runs.groupBy("assessment_id").agg(
        F.max_by(F.struct("run_id", "state"), F.struct("created_at", "run_id")).alias("r")
    ).select("assessment_id", F.col("r.run_id").alias("latest_run_id"), F.col("r.state").alias("state"))


def latest_run_join(assessments: DataFrame, runs: DataFrame) -> DataFrame:
    """Assessments with the run their pointer names."""
    named = runs.select(F.col("run_id").alias("latest_run_id"), "state", "created_at")
    return assessments.join(named, "latest_run_id")


def run_tree(facts: DataFrame, sources: DataFrame, outcomes: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a batch of runs."""
    head = runs.join(outcomes, "run_id")
    return {
        "assessments": runs.select("run_id", "track"),
        "documents": with_fields(
            runs.withColumns({"document_id": F.concat(F.lit("doc-"), "run_id"), "sha256": F.col("cv_hash")}), DOCUMENT_FIELDS
        ),
        "runs": with_fields(head, ("assessment_id", *RUN_FIELDS[1:], "final_score", "band")),
        "sources": with_fields(sources, SOURCE_FIELDS),
        "evidence": with_fields(facts, EVIDENCE_FIELDS),
    }


def stored_runs(runs: DataFrame, bindings: DataFrame, context: DataFrame, scored: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Run rows with what the batch found out about them: scoring context and result as canonical JSON, flags, stages.

    A run that failed before its context was made has none, and only a completed run has a result. A context holds 26
    criterion bindings; the evidence behind them is in rows (``binding.binding_evidence``), for it grows with the run.
    JSON texts are far longer than the stored columns they are made of, so a join must not judge them by those and send
    them all through the driver: hints keep them in shuffles.
    """
    per_run = bindings.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("criterion_id", "anchor", "n_evidence"))).alias("criterion_bindings")
    )
    versions = {"contract_version": F.lit(CONTRACT), "rubric_version": F.lit(RUBRIC)}
    contexts = context.join(per_run, "run_id").withColumns(versions).select(
        "run_id", "review_flags", canonical_json(list(CONTEXT_FIELDS)).alias("scoring_context")
    )
    results = scored.select("run_id", canonical_json(list(RESULT_FIELDS)).alias("result"))
    length = F.lit(len(STAGES))
    for code, stage in ENDS_WITH.items():
        length = F.when(F.col("error_code") == code, STAGES.index(stage) + 1).otherwise(length)
    rows = (
        runs.join(outcomes.select("run_id", "state", "error_code", "final_score", "band"), "run_id")
        .join(contexts.hint("merge"), "run_id", "left").join(results.hint("merge"), "run_id", "left")
        .withColumns(versions)
        .withColumns({
            "result": F.when(F.col("state") == "COMPLETED", F.col("result")),
            "review_flags": F.coalesce("review_flags", F.array().cast("array<string>")),
            "stages": F.slice(F.array(*[F.lit(s) for s in STAGES]), F.lit(1), length),
        })
    )
    return with_fields(rows, (*RUN_FIELDS, "final_score", "band"))


def ordered_rows(children: DataFrame, keys: list[str], order: list[str], name: str = "child_no") -> DataFrame:
    """Children with their position under their key. Keys with any number of children are split over tasks."""
    return number_in_ranges(children, keys, order, name)


def run_children(tree: dict[str, DataFrame]) -> DataFrame:
    """Sources and evidence of all runs as rows: (run_id, part, child_no, child_id, body).

    ``body`` is the child's canonical JSON; positions follow the IDs. No run is gathered into one row.
    """
    def part(name: str, fields: tuple, key: str) -> DataFrame:
        return with_fields(tree[name], fields).select(
            "run_id", F.lit(name).alias("part"), F.col(key).alias("child_id"), canonical_json(list(fields)).alias("body")
        )

    rows = part("sources", SOURCE_FIELDS, "source_id").unionByName(part("evidence", EVIDENCE_FIELDS, "evidence_id"))
    return ordered_rows(rows, ["run_id", "part"], ["child_id", "body"]).select("run_id", "part", "child_no", "child_id", "body")


def write_children(children: DataFrame, path: str) -> None:
    """Append children so that each file holds a range of runs in reading order; a lookup by run reads few files."""
    order = ["run_id", "part", "child_no"]
    children.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(path)


def write_run_tree(tree: dict[str, DataFrame], path: str) -> None:
    """Append the tables of a run tree below a folder."""
    for name, table in tree.items():
        table.write.mode("append").parquet(f"{path}/{name}")


def read_run_tree(spark, path: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{path}/{name}")
        for name in ("assessments", "documents", "runs", "sources", "evidence")
    }


def run_with_children(tree: dict[str, DataFrame]) -> DataFrame:
    """Runs with sources ordered by ID, evidence ordered by ID and their document."""
    def ordered(name: str, fields: tuple, key: str) -> DataFrame:
        cols = [key, *[f for f in fields if f != key]]
        return tree[name].groupBy("run_id").agg(
            F.array_sort(F.collect_list(F.struct(*cols))).alias(name)
        )

    return (
        tree["runs"]
        .join(ordered("sources", SOURCE_FIELDS, "source_id"), "run_id", "left")
        .join(ordered("evidence", EVIDENCE_FIELDS, "evidence_id"), "run_id", "left")
        .join(tree["documents"], "run_id", "left")
    )


def canonical_links(links: DataFrame) -> DataFrame:
    """Links without later copies of a URL; a copy of another type makes the run ambiguous.

    ``links``: run_id, link_ord, link_id, submitted_url, declared_type.
    """
    keyed = links.withColumn("normalized_url", normalize_submitted_url(F.col("submitted_url")))
    valid = keyed.filter(F.col("normalized_url").isNotNull())
    merged = valid.groupBy("run_id", "normalized_url").agg(
        F.min_by(F.struct("link_ord", "link_id", "submitted_url", "declared_type"), "link_ord").alias("l"),
        (F.min("declared_type") != F.max("declared_type")).alias("ambiguous"),
    )
    odd = keyed.filter(F.col("normalized_url").isNull())
    columns = ["run_id", "link_ord", "link_id", "submitted_url", "declared_type"]
    return merged.select("run_id", "l.*", "ambiguous").unionByName(
        odd.select(*columns, F.lit(False).alias("ambiguous"))
    )


def run_state_consistent() -> Column:
    """Which parts of a run have to be there in its state."""
    done = (
        F.col("error_code").isNull() & F.col("result").isNotNull() & F.col("context").isNotNull()
        & (F.col("n_flags") == 0)
    )
    review = (
        F.col("error_code").isNotNull() & F.col("result").isNull() & F.col("context").isNotNull()
        & (F.col("n_flags") >= 1)
    )
    failed = F.col("error_code").isNotNull() & F.col("result").isNull()
    return (
        F.when(F.col("state") == "COMPLETED", done)
        .when(F.col("state") == "REVIEW_REQUIRED", review)
        .when(F.col("state").isin("NOT_SCORABLE", "ASSESSMENT_PIPELINE_FAILED"), failed)
        .otherwise(False)
    )


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def by_key(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one key; the filter reaches the scan."""
    return df.filter(F.col(column) == F.lit(value))
