import pytest
from pyspark.sql import functions as F

from attesta.operators import binding, classify, evidence, qa, report, scoring
from attesta.plans.assessment import assess
from attesta.registry.rubric_values import NO_PROJECT
from attesta.registry.tables import DA, SE

BLOCKS = (
    "run_id int, track string, source_id string, source_ord int, source_type string, "
    "ownership_status string, accessible boolean, block_ord int, block_id string, locator string, text string"
)
SOURCES = (
    "run_id int, source_id string, source_ord int, source_type string, submitted_by_candidate boolean, "
    "access_status string, ownership_status string"
)


def cv(spark, texts, track=SE, run=1, source=("cv", "cv", "attributed")):
    name, kind, owner = source
    return spark.createDataFrame(
        [(run, track, name, 0 if kind == "cv" else 1, kind, owner, True, i, f"b{i}", f"page 1, block {i}", t) for i, t in enumerate(texts)],
        BLOCKS,
    )


def facts_of(spark, texts, **kw):
    rows = evidence.normalize_evidence(cv(spark, texts, **kw)).orderBy("fact_no").collect()
    return [(r.subject, r.fact_type, r.evidence_level) for r in rows]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Wrote a Django service with Java", [("django", "tool_application", "documented"), ("java", "skill_application", "documented")]),
        ("Java, Django and Docker", [("java", "skill_name", "named_only"), ("django", "tool_name", "named_only"), ("docker", "tool_name", "named_only")]),
        ("Fluent in Java", [("java", "skill_name", "named_only")]),
        ("Likes long walks", []),
    ],
)
def test_one_sentence(spark, text, expected):
    assert facts_of(spark, [text]) == expected


def test_long_block_quotes_the_match(spark):
    rows = evidence.normalize_evidence(cv(spark, ["x " * 150 + "Python"])).collect()
    assert rows[0].explicit_text == "Python"


def test_stronger_copy_takes_the_first_place(spark):
    link = cv(spark, ["Built tools in Python", "Java"], source=("src-1", "repository", "attributed"))
    both = cv(spark, ["Built tools in Python", "SQL"]).unionByName(link)
    rows = evidence.normalize_evidence(both).orderBy("fact_no").collect()
    assert [(r.subject, r.evidence_level, r.source_id, r.evidence_id) for r in rows] == [
        ("python", "demonstrated", "src-1", "ev-0001"), ("sql", "named_only", "cv", "ev-0002"), ("java", "named_only", "src-1", "ev-0003"),
    ]


def test_links_yield_no_qualification_but_it_still_silences_the_sentence(spark):
    link = cv(spark, ["BSc in Python", "Java"], source=("src-1", "repository", "unclear"))
    assert [r.subject for r in evidence.normalize_evidence(link).collect()] == ["java"]


def test_run_over_the_fact_limit_fails_whole(spark):
    many = cv(spark, ["Python SQL Java " * 20] * 90, run=1).unionByName(cv(spark, ["Python"], run=2))
    assert {r.run_id for r in evidence.normalize_evidence(many).collect()} == {2}


def derived(spark, texts, track=SE):
    blocks = cv(spark, texts, track=track)
    sentences = evidence.with_qualification_hits(evidence.scan_sentences(blocks))
    facts = evidence.normalize_evidence(blocks, None, sentences)
    rows = classify.derived_facts(classify.source_summary(blocks), sentences, facts).orderBy("fact_no").collect()
    return [r.subject for r in rows], rows


def test_project_sentences(spark):
    names, _ = derived(spark, ["Built project at https://example.com/x", "Built a Flask API in Python"])
    assert {"cv_project_reference", "se_technical_process", "se_technical_depth_ownership"} <= set(names)


def test_label_only_sentence_has_no_behaviour(spark):
    names, _ = derived(spark, ["Team player", "Collaborated with the team player group"])
    assert names.count("collaboration") == 1


def test_opposite_target_flags_and_own_target_clears(spark):
    runs = spark.createDataFrame([(1, SE)], "run_id int, track string")
    _, rows = derived(spark, ["Seeking data analyst roles"])
    assert classify.track_mismatch(spark.createDataFrame(rows), runs).count() == 1
    _, rows = derived(spark, ["Seeking data analyst roles", "Seeking software engineer roles"])
    assert classify.track_mismatch(spark.createDataFrame(rows), runs).count() == 0


def test_screenshot_goes_when_its_source_has_context(spark):
    alone, _ = derived(spark, ["Dashboard screenshot"], DA)
    explained, _ = derived(spark, ["Dashboard screenshot", "Dashboard for a business question"], DA)
    assert "context_free_dashboard_screenshot" in alone
    assert "context_free_dashboard_screenshot" not in explained


def test_numbering_goes_on_after_technical_facts(spark):
    _, rows = derived(spark, ["Summary", "Built a Flask API in Python"])
    assert [r.fact_no for r in rows] == list(range(4, 4 + len(rows)))


def score(spark, track, bound, flags=(), triggers=(), link=False):
    bindings = spark.createDataFrame([(1, c, a, n) for c, a, n in bound], "run_id int, criterion_id string, anchor string, n_evidence long")
    criteria = binding.default_registry().criterion_rows()
    missing = [
        (1, c[1], ("se" if track == SE else "da") + ".qual.none" if c[6] == "qualification_routes" else "missing_unverifiable", 0)
        for c in criteria if c[0] == track and c[1] not in {b[0] for b in bound}
    ]
    every = bindings.unionByName(spark.createDataFrame(missing, bindings.schema))
    context = spark.createDataFrame(
        [(1, track, list(triggers), list(flags), [], False)],
        "run_id int, track string, rule_triggers array<string>, review_flags array<string>, project_exclusion_ids array<string>, python_explicit boolean",
    )
    sources = spark.createDataFrame([(1, "s", 0, "project" if link else "cv", True, "accessible", "unclear")], SOURCES)
    rows = scoring.score_runs(every, context, sources).withColumn("cv_hash", F.lit("x")).withColumn("links_ok", F.lit(True))
    return qa.run_checks(rows).collect()


def test_power_bi_point_and_recorded_caps(spark):
    (r,) = score(spark, DA, [("da.tools.power_bi_alignment", "named_only", 1)])
    assert (r.raw_total, r.final_score, r.applicable_overall_cap) == (1, 1, 79)
    assert [(c.category_id, c.cap) for c in r.category_caps] == [("da.projects", 6)]
    assert r.qa_status == "PASS" and r.band == "limited_application_evidence"


def test_nothing_scores_zero_with_cap(spark):
    (r,) = score(spark, SE, [])
    assert (r.final_score, r.applicable_overall_cap) == (0, 59)
    assert r.material_gaps[0].criterion_id == "se.core.programming_language"
    assert r.project_id == "se.project.01_operations_workflow"


def test_qualification_alone(spark):
    (r,) = score(spark, SE, [("se.alignment.qualification", "se.qual.completed", 1)])
    assert (r.raw_total, r.final_score, r.applicable_overall_cap) == (10, 10, 59)


def test_full_marks_need_a_link(spark):
    full = [(c[1], "se.qual.completed" if c[6] == "qualification_routes" else "demonstrated", 1) for c in binding.default_registry().criterion_rows() if c[0] == SE]
    (r,) = score(spark, SE, full, link=True)
    assert (r.final_score, r.band, r.project_id, len(r.strengths)) == (100, "strong_application_evidence", NO_PROJECT, 5)
    (r,) = score(spark, SE, full)
    assert r.final_score == 93 and r.qa_status == "PASS"


def test_sheets_ceiling(spark):
    (r,) = score(spark, DA, [("da.core.spreadsheets", "demonstrated", 1)], triggers=[binding.SHEETS_CEILING])
    assert r.raw_total == 5


def test_blocking_flag_gives_no_score(spark):
    assert score(spark, DA, [], flags=["MATERIAL_SOURCE_CONTRADICTION"]) == []


def test_band_edges(spark):
    df = spark.createDataFrame([(s,) for s in (0, 39, 40, 59, 60, 79, 80, 100)], "s int")
    assert [r.b[:4] for r in df.select(scoring.band_for(F.col("s")).alias("b")).collect()] == ["limi", "limi", "foun", "foun", "deve", "deve", "stro", "stro"]


def test_percent_rounds_halves_up(spark):
    df = spark.createDataFrame([(5, 8), (1, 3), (1, 200)], "s int, m int")
    assert [r.p for r in df.select(report.whole_percent(F.col("s"), F.col("m")).alias("p")).collect()] == [63, 33, 1]


def test_qualification_routes(spark):
    runs = spark.createDataFrame([(1, SE)], "run_id int, track string")

    def route(texts):
        facts = evidence.normalize_evidence(cv(spark, texts))
        rows = binding.best_route(binding.qualification_facts(facts, runs)).collect()
        return rows[0].anchor if rows else None

    assert route(["BSc Computer Science completed"]) == "se.qual.completed"
    assert route(["BSc Informatics, expected 2030"]) == "se.qual.in_progress"
    assert route(["BSc Informatics completed", "Diploma in Informatics, in progress"]) == "se.qual.completed"
    assert route(["BSc Informatics completed, in progress", "BSc Informatics completed"]) == "se.qual.none"
    assert route(["Bootcamp", "Built a Flask API"]) == "se.qual.bootcamp"
    assert route(["Diploma in arts"]) is None


def test_whole_batch_keeps_every_run(spark):
    texts = ["Summary", "Built a Flask API in Python", "Skills", "Seeking software engineer roles"]
    blocks = cv(spark, texts, run=1).unionByName(cv(spark, ["Seeking data analyst roles"], run=2)).unionByName(cv(spark, ["Python SQL Java " * 20] * 90, run=3))
    runs = spark.createDataFrame([(i, SE, "h", True) for i in (1, 2, 3)], "run_id int, track string, cv_hash string, links_ok boolean")
    sources = spark.createDataFrame([(i, "cv", 0, "cv", True, "accessible", "attributed") for i in (1, 2, 3)], SOURCES)
    batch = assess(runs, sources, blocks)
    states = {r.run_id: (r.state, r.error_code) for r in batch.outcomes.collect()}
    assert states == {1: ("COMPLETED", None), 2: ("REVIEW_REQUIRED", "REVIEW_REQUIRED"), 3: ("ASSESSMENT_PIPELINE_FAILED", "EVIDENCE_NORMALIZATION_FAILED")}
    actions = scoring.priority_actions(batch.scored)
    assert actions.count() == 5 and report.action_mismatches(actions).count() == 0
    assert report.result_shape_errors(batch.scored).count() == 0


def test_tables_are_made_when_they_are_asked_for(spark, monkeypatch):
    from attesta.plans import assessment

    written, write = [], assessment.cut

    def counted(df):
        written.append(set(df.columns))
        return write(df)

    monkeypatch.setattr(assessment, "cut", counted)
    runs = spark.createDataFrame([(1, SE, "h", True)], "run_id int, track string, cv_hash string, links_ok boolean")
    sources = spark.createDataFrame([(1, "cv", 0, "cv", True, "accessible", "attributed")], SOURCES)
    batch = assess(runs, sources, cv(spark, ["Built a Django service with Java"]))
    assert written == []
    assert batch.technical.count() == 2 and not any("criteria" in columns or "review_flags" in columns for columns in written)
    steps = len(written)
    assert batch.technical.count() == 2 and len(written) == steps
    assert [r.state for r in batch.outcomes.collect()] == ["COMPLETED"]
    assert sum("criteria" in columns for columns in written) == 1
    # the levels of the criteria and the facts that count are written once and not computed again by each reader
    assert sum({"criterion_id", "best_rank"} <= columns for columns in written) == 1


def test_claims_are_specific_from_six_words(spark):
    texts = ["Built it with Java on time", "Built it with Java today", "Built it with Java on\ttime again", None, ""]
    rows = [(1, f"p{i}", "skill_application", t) for i, t in enumerate(texts)]
    facts = spark.createDataFrame(rows, "run_id int, locator string, fact_type string, explicit_text string")
    found = classify.claim_specificity(facts).collect()
    assert [(r.applications, r.places, r.qualifying, r.level) for r in found] == [(5, 5, 2, "demonstrated")]
