import random
from datetime import datetime, timedelta

from attesta.operators.sources import retrievals_as_of
from attesta.plans.assessment import assess
from attesta.registry.tables import SE
from tests.test_assessment import cv

START = datetime(2026, 1, 1)
LINK = "run_id int, source_id string, locator string, assessed_at timestamp"
RETRIEVAL = "locator string, retrieved_at timestamp, access_status string, content_hash string"
SOURCE = (
    "run_id int, source_id string, source_ord int, source_type string, submitted_by_candidate boolean, "
    "access_status string, ownership_status string, content_hash string, locator string"
)


def at(hour):
    return START + timedelta(hours=hour)


def test_latest_retrieval_not_later_than_the_run(spark):
    """One locator holds half of all rows; times and rows repeat."""
    rng = random.Random(14)
    place = lambda: rng.choice(["hot"] * 10 + [f"u{i}" for i in range(10)])
    links = [(i, "s", place() if rng.random() < 0.95 else None, at(rng.randint(0, 30))) for i in range(300)]
    retrievals = [(place(), at(rng.randint(0, 30)), rng.choice(["accessible", "inaccessible"]), str(rng.randint(0, 9))) for _ in range(200)]
    retrievals += retrievals[:20]
    expected = {}
    for run, _, locator, when in links:
        seen = [(t, s, h) for place_, t, s, h in retrievals if place_ == locator and t <= when]
        if seen:
            expected[run] = max(seen)
    rows = retrievals_as_of(spark.createDataFrame(links, LINK), spark.createDataFrame(retrievals, RETRIEVAL)).collect()
    assert {r.run_id: tuple(r.latest) for r in rows} == expected and len(rows) == len(expected)
    empty = spark.createDataFrame([], RETRIEVAL)
    assert retrievals_as_of(spark.createDataFrame(links, LINK), empty).collect() == []


def test_a_later_retrieval_changes_the_outcome(spark):
    """The same link, read before and after it was opened, by two runs that differ in their time only."""
    blocks, sources, runs = None, [], []
    for run, hour in ((1, 2), (2, 6)):
        mine = cv(spark, ["Summary", "Seeking software engineer roles"], run=run).unionByName(
            cv(spark, ["Built a Flask API in Python", "Built a Java service with Docker"], run=run, source=("src-1", "repository", "attributed"))
        )
        blocks = mine if blocks is None else blocks.unionByName(mine)
        sources += [
            (run, "cv", 0, "cv", True, "accessible", "attributed", "h", "page 1"),
            (run, "src-1", 1, "repository", True, "accessible", "attributed", None, "https://r.example.com/x"),
        ]
        runs.append((run, SE, "h", True, at(hour)))
    retrievals = spark.createDataFrame(
        [("https://r.example.com/x", at(1), "inaccessible", None), ("https://r.example.com/x", at(4), "accessible", "c1")], RETRIEVAL
    )
    batch = assess(
        spark.createDataFrame(runs, "run_id int, track string, cv_hash string, links_ok boolean, assessed_at timestamp"),
        spark.createDataFrame(sources, SOURCE), blocks, link_retrievals=retrievals,
    )
    scores = {r.run_id: r.final_score for r in batch.outcomes.collect()}
    facts = {(r.run_id, r.source_id) for r in batch.facts.collect()}
    assert scores[2] > scores[1] and (2, "src-1") in facts and (1, "src-1") not in facts
