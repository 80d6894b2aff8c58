import random
from datetime import datetime, timedelta

import pytest

from attesta.operators import checkouts as C
from attesta.streaming.events import follow_checkouts, step

START = datetime(2026, 1, 1)
CHANGE = "owner long, event_id long, ts timestamp, kind string"
ENTRY = "owner long, status string, updated_us long"


def fold(changes, entry):
    """Replies and exit states, one change after the other."""
    state = {o: (s, u, 0) for o, s, u in entry}
    replies = {}
    for owner, event_id, ts, kind in sorted(changes, key=lambda c: (c[0], c[2], c[1])):
        status, updated, attempts = state.get(owner, ("NONE", 0, 0))
        now = (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)
        *after, reply = step(status, updated, attempts, kind, now)
        state[owner] = tuple(after)
        if reply:
            replies[owner, event_id] = reply
    return replies, state


def compare(spark, changes, entry=()):
    rows = spark.createDataFrame(changes, CHANGE).repartition(5)
    replies, states = C.checkout_replies(rows, spark.createDataFrame(list(entry), ENTRY))
    expected, after = fold(changes, entry)
    got = [(r.owner, r.event_id, r.outcome) for r in replies.collect()]
    assert {(o, e): x for o, e, x in got} == expected and len(got) == len(expected)
    for r in states.collect():
        status, updated, _ = after[r.owner]
        assert r.status == status, r
        if status == "INITIALIZING":
            assert r.updated_us == updated, r


def made(rng, owner, n, spread, kinds, first_id, at=0.0):
    rows = []
    for i in range(n):
        at += rng.choice([0, 0.000001, 1, 5, 10, 29.999999, 30, 31]) * spread
        rows.append((owner, first_id + i, START + timedelta(seconds=round(at, 6)), rng.choice(kinds)))
    return rows


def test_equals_the_fold(spark):
    rng = random.Random(8)
    changes, entry = [], []
    for owner in range(150):
        kinds = ["checkout"] * rng.choice([3, 10, 40]) + rng.choice([[], ["failed"], ["initialized"], ["failed", "succeeded"], ["failed", "failed", "initialized", "succeeded"]])
        changes += made(rng, owner, rng.randint(1, 40), rng.choice([0.1, 0.5, 1]), kinds, 1000 * owner)
        if rng.random() < 0.6:
            since = int((START - datetime(1970, 1, 1)) / timedelta(microseconds=1)) + rng.choice([-60, -30, -1, 0, 20, 200]) * 1_000_000
            entry.append((owner, rng.choice(["NONE", "INITIALIZING", "INITIALIZING", "INITIALIZED", "INITIALIZATION_FAILED", "SUCCEEDED"]), since))
    compare(spark, changes, entry)


def test_hot_owner_is_split(spark):
    """One owner holds a third of all changes, in a crowd whose attempts follow each other for hours."""
    rng = random.Random(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        hot = made(rng, 1, 3000, 0.4, ["checkout"] * 400 + ["failed"], 0)
        rest = [row for owner in range(2, 202) for row in made(rng, owner, 30, 1, ["checkout", "failed", "initialized"], owner * 10_000)]
        rows = C.in_ranges(spark.createDataFrame(hot + rest, CHANGE).selectExpr("owner", "event_id", "unix_micros(ts) AS us", "kind"))
        assert rows.filter("owner = 1").select("_slot").distinct().count() >= 2
        compare(spark, hot + rest)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_nothing(spark):
    replies, states = C.checkout_replies(spark.createDataFrame([], CHANGE), spark.createDataFrame([], ENTRY))
    assert replies.collect() == [] and states.collect() == []


@pytest.mark.parametrize("n", [3])
def test_stream_goes_on_from_stored_states(spark, tmp_path, n):
    """Batches are folded in their order, late changes and all; a change that a batch holds twice counts once."""
    rng = random.Random(10)
    changes = [row for owner in range(40) for row in made(rng, owner, 25, 0.5, ["checkout"] * 8 + ["failed", "initialized", "succeeded"], owner * 100)]
    parts = [[c for c in changes if c[1] % n == i] for i in range(n)]
    expected, state = {}, []
    for part in parts:
        replies, after = fold(part, state)
        expected |= replies
        state = [(o, *s[:2]) for o, s in ({o: (x, u) for o, x, u in state} | {o: s[:2] for o, s in after.items()}).items()]
        spark.createDataFrame(part + part[:3], CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    follow_checkouts(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = [(r.owner, r.event_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert {(o, e): x for o, e, x in got} == expected and len(got) == len(expected)
