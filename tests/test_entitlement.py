from datetime import datetime, timedelta

from attesta.operators import entitlement as N
from attesta.streaming.events import step, unlock

START = datetime(2026, 1, 1)


EVENT = "event_id long, reference string, transaction_id string, paid_at timestamp, amount_minor int, currency string"


def payments_of(spark, rows):
    """Payments that fit the product: (payment, reference, status, stored transaction)."""
    p = N.PRODUCT
    full = [
        (pid, pid, "u", p["product_id"], p["billing_model"], p["provider"], ref, p["amount_minor"], p["currency"], status, tx)
        for pid, ref, status, tx in rows
    ]
    return spark.createDataFrame(
        full, "payment_id string, assessment_id string, owner_user_id string, product_id string, billing_model string, provider string, "
        "provider_reference string, amount_minor int, currency string, status string, provider_transaction_id string",
    )


def assessments_of(spark, **states):
    return spark.createDataFrame([(k, o, s) for k, (o, s) in states.items()], "assessment_id string, owner_user_id string, run_state string")


def event(i, ref, tx, minutes=None, amount=15900, currency="ZAR"):
    return (i, ref, tx, START + timedelta(minutes=i if minutes is None else minutes), amount, currency)


def test_fulfilment(spark):
    pairs = [("r1", "t1"), ("r1", "t1"), ("r1", "t2"), ("r2", "t1"), ("r2", "t3"), ("r9", "t9"), ("r3", "t5"), ("r3", "t6"), ("r4", "t7")]
    events = [event(i, *p) for i, p in enumerate(pairs)]
    events += [event(9, "r5", "a", amount=1), event(10, "r5", "a", currency="USD"), event(11, "r5", "a"), event(12, "r6", "b"), event(13, "r7", "c"), event(14, "r8", "d")]
    payments = payments_of(spark, [
        ("p1", "r1", "INITIALIZED", None), ("p2", "r2", "INITIALIZING", None), ("p3", "r3", "SUCCEEDED", "t5"), ("p4", "r4", "INITIALIZATION_FAILED", None),
        ("p5", "r5", "INITIALIZED", None), ("p6", "r6", "INITIALIZED", None), ("p7", "r7", "INITIALIZED", None), ("p8", "r8", "INITIALIZED", None),
    ])
    done = ("u", "COMPLETED")
    known = assessments_of(spark, p1=done, p2=done, p3=done, p4=done, p5=done, p6=("u", "RUNNING"), p7=("other", "COMPLETED"))
    got = [r.outcome for r in N.fulfil(spark.createDataFrame(events, EVENT), payments, known).orderBy("event_id").collect()]
    assert got == [
        "unlocked", "idempotent", "conflict", "conflict", "unlocked", "not_found", "idempotent", "conflict", "conflict",
        "conflict", "conflict", "unlocked", "not_completed", "conflict", "not_found",
    ]


def test_late_and_repeated_events_are_answered_once(spark, tmp_path):
    """One file per batch; the last event is two hours older than all before it."""
    deliveries = [[event(1, "r1", "a", 120)], [event(2, "r2", "b", 121), event(1, "r1", "a", 120)], [event(3, "r2", "b", 122)], [event(4, "r3", "c", 0), event(4, "r3", "c", 0)]]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in deliveries:
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    payments = payments_of(spark, [(f"p{i}", f"r{i}", "INITIALIZED", None) for i in (1, 2, 3)])
    known = assessments_of(spark, **{f"p{i}": ("u", "COMPLETED") for i in (1, 2, 3)})
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    unlock(stream, payments, known, out, str(tmp_path / "checkpoint"))
    got = sorted((r.event_id, r.outcome) for r in spark.read.parquet(out).collect())
    assert got == [(1, "unlocked"), (2, "unlocked"), (3, "idempotent"), (4, "unlocked")]
    unlock(stream, payments, known, out, str(tmp_path / "again"))  # a replay of all batches changes nothing
    assert sorted((r.event_id, r.outcome) for r in spark.read.parquet(out).collect()) == got


def test_attempt_states(spark):
    changes = {
        "a": ["created"], "b": ["created", "initialized", "failed", "succeeded"], "c": ["created", "failed", "succeeded"],
        "d": ["initialized", "created", "failed"], "e": ["failed"],
    }
    rows = [(k, i, c) for k, cs in changes.items() for i, c in enumerate(cs)]
    got = {r.payment_id: r.state for r in N.attempt_states(spark.createDataFrame(rows, "payment_id string, seq long, change string")).collect()}
    assert got == {"a": "INITIALIZING", "b": "SUCCEEDED", "c": "INITIALIZATION_FAILED", "d": "INITIALIZATION_FAILED"}


def test_checkout_steps():
    state, replies = ("NONE", 0, 0), []
    seconds = 1_000_000
    for kind, at in (("checkout", 0), ("checkout", 29), ("checkout", 30), ("failed", 31), ("checkout", 32), ("initialized", 33), ("checkout", 900), ("succeeded", 901), ("checkout", 902)):
        *state, reply = step(*state, kind, at * seconds)
        replies.append(reply)
    assert [r for r in replies if r] == ["created", "initializing", "created", "created", "existing_initialized", "already_unlocked"]


def test_claims(spark):
    claims = spark.createDataFrame(
        [(1, 7, "u1", "h", START), (2, 7, "u1", "h", START + timedelta(1)), (3, 7, "u2", "h", START + timedelta(2)), (4, 8, "u1", "bad", START), (5, 9, "u1", "h", START)],
        "claim_id long, assessment_id long, user_id string, presented_hash string, claimed_at timestamp",
    )
    known = spark.createDataFrame([(7, None, "h", None), (8, None, "h", None)], "assessment_id long, owner_user_id string, claim_token_hash string, expires_at timestamp")
    got = {r.claim_id: r.status for r in N.apply_claims(claims, known).collect()}
    assert got == {1: "claimed", 2: "idempotent", 3: "conflict", 4: "token_invalid", 5: "not_found"}
