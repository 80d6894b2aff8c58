"""Payment events as a stream: exactly-once unlocking and checkout attempts with a timeout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.checkouts import checkout_replies
from attesta.operators.entitlement import STALE_SECONDS, fulfil
from attesta.operators.ordering import cut
from attesta.streaming.batches import key_rows, tagged
from attesta.streaming.keylog import KeyLog
from attesta.streaming.tables import keys_of, names, read_batch, run_available, write_batch

OUTCOME = (
    "event_id long, reference string, transaction_id string, paid_at timestamp, outcome string"
)


#: Outcomes that a later delivery of the same event cannot change.
FINAL = ("unlocked", "idempotent", "conflict")
LOGGED = "reference string, transaction_id string"


def once_per_event(batch: DataFrame) -> DataFrame:
    """One row per event: the earliest one, where rows of an event differ."""
    rest = [c for c in batch.columns if c not in ("event_id", "paid_at")]
    first = F.min(F.struct("paid_at", *rest)).alias("e")
    return batch.groupBy("event_id").agg(first).select("event_id", "e.*").select(*batch.columns)


def table_now(table: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    return table() if callable(table) else table


def unlock(
    events: DataFrame, payments: DataFrame | Callable[[], DataFrame], assessments: DataFrame | Callable[[], DataFrame],
    out: str, checkpoint: str,
) -> None:
    """Apply success events to payments. Outcomes go to ``out``, one folder per batch: a ledger with one row per
    delivery of an event that is not decided yet.

    Only ``unlocked``, ``idempotent`` and ``conflict`` are final: later deliveries of such an event add nothing, by
    its ID and never by its age. An event that found no payment or no completed run is answered anew when the
    provider delivers it again, so a payment row that comes late still unlocks. ``payments`` and ``assessments`` may
    be functions, which every batch calls for the tables as they are then.

    Earlier batches are looked up in one key log: decided events, paid references and used transactions.
    """
    keys = keys_of(out)
    kinds = {"event": F.col("event_id").cast("string"), "reference": "reference", "transaction": "transaction_id"}

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = KeyLog(batch.sparkSession, f"{keys}/events", LOGGED, batch_id)
        first = once_per_event(batch)
        earlier = log.before(key_rows(first, kinds))
        decided = earlier.filter(F.col("key").startswith("event ")).select("key")
        fresh = first.join(decided, tagged("event", kinds["event"]) == F.col("key"), "left_anti")
        paid = earlier.filter(~F.col("key").startswith("event ")).select(
            F.col("reference").alias("provider_reference"), F.col("transaction_id").alias("paid_id")
        ).distinct()
        current = (
            table_now(payments).join(paid, "provider_reference", "left")
            .withColumn("provider_transaction_id", F.coalesce("provider_transaction_id", "paid_id"))
            .withColumn("status", F.when(F.col("paid_id").isNotNull(), "SUCCEEDED").otherwise(F.col("status")))
        )
        write_batch(fulfil(fresh, current, table_now(assessments)).select(*names(OUTCOME)), out, batch_id)
        final = read_batch(batch.sparkSession, out, batch_id, OUTCOME).filter(F.col("outcome").isin(*FINAL))
        events_of = final.select(tagged("event", kinds["event"]).alias("key"), *names(LOGGED))
        unlocked = final.filter(F.col("outcome") == "unlocked")
        paid_now = key_rows(unlocked, {t: kinds[t] for t in ("reference", "transaction")}).select("key", *names(LOGGED))
        log.add(events_of.unionByName(paid_now))

    run_available(events, handle, checkpoint)


def latest_outcomes(ledger: DataFrame) -> DataFrame:
    """(event_id, outcome) of every event: the final one, or the latest while none is."""
    return ledger.groupBy("event_id").agg(F.max_by("outcome", "batch").alias("outcome"))


def step(status: str, updated: int, attempts: int, kind: str, now: int) -> tuple[str, int, int, str | None]:
    """One change of an owner's checkout: new status, time, attempt count and the reply to a checkout."""
    stale = status == "INITIALIZING" and now - updated >= STALE_SECONDS * 1_000_000
    if kind == "checkout":
        if status == "SUCCEEDED":
            return status, updated, attempts, "already_unlocked"
        if status == "INITIALIZED":
            return status, updated, attempts, "existing_initialized"
        if status == "INITIALIZING" and not stale:
            return status, updated, attempts, "initializing"
        return "INITIALIZING", now, attempts + 1, "created"
    moves = {
        ("INITIALIZING", "initialized"): "INITIALIZED",
        ("INITIALIZING", "failed"): "INITIALIZATION_FAILED",
        ("INITIALIZING", "succeeded"): "SUCCEEDED",
        ("INITIALIZED", "succeeded"): "SUCCEEDED",
    }
    target = moves.get((status, kind))
    return (target, now, attempts, None) if target else (status, updated, attempts, None)


REPLY = "owner long, event_id long, outcome string"
CHECKOUT = "owner long, status string, updated_us long, in_batch long"


def follow_checkouts(changes: DataFrame, out: str, checkpoint: str) -> None:
    """Replies to checkouts per owner. ``changes``: owner, event_id, ts, kind.

    Every micro-batch applies its changes in time order to the states that earlier ones left; ``step`` is the rule of
    one change. A stale attempt is seen when the next checkout looks at its age, so no timer and no watermark is
    needed and a late checkout is answered as well. An event that a batch holds twice is answered once.
    """
    keys = keys_of(out)
    key = F.col("owner").cast("string").alias("key")

    def handle(batch: DataFrame, batch_id: int) -> None:
        log = KeyLog(batch.sparkSession, f"{keys}/owners", CHECKOUT, batch_id, newest="in_batch")
        once = cut(batch.groupBy("owner", "event_id").agg(F.min(F.struct("ts", "kind")).alias("c")).select("owner", "event_id", "c.*"))
        replies, states = checkout_replies(once, log.before(once.select(key)))
        write_batch(replies.select(*names(REPLY)), out, batch_id)
        log.add(states.withColumn("in_batch", F.lit(batch_id).cast("long")).select(key, *names(CHECKOUT)))

    run_available(changes, handle, checkpoint)
