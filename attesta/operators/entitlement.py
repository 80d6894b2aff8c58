"""Claims, payments and report access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip
from attesta.operators.ordering import first_of_both

# The one approved product.
PRODUCT = {
    "catalog_version": "1.0.0", "status": "approved", "product_id": "readiness_report_v1",
    "billing_model": "one_time", "amount_minor": 15900, "currency": "ZAR", "provider": "paystack",
}
SUCCESS_EVENT = "charge.success"
STALE_SECONDS = 30
ACTIVE = ("INITIALIZING", "INITIALIZED")


def usable_email(col: Column) -> Column:
    """Trimmed address with an @ and no blank, else null."""
    trimmed = strip(col)
    return F.when((trimmed != "") & trimmed.contains("@") & ~trimmed.contains(" "), trimmed)


def product_approved() -> Column:
    """All seven fields of a product equal the approved ones."""
    same = F.lit(True)
    for name, value in PRODUCT.items():
        same = same & F.col(name).eqNullSafe(F.lit(value))
    return same


def expired(expires_at: Column, at: Column) -> Column:
    return F.coalesce(expires_at <= at, F.lit(False))


def stale_attempt(status: Column, updated_at: Column, at: Column) -> Column:
    """An attempt that never left INITIALIZING within the limit."""
    return (status == "INITIALIZING") & (
        F.unix_micros(at) - F.unix_micros(updated_at) >= STALE_SECONDS * 1_000_000
    )


def parse_rfc3339(col: Column) -> Column:
    """Time of a text with a date, a T and a zone; null for anything else."""
    text = strip(col)
    shaped = text.rlike(r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})\z")
    return F.when(shaped, F.try_to_timestamp(text))


def claim_status() -> Column:
    """Outcome of a claim joined with its assessment.

    Columns: found, owner_user_id, user_id, claim_token_hash, presented_hash, expires_at, claimed_at.
    """
    return (
        F.when(~F.col("found"), "not_found")
        .when(F.col("owner_user_id") == F.col("user_id"), "idempotent")
        .when(F.col("owner_user_id").isNotNull(), "conflict")
        .when(~F.col("claim_token_hash").eqNullSafe(F.col("presented_hash")) | F.col("claim_token_hash").isNull(), "token_invalid")
        .when(expired(F.col("expires_at"), F.col("claimed_at")), "expired")
        .otherwise("claimed")
    )


def apply_claims(claims: DataFrame, assessments: DataFrame) -> DataFrame:
    """Decide a batch of claims: the first valid one per assessment sets the owner.

    The winner of each assessment is found by aggregation, so an assessment that many claim at once
    needs no window over all its claims.
    """
    joined = claims.join(
        assessments.select(
            "assessment_id", "owner_user_id", "claim_token_hash", "expires_at", F.lit(True).alias("found")
        ),
        "assessment_id",
        "left",
    ).withColumn("found", F.coalesce("found", F.lit(False)))
    first = joined.withColumn("own_status", claim_status())
    winners = (
        first.filter(F.col("own_status") == "claimed")
        .groupBy("assessment_id")
        .agg(F.min_by(F.struct("claim_id", "user_id", "claimed_at"), F.struct("claimed_at", "claim_id")).alias("w"))
    )
    decided = first.join(winners, "assessment_id", "left")
    later = F.struct("claimed_at", "claim_id") > F.struct("w.claimed_at", "w.claim_id")
    status = (
        F.when(F.col("w").isNull() | ~later, F.col("own_status"))
        .when(F.col("w.user_id") == F.col("user_id"), "idempotent")
        .otherwise("conflict")
    )
    return decided.select("claim_id", "assessment_id", "user_id", status.alias("status"))


def report_access() -> Column:
    """Why an unlocked report may not be read, null when it may."""
    return (
        F.when(~F.col("found"), "ASSESSMENT_NOT_FOUND")
        .when(~F.col("owner_user_id").eqNullSafe(F.col("user_id")), "ASSESSMENT_NOT_OWNED")
        .when(F.col("access_state") != "UNLOCKED", "REPORT_LOCKED")
        .when(~F.col("run_state").eqNullSafe(F.lit("COMPLETED")), "ASSESSMENT_NOT_COMPLETED")
    )


def payment_matches() -> Column:
    """Payment, assessment and verified event agree on all fields of the product."""
    return (
        (F.col("owner_user_id") == F.col("assessment_owner"))
        & (F.col("product_id") == PRODUCT["product_id"])
        & (F.col("billing_model") == PRODUCT["billing_model"])
        & (F.col("provider") == PRODUCT["provider"])
        & (F.col("provider_reference") == F.col("event_reference"))
        & (F.col("amount_minor") == PRODUCT["amount_minor"])
        & (F.col("event_amount") == PRODUCT["amount_minor"])
        & (F.col("currency") == PRODUCT["currency"])
        & (F.col("event_currency") == PRODUCT["currency"])
    )


def latest_succeeded(payments: DataFrame) -> DataFrame:
    """Last successful payment per assessment and product; unknown times come last."""
    return (
        payments.filter(F.col("status") == "SUCCEEDED")
        .groupBy("assessment_id", "product_id")
        .agg(
            F.max_by(
                F.struct("payment_id", "paid_at"),
                F.struct(F.col("paid_at").isNotNull(), "paid_at", "payment_id"),
            ).alias("p")
        )
        .select("assessment_id", "product_id", "p.payment_id", "p.paid_at")
    )


def active_violations(payments: DataFrame) -> DataFrame:
    """Assessment and product pairs with more than one open attempt."""
    return (
        payments.filter(F.col("status").isin(*ACTIVE))
        .groupBy("assessment_id", "product_id")
        .agg(F.count(F.lit(1)).alias("n_active"))
        .filter(F.col("n_active") > 1)
    )


def webhook_events(raw: DataFrame, body: str = "body") -> DataFrame:
    """Success events with their reference; other events are only acknowledged."""
    name = F.get_json_object(body, "$.event")
    reference = F.get_json_object(body, "$.data.reference")
    answer = (
        F.when(name.isNull(), "rejected")
        .when(name != SUCCESS_EVENT, "acknowledged")
        .when(F.coalesce(strip(reference) == "", F.lit(True)), "rejected")
        .otherwise("fulfil")
    )
    return raw.withColumn("event", name).withColumn("reference", reference).withColumn("answer", answer)


def fulfil(events: DataFrame, payments: DataFrame, assessments: DataFrame) -> DataFrame:
    """Outcome of verified success events on their payments.

    ``events``: event_id, reference, transaction_id, paid_at, amount_minor, currency. ``payments``: payment_id,
    assessment_id, owner_user_id, product_id, billing_model, provider, provider_reference, amount_minor, currency,
    status, provider_transaction_id. ``assessments``: assessment_id, owner_user_id, run_state (of the latest run).

    In this order: no payment or no assessment is not_found; a field that differs from the product, or a
    transaction that another payment carries, is a conflict; an assessment whose latest run is not completed is
    not_completed. Then the first event of a payment unlocks it, the same transaction again changes nothing, and
    another transaction on a paid row is a conflict.
    """
    keyed = payments.select(
        F.col("provider_reference").alias("reference"), "payment_id", "assessment_id", "owner_user_id", "product_id",
        "billing_model", "provider", "provider_reference", "amount_minor", "currency", "status",
        F.col("provider_transaction_id").alias("stored_id"),
    )
    known = assessments.select(
        "assessment_id", F.col("owner_user_id").alias("assessment_owner"), "run_state", F.lit(True).alias("known")
    )
    owner = payments.filter(F.col("provider_transaction_id").isNotNull()).select(
        F.col("provider_transaction_id").alias("transaction_id"), F.col("payment_id").alias("other_id")
    )
    verified = events.select(
        "event_id", "reference", "transaction_id", "paid_at", F.col("reference").alias("event_reference"),
        F.col("amount_minor").alias("event_amount"), F.col("currency").alias("event_currency"),
        F.struct("paid_at", "event_id").alias("place"),
    )
    taken = F.col("other_id").isNotNull() & (F.col("other_id") != F.col("payment_id"))
    early = (
        F.when(F.col("payment_id").isNull() | F.col("known").isNull(), "not_found")
        .when(~F.coalesce(payment_matches(), F.lit(False)), "conflict")
        .when(taken, "conflict")
        .when(~F.col("run_state").eqNullSafe(F.lit("COMPLETED")), "not_completed")
        .when(F.col("stored_id") == F.col("transaction_id"), "idempotent")
        .when(F.col("stored_id").isNotNull() | ~F.col("status").isin(*ACTIVE), "conflict")
    )
    joined = (
        verified.join(keyed, "reference", "left")
        .join(known, "assessment_id", "left")
        .join(owner, "transaction_id", "left")
        .select("event_id", "reference", "transaction_id", "paid_at", "place", early.alias("early"))
    )
    winners = first_of_both(joined.filter(F.col("early").isNull()), "place", "reference", "transaction_id").select(
        "reference", F.col("place").alias("won_place"), F.col("transaction_id").alias("won_id")
    )
    outcome = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(F.col("place") == F.col("won_place"), "unlocked")
        .when(F.col("transaction_id") == F.col("won_id"), "idempotent")
        .otherwise("conflict")
    )
    return joined.join(winners, "reference", "left").select(
        "event_id", "reference", "transaction_id", "paid_at", outcome.alias("outcome")
    )


def attempt_states(changes: DataFrame) -> DataFrame:
    """State of each payment attempt after its changes; a change that is not allowed is ignored.

    ``changes``: payment_id, seq, change (created, initialized, failed, succeeded). Only the first
    change of each kind after the creation can matter, so minima per attempt decide it and no
    ordered fold over an attempt is needed.
    """
    created = changes.filter(F.col("change") == "created").groupBy("payment_id").agg(
        F.min("seq").alias("created")
    )
    at = lambda kind: F.min(
        F.when((F.col("change") == kind) & (F.col("seq") > F.col("created")), F.col("seq"))
    )
    firsts = changes.join(created, "payment_id").groupBy("payment_id").agg(
        *[at(k).alias(k) for k in ("initialized", "failed", "succeeded")]
    )
    never = F.lit(2**62)
    i, f, s = (F.coalesce(k, never) for k in ("initialized", "failed", "succeeded"))
    state = (
        F.when((f < i) & (f < s), "INITIALIZATION_FAILED")
        .when(s < never, "SUCCEEDED")
        .when(i < never, "INITIALIZED")
        .otherwise("INITIALIZING")
    )
    return firsts.select("payment_id", state.alias("state"))
