"""Checkout attempts: what each change of an owner's checkout meets, decided for all changes at once.

The rule, one change after the other by time and event: a checkout opens an attempt (INITIALIZING) unless the owner
has one that is younger than the limit or further on; ``initialized``, ``failed`` and ``succeeded`` move an open
attempt, and ``succeeded`` also an initialized one. A succeeded or initialized attempt stays what it is for all
checkouts. So a life has two parts.

* **Opening.** Until the first ``initialized`` or ``succeeded`` that meets an open attempt. An attempt is open exactly
  if the last earlier change among checkouts and failures is a checkout.
* **Done.** From there on the replies follow from two places, the end of the opening and the first success.

In the opening, a checkout after a failure, after nothing, or at least the limit after the one before it opens an
attempt. Between such places lie crowds of checkouts less than the limit apart. There each checkout points at the first
one that is the limit later, and the attempts are those that pointers lead to from the crowd's first one. They are
found by doubling the pointers, in as many rounds as the number of attempts of a crowd has binary digits.

No owner meets in one task: what came last before a change is looked up inside range partitions and carried over
between them (``last_before``), pointers are found inside time steps of the length of the limit, and the rest are
aggregates and equi joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.entitlement import STALE_SECONDS
from attesta.operators.ordering import cut

LIMIT = STALE_SECONDS * 1_000_000
#: Place of a change in its owner's life.
PLACE = ("us", "event_id")


def last_before(ranged: DataFrame, values: dict[str, Column], key: str = "owner") -> DataFrame:
    """The last non-null of each of ``values`` among the earlier rows of the key, as further columns.

    ``ranged`` carries ``_slot``, the number of its range partition by key and place. There is one small row per key
    and partition to carry values over.
    """
    inside = Window.partitionBy(key, "_slot").orderBy(*PLACE)
    earlier = Window.partitionBy(key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.select("*", *[v.alias(f"_own_{n}") for n, v in values.items()])
    place = F.struct(*PLACE)
    ends = own.groupBy(key, "_slot").agg(
        *[F.max_by(f"_own_{n}", F.when(F.col(f"_own_{n}").isNotNull(), place)).alias(f"_end_{n}") for n in values]
    )
    carried = ends.select(
        F.col(key), "_slot", *[F.last(f"_end_{n}", True).over(earlier).alias(f"_in_{n}") for n in values]
    )
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    looked = own.select("*", *[F.last(f"_own_{n}", True).over(before).alias(f"_here_{n}") for n in values])
    joined = looked.join(carried, [key, "_slot"])
    return joined.select(*ranged.columns, *[F.coalesce(f"_here_{n}", f"_in_{n}").alias(n) for n in values])


def in_ranges(rows: DataFrame, key: str = "owner") -> DataFrame:
    """Rows written in range partitions by key and place, with the partition's number."""
    return cut(rows.repartitionByRange(key, *PLACE).withColumn("_slot", F.spark_partition_id()))


def reached(starts: DataFrame, pointers: DataFrame) -> DataFrame:
    """All nodes that ``pointers`` (node, next) lead to from ``starts`` (node), the starts included."""
    jumps = []
    step = cut(pointers)
    while not step.isEmpty():
        jumps.append(step)
        further = step.select(F.col("node").alias("next"), F.col("next").alias("then"))
        step = cut(step.join(further, "next").select("node", F.col("then").alias("next")))
    found = starts
    for jump in reversed(jumps):
        landed = found.join(jump, "node").select(F.col("next").alias("node"))
        found = cut(found.unionByName(landed).distinct())
    return found


def crowd_pointers(crowd: DataFrame) -> DataFrame:
    """(node, next): the first checkout of the same crowd that is at least the limit later.

    ``crowd``: owner, crowd, us, node. Neighbours are less than the limit apart, so in time steps of that length the
    wanted one lies in the next step, or is the first one of the step after it.
    """
    step = F.floor(F.col("us") / LIMIT)
    place = F.struct("us", F.col("node.event_id").alias("event_id"), "node")
    targets = crowd.select("crowd", step.alias("step"), "us", F.lit(1).alias("side"), place.alias("target"), F.lit(None).cast(crowd.schema["node"].dataType).alias("node"))
    askers = crowd.select("crowd", (step + 1).alias("step"), (F.col("us") + LIMIT).alias("us"), F.lit(0).alias("side"), F.lit(None).cast(targets.schema["target"].dataType).alias("target"), "node")
    back = Window.partitionBy("crowd", "step").orderBy(F.desc("us"), F.desc("side"), F.desc("target.event_id"))
    looked = targets.unionByName(askers).withColumn("next", F.last("target", True).over(back)).filter("side = 0")
    firsts = targets.groupBy("crowd", (F.col("step") - 1).alias("step")).agg(F.min("target").alias("first"))
    return looked.join(firsts, ["crowd", "step"], "left").select(
        "node", F.coalesce("next", "first").getField("node").alias("next")
    ).filter(F.col("next").isNotNull())


def checkout_replies(changes: DataFrame, entry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Replies to checkouts (owner, event_id, outcome) and each owner's state after all changes (owner, status, updated_us).

    ``changes``: owner, event_id, ts, kind, with each event once. ``entry``: owner, status, updated_us before them;
    owners without a row start with nothing.
    """
    plain = changes.select("owner", "event_id", F.unix_micros("ts").alias("us"), "kind")
    known = entry.select("owner", "status", F.col("updated_us").alias("since"))
    rows = in_ranges(plain.join(known, "owner", "left").withColumn("status", F.coalesce("status", F.lit("NONE"))))
    kind = F.col("kind")
    place = F.struct(*PLACE)
    mark = F.when(kind.isin("checkout", "failed"), F.struct(kind.alias("kind"), F.col("us").alias("us"), place.alias("at")))
    met = last_before(rows, {"prior": mark})
    open_before = F.coalesce(F.col("prior.kind"), F.when(F.col("status") == "INITIALIZING", "checkout")) == "checkout"
    met = cut(met.withColumn("open", F.coalesce(open_before, F.lit(False))))

    first = lambda *conditions: F.min(F.when(reduce(lambda a, b: a & b, conditions), F.struct(*PLACE, "kind")))
    opening = F.col("status").isin("NONE", "INITIALIZING", "INITIALIZATION_FAILED")
    lives = met.groupBy("owner").agg(
        first(opening, F.col("open"), kind.isin("initialized", "succeeded")).alias("end"),
        first(kind == "failed").alias("first_failed"), F.any_value("status").alias("status"),
    )
    after = met.filter(kind == "succeeded").join(lives.drop("status", "first_failed"), "owner")
    done = ~opening | (F.col("end").isNotNull() & (F.struct(*PLACE, "kind") >= F.col("end")))
    successes = after.filter(done).groupBy("owner").agg(F.min(place).alias("success"))
    lives = cut(lives.join(successes, "owner", "left"))

    checkouts = met.filter(kind == "checkout").join(lives.drop("status"), "owner")
    here = F.struct(*PLACE)
    late = ~opening | (F.col("end").isNotNull() & (here > F.struct("end.us", "end.event_id")))
    succeeded = (F.col("status") == "SUCCEEDED") | F.coalesce(here > F.col("success"), F.lit(False))
    settled = checkouts.filter(late).select(
        "owner", "event_id", F.when(succeeded, "already_unlocked").otherwise("existing_initialized").alias("outcome")
    )

    def shadowed(us: Column, at: Column) -> Column:
        """Met by the attempt that was open before all changes, while that is young."""
        before_failure = F.col("first_failed").isNull() | (at < F.struct("first_failed.us", "first_failed.event_id"))
        return F.coalesce((F.col("status") == "INITIALIZING") & before_failure & (us < F.col("since") + LIMIT), F.lit(False))

    tried = checkouts.filter(~late).withColumn("young", shadowed(F.col("us"), here))
    prior = F.col("prior")
    starts = (
        prior.isNull() | (prior.kind == "failed") | shadowed(prior.us, prior["at"]) | (F.col("us") - prior.us >= LIMIT)
    )
    tried = tried.withColumn("starts", ~F.col("young") & starts)
    node = F.struct("owner", *PLACE).alias("node")
    begun = in_ranges(tried.filter(~F.col("young")).select("owner", *PLACE, "starts", node).drop("_slot"))
    grouped = last_before(begun, {"earlier": F.when(F.col("starts"), F.col("node"))})
    crowd = grouped.select("us", "node", "starts", F.when(F.col("starts"), F.col("node")).otherwise(F.col("earlier")).alias("crowd"))
    crowd = cut(crowd)
    large = crowd.filter(~F.col("starts")).select("crowd").distinct()
    pointers = crowd_pointers(crowd.join(large, "crowd", "left_semi"))
    opened = reached(crowd.filter("starts").select("node"), pointers).select("node.*", F.lit("created").alias("opened"))
    opened = cut(opened)
    answered = tried.join(opened, ["owner", *PLACE], "left").select(
        "owner", "event_id", F.coalesce("opened", F.lit("initializing")).alias("outcome")
    )

    ends = met.groupBy("owner").agg(
        F.max_by("kind", F.when(kind.isin("checkout", "failed"), place)).alias("last_kind"),
        F.coalesce(F.bool_or(F.col("open") & (kind == "failed")), F.lit(False)).alias("has_failed"),
        F.any_value("since").alias("since"),
    )
    latest = opened.groupBy("owner").agg(F.max("us").alias("opened_us"))
    exits = lives.join(ends, "owner").join(latest, "owner", "left")
    status = (
        F.when(F.col("success").isNotNull() | (F.col("status") == "SUCCEEDED"), "SUCCEEDED")
        .when(F.col("end").isNotNull() | (F.col("status") == "INITIALIZED"), "INITIALIZED")
        .when(F.col("last_kind") == "checkout", "INITIALIZING")
        .when(F.col("has_failed"), "INITIALIZATION_FAILED")
        .otherwise(F.col("status"))
    )
    states = exits.select("owner", status.alias("status"), F.coalesce("opened_us", "since").alias("updated_us"))
    return settled.unionByName(answered), states
