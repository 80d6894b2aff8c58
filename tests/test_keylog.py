import os
from urllib.parse import unquote, urlparse

from pyspark.sql import functions as F

from attesta.streaming.events import latest_outcomes, unlock
from attesta.streaming.keylog import KeyLog, last_rows
from attesta.streaming.tables import write_batch
from tests.test_entitlement import EVENT, assessments_of, event, payments_of


def frame(spark, keys, batch):
    return spark.createDataFrame([(str(k), batch) for k in keys], "key string, n int")


def size_of(rows):
    """Bytes of the files that rows are read from."""
    files = rows.select(F.input_file_name().alias("f")).distinct().collect()
    return sum(os.path.getsize(unquote(urlparse(r.f).path)) for r in files)


def test_bytes_read_do_not_grow_with_the_batches(spark, tmp_path):
    """Twenty batches of two new keys each; every batch also asks for a key of the one before it."""
    read, rows_read = [], []
    for batch in range(20):
        log = KeyLog(spark, str(tmp_path), "n int", batch, bucket_rows=2, compact_every=4)
        keys = [2 * batch, 2 * batch + 1]
        found = log.before(frame(spark, keys + [2 * batch - 1], batch))
        read.append(size_of(found))
        rows = {(r.key, r.n) for r in found.collect()}
        rows_read.append(len(rows))
        assert not batch or (str(2 * batch - 1), batch - 1) in rows
        assert not rows & {(str(k), batch) for k in keys}
        log.add(frame(spark, keys, batch))
    assert log.n_rows == 38 and log.buckets >= 8
    assert max(read[10:]) <= 1.5 * max(read[:10]) and max(rows_read) <= 3 * 2 * 2


def test_retry_and_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(7):
        for attempt in range(2 if batch in (3, 4, 5) else 1):
            log = KeyLog(spark, path, "n int", batch, bucket_rows=2, compact_every=3)
            earlier = sorted((r.key, r.n) for r in log.before(frame(spark, range(50), batch)).collect())
            assert earlier == sorted((str(10 * b + i), b) for b in range(batch) for i in range(3)), (batch, attempt)
            log.add(frame(spark, [10 * batch + i for i in range(3)], batch))
    assert log.first > 0 and log.buckets >= 4


def test_newest_rows_and_null_keys(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in range(5):
        log = KeyLog(spark, path, "n int", batch, bucket_rows=1, compact_every=2, newest="n")
        found = {r.key: r.n for r in log.before(frame(spark, ["a", "b"], 0)).collect()}
        assert {k: v for k, v in found.items() if k in "ab"} == ({"a": batch - 1, "b": 0} if batch else {})
        rows = frame(spark, ["a"] + (["b"] if batch == 0 else [f"x{batch}"]), batch)
        log.add(rows.unionByName(spark.createDataFrame([(None, 9)], "key string, n int")))
    assert log.n_rows <= 8


def test_last_rows_looks_past_missing_batches(spark, tmp_path):
    path = str(tmp_path / "small")
    assert last_rows(spark, path, "n int", 0).collect() == [] and last_rows(spark, path, "n int", 3).collect() == []
    write_batch(spark.createDataFrame([(1,)], "n int"), path, 2)
    assert [r.n for r in last_rows(spark, path, "n int", 3).collect()] == [1]
    assert [r.n for r in last_rows(spark, path, "n int", 6).collect()] == [1]
    assert last_rows(spark, path, "n int", 2).collect() == []


def test_events_without_payment_or_run_are_answered_again(spark, tmp_path):
    """Deliveries before the payment row, before the completed run, after both, and once more."""
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    tables = [([], {}), ([("p1", "r1", "INITIALIZED", None)], {"p1": ("u", "RUNNING")})]
    tables += [([("p1", "r1", "INITIALIZED", None)], {"p1": ("u", "COMPLETED")})] * 3
    deliveries = [[event(1, "r1", "a")], [event(1, "r1", "a")], [event(1, "r1", "a"), event(1, "r1", "a", 9), event(3, "r9", "a")], [event(1, "r1", "a")], [event(2, "r1", "b")]]
    current = {}
    for rows, (payments, known) in zip(deliveries, tables):
        current["payments"], current["known"] = payments_of(spark, payments), spark.createDataFrame(
            [(k, *v) for k, v in known.items()], "assessment_id string, owner_user_id string, run_state string"
        )
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENT).parquet(source)
        unlock(stream, lambda: current["payments"], lambda: current["known"], out, checkpoint)
    ledger = spark.read.parquet(out)
    got = sorted((r.batch, r.event_id, r.outcome) for r in ledger.collect())
    assert got == [(0, 1, "not_found"), (1, 1, "not_completed"), (2, 1, "unlocked"), (2, 3, "not_found"), (4, 2, "conflict")]
    assert {r.event_id: r.outcome for r in latest_outcomes(ledger).collect()} == {1: "unlocked", 2: "conflict", 3: "not_found"}


def test_a_transaction_of_an_earlier_batch_cannot_pay_twice(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    payments = payments_of(spark, [("p1", "r1", "INITIALIZED", None), ("p2", "r2", "INITIALIZED", None)])
    done = ("u", "COMPLETED")
    known = assessments_of(spark, p1=done, p2=done)
    for rows in ([event(1, "r1", "a")], [event(2, "r2", "a")], [event(3, "r1", "a"), event(4, "r2", "b")]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    unlock(stream, payments, known, out, str(tmp_path / "checkpoint"))
    got = {r.event_id: r.outcome for r in spark.read.parquet(out).collect()}
    assert got == {1: "unlocked", 2: "conflict", 3: "idempotent", 4: "unlocked"}
