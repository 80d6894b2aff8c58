import time

from pyspark.sql import functions as F

from attesta.operators import qa


def test_secrets(spark):
    found = {
        "https://user:word@host": True, ":@": False, ": a@b": False, "a:b/c@d": False, ":x@": True,
        "Bearer abc": True, "xBearer abc": False, "bearer abc": False, "Bearer": False,
        "Traceback (most recent call last)": True, "Traceback": False, "": False, None: None,
    }
    rows = spark.createDataFrame([(t,) for t in found], "t string").select("t", qa.has_secret(F.col("t")).alias("s"))
    assert {r["t"]: r["s"] for r in rows.collect()} == found


def test_long_payload_is_read_once(spark):
    """Every colon used to be the start of a search to the next blank."""
    rows = spark.range(4).select(F.repeat(F.lit(":a"), 100_000).alias("t"))
    began = time.time()
    assert not rows.filter(qa.has_secret(F.col("t"))).count()
    assert time.time() - began < 20
