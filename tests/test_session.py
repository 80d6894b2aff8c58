from attesta import session


def test_no_task_gets_a_whole_row_group(spark, tmp_path):
    """A file of one row group has many splits, of which one holds all rows."""
    rows = 20 * session.TASK_ROWS
    spark.range(rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        dealt = session.read_table(spark, str(tmp_path), "documents")
        sizes = dealt.rdd.glom().map(len).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == rows and max(sizes) <= 1.1 * session.TASK_ROWS


def test_empty_table(spark, tmp_path):
    spark.range(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert session.read_table(spark, str(tmp_path), "pages").count() == 0
