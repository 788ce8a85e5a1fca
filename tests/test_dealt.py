from pyspark.sql import functions as F

from kalends.plans.tables import dealt


def test_a_file_of_many_splits_and_one_row_group_is_dealt_to_many_tasks(spark, tmp_path):
    where = str(tmp_path / "one.parquet")
    spark.range(0, 40_000, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).write.parquet(where)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200_000)
    try:
        read = spark.read.parquet(where)
        sizes = lambda df: [n for n in df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
        assert read.rdd.getNumPartitions() >= 4 and len(sizes(read)) == 1
        out = sizes(dealt(read))
        assert sum(out) == 40_000 and max(out) <= 40_000 / 16
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
