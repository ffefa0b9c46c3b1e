from pyspark.sql import functions as F

from tablecheck.session import checkpoint_dir, materialize


def test_materialize_reads_back_a_written_table(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v"))
    out = materialize(df.groupBy("k").agg(F.sum("v").alias("s")), "test-materialize")
    assert sorted(map(tuple, out.collect())) == sorted(
        (k, sum(v for v in range(1000) if v % 7 == k)) for k in range(7))
    # The result is a parquet scan under the shared checkpoint folder, not the lineage.
    files = out.inputFiles()
    assert files and all(checkpoint_dir(spark).rstrip("/").split(":")[-1] in f for f in files)
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_reading_back_runs_no_job(spark):
    sc = spark.sparkContext
    df = spark.range(10, numPartitions=1).select("id", F.array(F.struct(F.lit("a").alias("x"))).alias("nested"))
    sc.setJobGroup("read-back", "one write")
    try:
        out = materialize(df, "test-read-back")
        jobs = sc.statusTracker().getJobIdsForGroup("read-back")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
    assert out.dtypes == df.dtypes and all(f.nullable for f in out.schema)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, df.collect()))
