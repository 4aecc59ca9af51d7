"""Many small trajectory files are listed by few tasks."""
from pyspark.sql import functions as F

from epsgrid.session import scratch_path
from epsgrid.sources import readers, writers


def test_many_trajectories(spark):
    df = spark.range(400).select((F.col("id") % 80).alias("t"), F.col("id").cast("double").alias("o"))
    path = scratch_path(spark, "many-trajectories")
    writers.write_trajectories(df, path, "t", "o", "o", "o", "o")
    before, status = spark.conf.get(readers.LISTING), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("listing", "")
    got = readers.read_trajectories(spark, path, glob="*.txt").select("lat").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.lat for r in got) == [float(i) for i in range(400)] and spark.conf.get(readers.LISTING) == before
    jobs = [status.getJobInfo(j) for j in status.getJobIdsForGroup("listing")]
    tasks = [status.getStageInfo(s).numTasks for j in jobs for s in j.stageIds if status.getStageInfo(s)]
    assert max(tasks) <= min(4 * spark.sparkContext.defaultParallelism, 79)
