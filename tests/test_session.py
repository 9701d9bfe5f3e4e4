import time

from pyspark.sql import functions as F

from tidemill.session import SHUFFLE_CLEANUP, stage


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i).getName() for i in range(files.size())]
    return {name for name in names if name.startswith("shuffle_")}


def test_what_a_staged_result_shuffled_is_deleted_with_its_job(spark):
    before = shuffle_files(spark)
    spark.range(500).repartition(3, "id").write.format("noop").mode("overwrite").save()
    assert shuffle_files(spark) - before  # as other jobs leave them
    before = shuffle_files(spark)
    source = spark.range(500).withColumn("k", F.col("id") % 7).repartition(3, "k")
    staged = stage(source.groupBy("k").count(), "counts")
    for _ in range(100):  # executors are told, not waited for
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    # Only of this job: those of before may go at any time.
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == "false"
    assert staged.count() == source.groupBy("k").count().count() == 7
