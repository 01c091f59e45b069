import os
import time

from graphloom.plans import store


def test_tables_are_stored_and_cleared(spark):
    df = store.stored(spark.range(5))
    assert df.count() == 5 and "parquet" in df._jdf.queryExecution().toString().lower()
    path = store._written[-1]
    assert os.path.isdir(path.removeprefix("file:"))
    kept, store._written[:] = store._written[:-1], [path]
    store.clear(spark)
    assert not os.path.isdir(path.removeprefix("file:")) and store._written == []
    store._written.extend(kept)


def test_shuffle_files_are_freed(spark, tmp_path):
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    old = spark.conf.get(key, None)
    held = spark.range(1000).repartition(3, "id")
    with store.freed(spark):
        held.write.parquet(str(tmp_path / "a"))
    assert spark.conf.get(key, None) in (old, "false") and spark.read.parquet(str(tmp_path / "a")).count() == 1000
    # Spark deletes them beside the next steps; count() above leaves a shuffle of its own.
    for _ in range(50):
        if files() <= before + 2:
            break
        time.sleep(0.1)
    assert files() <= before + 2
    held.write.parquet(str(tmp_path / "b"))
    assert files() > before + 2
