import glob
import os

from corpuslens.storage import CLEANUP, release, shared_folder, stored


def shuffle_files():
    return set(glob.glob("/tmp/blockmgr-*/**/shuffle_*", recursive=True))


def test_a_stored_job_leaves_no_shuffle_file_and_no_setting(spark):
    spark.conf.unset(CLEANUP)
    grouped = spark.range(100_000).selectExpr("id % 1000 as k").groupBy("k").count()
    before = shuffle_files()
    grouped.write.format("noop").mode("overwrite").save()
    assert {f for f in shuffle_files() - before if os.path.getsize(f) > 1000}  # as a plain job does
    before = shuffle_files()
    kept = stored(grouped)
    assert kept.count() == 1000 and spark.conf.get(CLEANUP, None) is None
    assert not {f for f in shuffle_files() - before if os.path.getsize(f) > 1000}
    spark.conf.set(CLEANUP, "false")
    stored(spark.range(10))
    assert spark.conf.get(CLEANUP) == "false"
    spark.conf.unset(CLEANUP)


def test_release_deletes_the_table(spark):
    kept = stored(spark.range(10))
    path = kept._stored_at
    assert path.startswith(shared_folder(spark)) and os.path.isdir(path)
    release(kept, spark.range(3))
    assert not os.path.exists(path)
