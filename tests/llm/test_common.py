import gc
import time

from pyspark.sql import functions as F

from symloom.llm.common import _CLEANUP_SETTING, _manage, give_back, materialize


def full_collections(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))


def test_a_heap_that_grew_is_collected_and_a_small_one_is_not(spark):
    runtime, allocate = spark._jvm.java.lang.Runtime.getRuntime(), spark._jvm.java.nio.ByteBuffer.allocate
    spark._jvm.java.lang.System.gc()
    before = full_collections(spark)
    held = []
    while runtime.totalMemory() <= 0.55 * runtime.maxMemory():
        held.append(allocate(32 << 20))
    assert materialize(spark.range(3), "few").count() == 3
    assert full_collections(spark) > before
    held.clear()
    spark._jvm.java.lang.System.gc()
    if runtime.totalMemory() < 0.4 * runtime.maxMemory():
        before = full_collections(spark)
        materialize(spark.range(3), "few")
        assert full_collections(spark) == before


def test_a_collected_heap_keeps_little_more_than_what_lives(spark):
    runtime, allocate = spark._jvm.java.lang.Runtime.getRuntime(), spark._jvm.java.nio.ByteBuffer.allocate
    held = [allocate(32 << 20) for _ in range(int(0.3 * runtime.maxMemory()) >> 25)]
    more = []
    while runtime.totalMemory() <= 0.6 * runtime.maxMemory():
        more.append(allocate(32 << 20))
    more.clear()
    gc.collect()
    time.sleep(2)  # the gateway lets go of them by and by
    try:
        give_back(spark)
        live = runtime.totalMemory() - runtime.freeMemory()
        assert len(held) and runtime.totalMemory() < 1.6 * live
    finally:
        for option, percent in (("MaxHeapFreeRatio", 70), ("MinHeapFreeRatio", 40)):
            _manage(spark, "HotSpotDiagnostic", "setVMOption", option, str(percent))


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    found = set()
    while files.hasNext():
        if (name := files.next().getName()).startswith("shuffle_"):
            found.add(name)
    return found


def test_a_stored_table_leaves_no_shuffle_behind(spark):
    before = shuffle_files(spark)
    setting = spark.conf.get(_CLEANUP_SETTING, None)
    stored = materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert spark.conf.get(_CLEANUP_SETTING, None) == setting
    for _ in range(50):  # executors are told, not waited for
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    assert not left and stored.count() == 7
