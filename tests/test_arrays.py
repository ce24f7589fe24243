"""Tables written to cut lineage."""

import time
from pathlib import Path

from handprint.functions import arrays


def test_shuffle_files_go_when_the_table_is_written(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    folders = [Path(p) for p in env.blockManager().diskBlockManager().localDirsString()]

    def held():
        return {f for d in folders for f in d.rglob("shuffle_*.data")}
    before, cleanup = held(), spark.conf.get(arrays.CLEANUP, None)
    out = arrays.write_table(spark.range(20000).repartition(3, "id"), "cleanup")
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before
    assert spark.conf.get(arrays.CLEANUP, None) == cleanup
    assert out.count() == 20000
