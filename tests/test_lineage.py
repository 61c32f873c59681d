from __future__ import annotations

import os

import pytest

from postloom.operators import lineage
from postloom.operators.lineage import release, shared_dir, written


def test_written_tables_are_released(spark):
    x = written(spark.range(5).toDF("n"))
    path = x._postloom_path.removeprefix("file:")
    assert x.count() == 5 and os.path.isdir(path)
    y = written(x.where("n > 2"))
    release(x)
    assert not os.path.exists(path) and y.count() == 2
    release(y)
    release(y)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Unset:
        master = "spark://host:7077"

        def getConf(self):
            return {}

        class _jsc:
            @staticmethod
            def sc():
                class Sc:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isEmpty = staticmethod(lambda: True)

                        return Empty

                return Sc

    class Session:
        conf = {}
        sparkContext = Unset()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    assert lineage.shared_dir(spark)
