import os
from pathlib import Path

import pytest

from lakewarden import session


class Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class Session:
    def __init__(self, **values):
        self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})


def test_shared_folder_is_the_configured_one():
    one = Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")
    assert session.checkpoint_root(one) == "hdfs://x/y"
    a, b = session.work_folder(one, "p"), session.work_folder(one, "p")
    assert a != b and a.startswith("hdfs://x/y/lakewarden/p-")


def test_a_cluster_needs_the_setting():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session(spark_master="yarn"))


def test_a_local_session_may_do_without():
    local = Session(spark_master="local[2]")
    assert session.checkpoint_root(local) == session.checkpoint_root(local)


def test_sweep_deletes_old_working_folders(spark):
    old, new = (session.work_folder(spark, n) for n in ("old", "new"))
    for folder in (old, new):
        spark.range(1).write.parquet(f"{folder}/part")
    for path in [*Path(old).rglob("*"), Path(old)]:
        os.utime(path, (1, 1))
    names = session.sweep(spark, 24 * 365)
    assert Path(old).name in names and Path(new).name not in names
    assert not Path(old).exists() and Path(new).exists()
