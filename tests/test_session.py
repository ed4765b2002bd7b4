import pytest

from postflow.session import RUNTIME_CONF, new_shared_path, shared_dir


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    def __init__(self, **conf):
        self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})


def test_shared_dir_is_the_one_the_cluster_names():
    session = Session(spark_checkpoint_dir="hdfs://host/shared/", spark_master="spark://host:7077")
    assert shared_dir(session) == "hdfs://host/shared"
    assert new_shared_path(session, "x").startswith("hdfs://host/shared/x-")


def test_shared_dir_is_local_only_in_local_mode():
    with pytest.raises(ValueError):
        shared_dir(Session(spark_master="yarn"))
    session = Session(spark_master="local[2]")
    assert shared_dir(session) == shared_dir(session)


def test_settings_are_applied(spark):
    for key, value in RUNTIME_CONF.items():
        assert spark.conf.get(key) == value
