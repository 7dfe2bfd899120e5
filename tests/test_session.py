"""Shared-folder resolution when the session has no spark.checkpoint.dir."""

import pytest

from cdcmart.session import work_dir


class _Conf:
    def __init__(self, d):
        self.d = d

    def get(self, k, default=None):
        return self.d.get(k, default)

    def set(self, k, v):  # a running session rejects core configs
        raise AssertionError("must not set core config " + k)


class _SC:
    applicationId = "app-test"

    def __init__(self):
        self.dir = None

    def getConf(self):
        return _Conf({})

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, d):
        self.dir = d


class _Spark:
    def __init__(self):
        self.sparkContext = _SC()
        self.conf = _Conf({})


def test_work_dir_without_setting():
    s = _Spark()
    a = work_dir(s)
    assert a and s.sparkContext.dir == a
    assert work_dir(s) == a  # one folder per application


def test_no_machine_local_folder_on_a_cluster():
    s = _Spark()
    s.sparkContext.applicationId = "app-cluster"
    s.sparkContext.getConf = lambda: _Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(ValueError):
        work_dir(s)
