"""The work folder: the cluster's where it names one, a private one elsewhere."""

from types import SimpleNamespace

import pytest

from shelfmark.session import RECOMMENDED_CONF, work_dir


def fake(named=None, master="local[2]"):
    conf = {"spark.checkpoint.dir": named} if named else {}
    lookup = lambda key, default=None: conf.get(key, default)
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lookup), applicationId="app-1", master=master)
    return SimpleNamespace(conf=SimpleNamespace(get=lookup), sparkContext=context)


def test_named_folder_is_used():
    assert work_dir(fake("hdfs://shared/checkpoints/")) == "hdfs://shared/checkpoints"


def test_private_folder_is_made_once():
    assert work_dir(fake()) == work_dir(fake()) != ""


def test_a_cluster_must_name_its_folder():
    with pytest.raises(RuntimeError):
        work_dir(fake(master="local-cluster[3,2,1000]"))
    assert work_dir(fake("hdfs://x", master="yarn")) == "hdfs://x"


def test_settings_are_applied(spark):
    assert all(spark.conf.get(k) == v for k, v in RECOMMENDED_CONF.items())
