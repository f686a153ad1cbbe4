"""Scratch folders: one's own only on one machine; written tables can be dropped."""

from __future__ import annotations

import os
import types

import pytest

from tessitura import session


class _Conf:
    def get(self, *_):
        return None


def _fake(master):
    """A session whose checkpoint folder is unset."""
    unset = types.SimpleNamespace(isDefined=lambda: False)
    sc = types.SimpleNamespace(master=master, _jsc=types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: unset)), getConf=lambda: _Conf())
    return types.SimpleNamespace(sparkContext=sc, conf=_Conf())


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_fake(master))


def test_scratch_is_dropped(spark):
    path = session.scratch_path(spark, "t-drop")
    spark.range(3).write.parquet(path)
    local = path.replace("file:", "", 1)
    assert os.path.exists(local)
    session.drop_scratch(spark, path)
    assert not os.path.exists(local)


def test_spread_follows_the_setting(spark):
    df = spark.range(10).coalesce(1)
    before = spark.conf.get(session.SPREAD_CONF, None)
    spark.conf.unset(session.SPREAD_CONF)
    assert session.spread(df) is df
    spark.conf.set(session.SPREAD_CONF, "3")
    assert session.spread(df).rdd.getNumPartitions() == 3
    if before is None:
        spark.conf.unset(session.SPREAD_CONF)
    else:
        spark.conf.set(session.SPREAD_CONF, before)
