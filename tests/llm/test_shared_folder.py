from types import SimpleNamespace

import pytest

from tallyspark.llm import common


def fake(master, named=None):
    conf = SimpleNamespace(get=lambda key: named)
    unset = SimpleNamespace(isEmpty=lambda: True)
    return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset))))


def test_clusters_must_name_their_folder():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            common.shared_folder(fake(master))
        assert common.shared_folder(fake(master, "hdfs:///shared/")) == "hdfs:///shared"
