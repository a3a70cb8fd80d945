from types import SimpleNamespace

import pytest

from tarnlake.llm import common


def test_no_local_scratch_on_a_cluster():
    conf = SimpleNamespace(get=lambda name, default: default)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_root(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda name, default: "hdfs://shared/tmp/")
    assert common.scratch_root(SimpleNamespace(conf=named)) == "hdfs://shared/tmp"
