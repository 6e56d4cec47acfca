from types import SimpleNamespace

import pytest

from spindrift.llm import common


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


def test_shared_folder():
    session = lambda master, **conf: SimpleNamespace(conf=Conf(conf), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.shared_dir(session(master))
        assert common.shared_dir(session(master, **{"spark.checkpoint.dir": "s3a://x"})) == "s3a://x"
    one = session("local[8]")
    assert common.shared_dir(one) == common.shared_dir(one) and common.shared_dir(one).startswith("file://")
    assert common.shared_dir(session("local", **{"spark.checkpoint.dir": "file:///x"})) == "file:///x"


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (7, None), (101, 100), (100, 101)]
    got = {x.node: x.root for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
