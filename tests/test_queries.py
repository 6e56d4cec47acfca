"""Every query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

from spindrift.functions import mdct
from spindrift.functions.bits import BitReader, BitWriter, EndOfPacket
from spindrift.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert got
    if name in ORACLE_SQL:
        rel = tables.sql(ORACLE_SQL[name])
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert sorted(map(str, got)) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_long_packets_of_bits():
    r = np.random.default_rng(5)
    fields = [(int(r.integers(0, 1 << 32)) & (1 << n) - 1, n) for n in r.integers(0, 33, 4000).tolist()]
    w, whole, size = BitWriter(), 0, 0
    for v, n in fields:
        w.write(v, n)
        whole |= v << size
        size += n
    assert w.bytes() == whole.to_bytes((size + 7) // 8, "little")
    reader = BitReader(w.bytes())
    for v, n in fields:
        assert reader.peek(n) == v and reader.read(n) == v
    left = reader.remaining()
    assert left < 8 and reader.peek(32) == 0
    with pytest.raises(EndOfPacket):
        reader.read(left + 1)
    with pytest.raises(EndOfPacket):
        reader.read(0)


@pytest.mark.parametrize("n", [1, 2, 16, 60])
def test_dct4_equals_its_definition(n):
    x = np.random.default_rng(n).normal(size=(3, n))
    k = np.arange(n) + 0.5
    assert np.abs(mdct.dct4(x) - x @ np.cos(np.pi / n * k[:, None] * k)).max() < 1e-9
