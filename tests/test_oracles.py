"""Every registered query against its SQL in DuckDB, on whole tables."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, duck

QUERIES, ORACLES = entry.load()          # the optional subpackage has its own tests


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, con, sf):
    status, message, *_ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), sf)
    assert status in ("ok", "rows"), f"{name}: {message}"


def test_oracle_keys():
    assert set(ORACLES) <= set(QUERIES)


def test_every_inventory_line_has_a_query():
    counts = {"S": 23, "P": 43, "J": 21, "A": 61, "W": 21, "T": 6, "X": 5, "V": 18, "G": 12, "Q": 13, "R": 6, "U": 3}
    have = {n.split("_")[0] for n in QUERIES}
    ids = [f"{k}{i:02d}" for k, n in counts.items() for i in range(1, n + 1)]
    assert [i for i in ids if i not in have] == []
