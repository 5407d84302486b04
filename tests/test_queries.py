"""Each query against its SQL on the same tables."""

import decimal

import duckdb
import pytest

from corpuslake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}"
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return str(bool(x))
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(plain, x)) + "]"
    if isinstance(x, (int, float)):
        return f"{float(x):.9g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert rows or name in ("search_contains", "owner_scope", "needs_attention"), "no rows"
    if name not in registry.ORACLES:
        return
    found = con.sql(registry.ORACLES[name])
    columns = list(found.columns)
    assert sorted(columns) == sorted(got.columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()])
    have = sorted([tuple(plain(x) for x in r) for r in rows])
    assert len(have) == len(want)
    wrong = [(h, w) for h, w in zip(have, want, strict=True) if h != w]
    assert not wrong, (len(wrong), wrong[:3])


