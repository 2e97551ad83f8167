"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from lumenframe import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([float(r[i]) if isinstance(r[i], float) else r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql(spark, name):
    """Rows there are, told apart by what is not measured, with numbers in every measured column; a second run gives the same."""
    got = [catalog.QUERIES[name](spark, SF).toPandas() for _ in range(2)]
    numbers = [c for c, t in got[0].dtypes.items() if t == "float64" and c != "wavelength"]
    labels = [c for c in got[0].columns if c not in numbers]
    assert len(got[0]) > 0 and all(got[0][c].notna().any() for c in numbers)
    if labels:
        assert not got[0][labels].astype(str).duplicated().any()
    order = [g.astype(str).sort_values(list(g.columns)).reset_index(drop=True) for g in got]
    assert order[0][labels].equals(order[1][labels]) if labels else len(got[0]) == len(got[1])
    for c in numbers:
        assert got[1][c].sum() == pytest.approx(got[0][c].sum(), rel=1e-4, abs=1e-4)


@pytest.mark.parametrize("name", ["temporally_embedded_cca", "mspoc", "spoc", "optimal_shift"])
def test_decompositions_use_all_traces(spark, name):
    from lumenframe.plans.spatial import features
    from lumenframe.plans.tables import ts

    d = "/root/testdata/sf0.001"
    got = {c for r in catalog.QUERIES[name](spark, d).collect() for c in [r["component"] if name == "optimal_shift" else r["channel"]]}
    if name == "optimal_shift":
        want = {f"{r.channel}_{int(r.wavelength)}" for r in ts(spark, d).select("channel", "wavelength").distinct().collect()}
    else:
        want = {r.channel for r in features(spark, d).select("channel").distinct().collect()}
    if name == "temporally_embedded_cca":
        want = {f"{c}@{k}" for c in want if c.endswith("760") for k in (0, 1, 2)}
    assert got == want
