"""Every registered query against its SQL on the same tables."""

import datetime
import decimal
import math

import pytest
from conftest import DATA

from arealens.workload import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracles()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, datetime.datetime):
        return value.date().isoformat() if value.time() == datetime.time() else value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (int, float, decimal.Decimal)):
        return float(value) + 0.0
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    relation = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(relation.columns)
    got, wanted = table(df.columns, df.collect()), table(relation.columns, relation.fetchall())
    assert len(got) == len(wanted)
    differing = [(g, w) for g, w in zip(got, wanted) if g != w]
    assert not differing, differing[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DATA.replace("sf0.001", "sf0.01")).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
