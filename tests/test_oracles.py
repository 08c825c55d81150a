"""Every query of the catalogue against its SQL in DuckDB."""

import math
from datetime import datetime

import duckdb
import pytest

from knotwork import graphs
from knotwork.model import Graph
from knotwork.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module", autouse=True)
def kept_graphs(spark, sf):
    """The projected graphs are computed once for all queries."""
    kept = {}

    def once(make):
        def get(spark_, folder):
            if make not in kept:
                g = make(spark_, folder)
                kept[make] = Graph(g.nodes.coalesce(2).cache(), g.edges.coalesce(2).cache())
            return kept[make]

        return get

    with pytest.MonkeyPatch.context() as m:
        for name in ("star", "event", "web"):
            m.setattr(graphs, name, once(getattr(graphs, name)))
        yield
    for g in kept.values():
        g.nodes.unpersist()
        g.edges.unpersist()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and not math.isnan(v):
        return f"{v:.6f}"
    if isinstance(v, datetime):
        return v.isoformat()
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalog.ORACLES:
        assert rows
        return
    result = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(df.columns, rows) == _rows(columns, result.fetchall())
