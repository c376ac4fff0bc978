"""Every query with SQL against DuckDB; the others run."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
OWN = [n for n in QUERIES if not n.startswith("op") and n != "pipeline"]
#: The graph has no edges on the smallest tables.
GRAPHS = {"co_graph", "vertices", "degrees", "components", "lpa_5", "lpa_communities", "community_report", "sink_community_report", "shortest_path_count", "edge_betweenness", "betweenness_report", "edge_betweenness_joins", "top_edge", "modularity", "girvan_newman"}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows):
    value = lambda x: None if x is None or (isinstance(x, float) and math.isnan(x)) else round(float(x), 5) if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)
    return sorted((tuple(value(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, sf_dir, name):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01") if name in GRAPHS else sf_dir
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = norm(df.select(*columns).collect())
    assert rows or name not in GRAPHS
    if name in SQL:
        c = duckdb.connect()
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        rel = c.execute(SQL[name])
        names = [x[0] for x in rel.description]
        assert sorted(names) == columns
        at = [names.index(x) for x in columns]
        assert norm([[r[i] for i in at] for r in rel.fetchall()]) == rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0
