"""Named queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.plans import authoring_queries, axiom_queries, export_queries, graph_queries, mapping_queries, qc_queries, sparql_queries, views
from quillgraph.plans.view_sql import with_views
from quillgraph.sources.driver_tables import LOOP_STATEMENTS, ODD_STATEMENTS, statements

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Views of cycles need some; all others have rows of every kind, but no cycle.
_LOOPED = ("entailed_edge_cycle", "entailed_edge_same_predicate_cycle")


def _view_query(name: str) -> Query:
    more = "loop" if name in _LOOPED else "odd"
    return lambda spark, sf_dir: views.Views(statements(spark, sf_dir, more))[name]


for _name in views.NAMES:
    QUERIES[f"view_{_name}"] = _view_query(_name)
    SQL[f"view_{_name}"] = with_views(f"SELECT * FROM {_name}", {"statements": LOOP_STATEMENTS if _name in _LOOPED else ODD_STATEMENTS})
#: Tables that are declared and never filled: their columns are what there is to compare.
for _name, _schema in views.EMPTY.items():
    QUERIES[f"view_{_name}"] = _view_query(_name)
    SQL[f"view_{_name}"] = "SELECT " + ", ".join(f"CAST(NULL AS {'BIGINT' if c.split()[1] == 'bigint' else 'VARCHAR'}) AS {c.split()[0]}" for c in _schema.split(", ")) + " WHERE false"

for _module in (graph_queries, mapping_queries, sparql_queries, qc_queries, export_queries, axiom_queries, authoring_queries):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
