"""Mapping-set queries: line items as mappings of parts to suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import mappings as m
from quillgraph.plans.view_sql import with_views

QUERIES: dict = {}
SQL: dict = {}

_CTE = {
    "maps": "SELECT concat('part:', CAST(l_partkey AS VARCHAR)) AS subject_id, CASE l_returnflag WHEN 'A' THEN 'skos:exactMatch' WHEN 'N' THEN 'skos:broadMatch' ELSE 'ex:other' END AS predicate_id, concat('supplier:', CAST(l_suppkey AS VARCHAR)) AS object_id, concat('semapv:', l_linestatus) AS mapping_justification, CAST(CAST(l_discount * 100 AS INTEGER) AS VARCHAR) AS confidence, l_linestatus AS subject_category, l_returnflag AS object_category, 'lines' AS mapping_tool FROM lineitem",
    "open_maps": "SELECT * FROM maps WHERE subject_category = 'O'",
    "done_maps": "SELECT * FROM maps WHERE subject_category = 'F'",
    "pairs": "SELECT DISTINCT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b FROM open_maps",
    "pairs2": "SELECT DISTINCT least(subject_id, object_id) AS a, greatest(subject_id, object_id) AS b FROM done_maps",
}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, _CTE)
        return f

    return add


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select(
        F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("subject_id"),
        F.when(F.col("l_returnflag") == "A", "skos:exactMatch").when(F.col("l_returnflag") == "N", "skos:broadMatch").otherwise("ex:other").alias("predicate_id"),
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("object_id"),
        F.concat(F.lit("semapv:"), F.col("l_linestatus")).alias("mapping_justification"),
        F.round(F.col("l_discount") * 100).cast("int").cast("string").alias("confidence"),
        F.col("l_linestatus").alias("subject_category"),
        F.col("l_returnflag").alias("object_category"),
        F.lit("lines").alias("mapping_tool"),
    )


def _two(spark, sf_dir):
    both = mappings(spark, sf_dir)
    return both.filter("subject_category = 'O'"), both.filter("subject_category = 'F'")


@_query("SELECT DISTINCT * EXCLUDE (best) FROM (SELECT *, max(TRY_CAST(confidence AS DOUBLE)) OVER (PARTITION BY subject_id, predicate_id, object_id) AS best FROM maps) WHERE TRY_CAST(confidence AS DOUBLE) >= best OR TRY_CAST(confidence AS DOUBLE) IS NULL")
def map_dedupe(spark, sf_dir):
    return m.dedupe(mappings(spark, sf_dir))


@_query("SELECT * FROM maps WHERE predicate_id LIKE 'skos:%' AND (object_id LIKE '%7' OR object_id LIKE '%1%')")
def map_filter(spark, sf_dir):
    return m.select(mappings(spark, sf_dir), {"predicate_id": ["skos:*"], "object_id": ["*7", "*1*"]})


@_query("SELECT * FROM maps x WHERE NOT EXISTS (SELECT 1 FROM done_maps y WHERE x.subject_id = y.subject_id AND x.predicate_id = y.predicate_id AND x.object_id = y.object_id AND x.mapping_justification = y.mapping_justification)")
def map_remove(spark, sf_dir):
    return m.remove(mappings(spark, sf_dir), _two(spark, sf_dir)[1])


@_query("SELECT DISTINCT *, 'one' AS mapping_source FROM open_maps UNION SELECT DISTINCT *, 'two' FROM done_maps")
def map_merge(spark, sf_dir):
    return m.merge(list(_two(spark, sf_dir)), ["one", "two"])


_PAIR = "least(subject_id, object_id), greatest(subject_id, object_id)"


@_query(
    f"SELECT DISTINCT *, CASE WHEN ({_PAIR}) IN (SELECT (a, b) FROM pairs2) THEN 'COMMON_TO_BOTH' ELSE 'UNIQUE_1' END AS comment FROM open_maps"
    f" UNION SELECT DISTINCT *, CASE WHEN ({_PAIR}) IN (SELECT (a, b) FROM pairs) THEN 'COMMON_TO_BOTH' ELSE 'UNIQUE_2' END FROM done_maps"
)
def map_diff(spark, sf_dir):
    return m.diff(*_two(spark, sf_dir))


@_query("SELECT object_id AS subject_id, CASE predicate_id WHEN 'skos:broadMatch' THEN 'skos:narrowMatch' ELSE predicate_id END AS predicate_id, subject_id AS object_id, mapping_justification, confidence, object_category AS subject_category, subject_category AS object_category, mapping_tool FROM maps WHERE predicate_id LIKE 'skos:%'")
def map_invert(spark, sf_dir):
    return m.invert(mappings(spark, sf_dir))


@_query("SELECT subject_category, count(*) FILTER (WHERE object_category = 'A') AS \"A\", count(*) FILTER (WHERE object_category = 'N') AS \"N\", count(*) FILTER (WHERE object_category = 'R') AS \"R\" FROM maps GROUP BY 1")
def map_crosstab(spark, sf_dir):
    return m.crosstab(mappings(spark, sf_dir), values=["A", "N", "R"])


@_query(
    "SELECT x.*, concat(CASE WHEN o.n > 1 THEN 'n' ELSE '1' END, ':', CASE WHEN s.n > 1 THEN 'n' ELSE '1' END) AS mapping_cardinality FROM maps x"
    " JOIN (SELECT subject_id, object_category AS c, count(DISTINCT object_id) AS n FROM maps GROUP BY 1, 2) s ON s.subject_id = x.subject_id AND s.c = x.object_category"
    " JOIN (SELECT object_id, object_category AS c, count(DISTINCT subject_id) AS n FROM maps GROUP BY 1, 2) o ON o.object_id = x.object_id AND o.c = x.object_category"
)
def map_cardinality(spark, sf_dir):
    return m.cardinality(mappings(spark, sf_dir), scope=("object_category",))


def ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mappings to their customers: a clique for each customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("subject_id"), F.lit("skos:exactMatch").alias("predicate_id"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("object_id"))


_ORDERED = "SELECT concat('order:', CAST(o_orderkey AS VARCHAR)) AS subject_id, concat('customer:', CAST(o_custkey AS VARCHAR)) AS object_id FROM orders"


@_query(f"SELECT DISTINCT subject_id, object_id, least(min(subject_id) OVER (PARTITION BY object_id), object_id) AS component FROM ({_ORDERED}) x")
def map_partition(spark, sf_dir):
    return m.partition(ordered(spark, sf_dir)).select("subject_id", "object_id", "component").distinct()


@_query(f"SELECT min(node) AS component, count(*) AS size, string_agg(node, '|' ORDER BY node) AS members FROM (SELECT DISTINCT subject_id AS node, object_id AS clique FROM ({_ORDERED}) x UNION SELECT object_id, object_id FROM ({_ORDERED}) y) z GROUP BY clique")
def map_cliquesummary(spark, sf_dir):
    return m.clique_summary(ordered(spark, sf_dir))


@_query("SELECT *, lower(concat('part_', split_part(predicate_id, ':', 2), '_supplier')) AS key FROM maps")
def map_split_key(spark, sf_dir):
    return m.split_key(mappings(spark, sf_dir))


@_query("SELECT * EXCLUDE (mapping_tool) FROM maps")
def map_condense(spark, sf_dir):
    return m.condense(mappings(spark, sf_dir))[0]


@_query("SELECT * REPLACE (replace(subject_id, 'part:', 'p:') AS subject_id, replace(object_id, 'supplier:', 's:') AS object_id) FROM maps")
def map_reconcile_prefixes(spark, sf_dir):
    return m.reconcile_prefixes(mappings(spark, sf_dir), {"part": "p", "supplier": "s"})


@_query("SELECT * FROM maps WHERE predicate_id LIKE 'skos:%' AND NOT object_id LIKE '%9'")
def map_rules(spark, sf_dir):
    return m.apply_rules(mappings(spark, sf_dir), [m.Rule({"object_id": ["*9"]}, "stop"), m.Rule({"predicate_id": ["skos:*"]}, "include")])


@_query("SELECT 'datatype' AS category, 'confidence' AS slot, subject_id, object_id, confidence AS value FROM maps WHERE CAST(confidence AS DOUBLE) > 1 UNION ALL SELECT 'prefix', 'predicate_id', subject_id, object_id, predicate_id FROM maps WHERE predicate_id LIKE 'ex:%'")
def map_validate(spark, sf_dir):
    return m.validate(mappings(spark, sf_dir), ["part", "supplier", "skos"])


@_query("SELECT predicate_id, count(*) AS n, sum(CAST(confidence AS DOUBLE)) AS total FROM maps GROUP BY 1")
def dosql_group(spark, sf_dir):
    return m.dosql("SELECT predicate_id, count(*) AS n, sum(confidence) AS total FROM df GROUP BY 1", lines=mappings(spark, sf_dir))


@_query("SELECT DISTINCT x.subject_id, x.object_id FROM open_maps x JOIN done_maps y ON x.subject_id = y.subject_id AND x.object_id = y.object_id")
def dosql_join(spark, sf_dir):
    one, two = _two(spark, sf_dir)
    return m.dosql("SELECT DISTINCT x.subject_id, x.object_id FROM df1 x JOIN df2 y ON x.subject_id = y.subject_id AND x.object_id = y.object_id", df1=one, df2=two)
