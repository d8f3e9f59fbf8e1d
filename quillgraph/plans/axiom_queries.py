"""Axiom-set and reasoning queries: the driver's hierarchy as EL normal forms and axioms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import axioms as ax
from quillgraph.plans.view_sql import with_views
from quillgraph.reason import services
from quillgraph.reason.el import Classification, classify
from quillgraph.sources.driver_tables import ODD_STATEMENTS, statements

QUERIES: dict = {}
SQL: dict = {}


def _query(sql: str | None = None, more: dict[str, str] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, more)
        return f

    return add


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes below classes; suppliers located in nations; what is located in a region is served by it."""
    s = statements(spark, sf_dir)
    null = F.lit(None).cast("string")
    named = s.filter("predicate = 'rdfs:subClassOf' and object not like '\\\\_:%'").select(F.lit("sub").alias("kind"), F.col("subject").alias("a"), F.col("object").alias("b"), null.alias("c"))
    filler = s.filter("predicate = 'owl:someValuesFrom'").select(F.col("subject").alias("r"), F.col("object").alias("c"))
    some = s.filter("predicate = 'rdfs:subClassOf'").select("subject", F.col("object").alias("r")).join(filler, "r").select(F.lit("some_sup").alias("kind"), F.col("subject").alias("a"), F.lit("rel:located_in").alias("b"), "c")
    regions = s.filter("predicate = 'rdf:type' and subject like 'region:%'").select(F.lit("some_sub").alias("kind"), F.lit("rel:located_in").alias("a"), F.col("subject").alias("b"), F.concat(F.lit("served:"), F.substring_index("subject", ":", -1)).alias("c"))
    out = named.union(some).union(regions)
    concepts = named.select("a").union(named.select("b")).union(some.select("a")).union(some.select("c")).union(regions.select("b")).union(regions.select("c")).distinct()
    return out.union(concepts.select(F.lit("concept"), "a", null, null)).union(spark.createDataFrame([("role", "rel:located_in", "rel:related_to", None)], "kind string, a string, b string, c string"))


_EL = {
    "told": "SELECT subject, object FROM rdfs_subclass_of_named_statement",
    "sups": "SELECT subject, object FROM told UNION SELECT t.subject, s.object FROM told t JOIN sups s ON t.object = s.subject",
    "located": "SELECT c.subject, f.object FROM rdfs_subclass_of_statement c JOIN statements f ON f.subject = c.object AND f.predicate = 'owl:someValuesFrom'",
    "served": "SELECT DISTINCT l.subject, concat('served:', split_part(s.object, ':', 2)) AS object FROM located l JOIN (SELECT subject, object FROM sups UNION SELECT object, object FROM told) s ON s.subject = l.object WHERE s.object LIKE 'region:%'",
}


@_query("SELECT subject, object FROM sups UNION SELECT subject, object FROM served", _EL)
def el_subsumptions(spark, sf_dir):
    return Classification(forms(spark, sf_dir)).subsumptions()


@_query("SELECT subject, object FROM told UNION SELECT subject, object FROM served", _EL)
def el_direct(spark, sf_dir):
    return Classification(forms(spark, sf_dir)).direct()


@_query("SELECT l.subject, r.p AS predicate, s.object FROM located l JOIN (SELECT subject, object FROM sups UNION SELECT object, object FROM told UNION SELECT subject, subject FROM told) s ON s.subject = l.object CROSS JOIN (SELECT unnest(['rel:located_in', 'rel:related_to']) AS p) r GROUP BY 1, 2, 3", _EL)
def el_materialize(spark, sf_dir):
    return Classification(forms(spark, sf_dir)).materialised()


def axiom_table(spark: SparkSession, sf_dir: str, where: str = "true", more: str = "") -> DataFrame:
    """Subclass and label axioms of the hierarchy."""
    s = statements(spark, sf_dir, more).filter(where)
    sub = services.made(s.filter("predicate = 'rdfs:subClassOf' and object not like '\\\\_:%'"), "SubClassOf", "subject", "object")
    label = s.filter("predicate = 'rdfs:label'").withColumn("value", F.concat(F.lit('"'), "value", F.lit('"')))
    label = services.made(label, "AnnotationAssertion", F.lit("rdfs:label"), "subject", "value")
    # labels are about their subject alone
    return sub.union(label.withColumn("signature", F.filter("signature", lambda x: (x != "rdfs:label") & ~x.startswith('"'))))


_AX = {
    "ax": "SELECT 'SubClassOf' AS type, subject AS s, object AS o FROM told UNION SELECT 'AnnotationAssertion', subject, value FROM rdfs_label_statement",
    "told": _EL["told"],
    "customers": "SELECT * FROM ax WHERE s LIKE 'customer:%'",
}


def _plain(df: DataFrame) -> DataFrame:
    s = F.when(F.col("type") == "SubClassOf", F.get_json_object("body", "$[1]")).otherwise(F.get_json_object("body", "$[2]"))
    o = F.when(F.col("type") == "SubClassOf", F.get_json_object("body", "$[2]")).otherwise(F.regexp_replace(F.get_json_object("body", "$[3]"), '^"|"$', ""))
    return df.select("type", s.alias("s"), o.alias("o"))


@_query("SELECT type, s, o FROM ax", _AX)
def axiom_merge(spark, sf_dir):
    return _plain(ax.merge(axiom_table(spark, sf_dir, "subject like 'customer:%'"), axiom_table(spark, sf_dir)))


@_query("SELECT type, s, o FROM ax WHERE s NOT LIKE 'customer:%'", _AX)
def axiom_unmerge(spark, sf_dir):
    return _plain(ax.unmerge(axiom_table(spark, sf_dir), axiom_table(spark, sf_dir, "subject like 'customer:%'")))


@_query("SELECT 'removed' AS change, type, count(*) AS n FROM customers GROUP BY 2", _AX)
def axiom_diff(spark, sf_dir):
    return ax.diff(axiom_table(spark, sf_dir), axiom_table(spark, sf_dir, "subject not like 'customer:%'")).groupBy("change", "type").agg(F.count("*").alias("n"))


@_query("SELECT type AS metric, count(*) AS value FROM ax GROUP BY 1 UNION ALL SELECT 'logical_axioms', count(*) FROM told UNION ALL SELECT 'total_axioms', count(*) FROM ax", _AX | {"told": "SELECT DISTINCT subject, object FROM rdfs_subclass_of_named_statement"})
def axiom_measure(spark, sf_dir):
    return ax.measure(axiom_table(spark, sf_dir).dropDuplicates(["axiom_id"]))


def _nations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"))


@_query("SELECT type, s, o FROM ax WHERE NOT (s LIKE 'nation:%' OR type = 'SubClassOf' AND o LIKE 'nation:%')", _AX)
def axiom_remove(spark, sf_dir):
    return _plain(ax.remove(axiom_table(spark, sf_dir), _nations(spark, sf_dir)).dropDuplicates(["axiom_id"]))


@_query("SELECT type, s, o FROM ax WHERE s LIKE 'nation:%' AND (type <> 'SubClassOf' OR o LIKE 'region:%') OR type <> 'SubClassOf' AND s LIKE 'region:%'", _AX)
def axiom_filter(spark, sf_dir):
    """Axioms about nations and their ancestors only."""
    a = axiom_table(spark, sf_dir)
    return _plain(ax.judged(a, ax.select_objects(a, _nations(spark, sf_dir), "self", "ancestors")).dropDuplicates(["axiom_id"]))


@_query("SELECT type, replace(s, 'nation:', 'country:') AS s, CASE type WHEN 'SubClassOf' THEN replace(o, 'nation:', 'country:') ELSE o END AS o FROM ax", _AX)
def axiom_rename(spark, sf_dir):
    return _plain(ax.rename(axiom_table(spark, sf_dir), {}, {"nation:": "country:"}))


@_query("SELECT type, s, o FROM ax WHERE s LIKE 'nation:%' OR s LIKE 'region:%'", _AX)
def module_bottom(spark, sf_dir):
    return _plain(ax.extract_bottom(axiom_table(spark, sf_dir), _nations(spark, sf_dir)).dropDuplicates(["axiom_id"]))


@_query("SELECT type, s, o FROM ax WHERE s LIKE 'nation:%' OR s LIKE 'region:%' AND type <> 'SubClassOf'", _AX)
def module_mireot(spark, sf_dir):
    return _plain(ax.mireot(axiom_table(spark, sf_dir), _nations(spark, sf_dir)).dropDuplicates(["axiom_id"]))


@_query("SELECT DISTINCT type, s, o FROM ax WHERE type <> 'SubClassOf' OR NOT EXISTS (SELECT 1 FROM told t JOIN sups u ON u.subject = t.object WHERE t.subject = ax.s AND u.object = ax.o)", _AX | {"sups": _EL["sups"], "statements": ODD_STATEMENTS})
def axiom_reduce(spark, sf_dir):
    """Without the subclass axioms that others imply: of the odd classes, those that lead past their nation."""
    a = axiom_table(spark, sf_dir, "subject not like '\\_:%'", "odd").dropDuplicates(["axiom_id"])
    return _plain(ax.reduce(a))


@_query("SELECT subject AS s, object AS o FROM sups EXCEPT SELECT subject, object FROM told", _EL)
def reason_indirect(spark, sf_dir):
    """Subclass axioms that are entailed and not stated."""
    a = axiom_table(spark, sf_dir)
    return _plain(services.inferred(a, indirect=True)).select("s", "o")


def _equivalent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The odd classes with their nations as equivalents."""
    a = axiom_table(spark, sf_dir, "subject not like '\\\\_:%'", "odd").filter("type = 'SubClassOf'")
    same = statements(spark, sf_dir, "odd").filter("predicate = 'owl:equivalentClass' and object not like '\\\\_:%'")
    return ax.merge(a, services.made(same, "EquivalentClasses", F.least("subject", "object"), F.greatest("subject", "object")))


@_query("SELECT DISTINCT id, replace(id, 'odd:', 'nation:') AS \"group\" FROM (SELECT subject AS id FROM told UNION SELECT object FROM told) x", _EL | {"statements": ODD_STATEMENTS})
def taxonomy_groups(spark, sf_dir):
    return services.taxonomy(classify(_equivalent(spark, sf_dir)))[0]


@_query("SELECT DISTINCT subject, object FROM (SELECT replace(subject, 'odd:', 'nation:') AS subject, replace(object, 'odd:', 'nation:') AS object FROM told) x WHERE subject <> object", _EL | {"statements": ODD_STATEMENTS})
def taxonomy_edges(spark, sf_dir):
    return services.taxonomy(classify(_equivalent(spark, sf_dir)))[1]


@_query("SELECT id FROM (SELECT subject AS id FROM told UNION SELECT object FROM told) x WHERE id NOT IN (SELECT subject FROM sups WHERE object LIKE 'region:%') AND id NOT LIKE 'region:%'", _EL)
def check_align(spark, sf_dir):
    """Classes that no region subsumes."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    return services.unaligned(axiom_table(spark, sf_dir), regions, "all")
