"""Editors' operators, modules, patterns and extracted mappings over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import authoring, mappings
from quillgraph.operators import axioms as ax
from quillgraph.plans.axiom_queries import _AX, _EL, _nations, _plain, axiom_table
from quillgraph.plans.view_sql import with_views
from quillgraph.reason.el import dl_query
from quillgraph.sources import lint, manchester, patterns
from quillgraph.sources.driver_tables import ODD_STATEMENTS, statements
from quillgraph.sparql import results
from quillgraph.sparql.compile import Engine, quads_of

QUERIES: dict = {}
SQL: dict = {}
_ODD = {"statements": ODD_STATEMENTS}
_ALL = "stanza, subject, predicate, object, value, datatype, language"


def _query(sql: str, more: dict[str, str] | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = with_views(sql, more)
        return f

    return add


@_query("SELECT type, s, o FROM ax WHERE s LIKE 'customer:%' AND (type <> 'SubClassOf' OR o LIKE 'nation:%') OR type <> 'SubClassOf' AND s LIKE 'nation:%'", _AX)
def module_top(spark, sf_dir):
    return _plain(ax.extract_top(axiom_table(spark, sf_dir), _nations(spark, sf_dir)).dropDuplicates(["axiom_id"]))


@_query("SELECT type, s, o FROM ax WHERE s LIKE 'customer:%' AND type = 'SubClassOf' OR s LIKE 'nation:%' AND type = 'SubClassOf' OR type <> 'SubClassOf' AND (s LIKE 'customer:%' OR s LIKE 'nation:%' OR s LIKE 'region:%')", _AX)
def module_star(spark, sf_dir):
    """What lies between customers and regions."""
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("id"))
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id"))
    return _plain(ax.extract_star(axiom_table(spark, sf_dir), region.union(customer).union(_nations(spark, sf_dir))).dropDuplicates(["axiom_id"]))


@_query("SELECT type, s, o FROM ax WHERE (s LIKE 'nation:%' OR s LIKE 'region:%')", _AX)
def import_module(spark, sf_dir):
    """What the nations and regions say of the nations that customers mention."""
    edit = axiom_table(spark, sf_dir, "subject like 'customer:%'")
    source = axiom_table(spark, sf_dir, "subject like 'nation:%' or subject like 'region:%'")
    return _plain(authoring.import_module(edit, source).dropDuplicates(["axiom_id"]))


@_query(
    f"SELECT DISTINCT {_ALL} FROM statements UNION SELECT DISTINCT object, object, 'rdfs:subPropertyOf', CASE predicate WHEN 'oio:inSubset' THEN 'oio:SubsetProperty' ELSE 'oio:SynonymTypeProperty' END, NULL, NULL, NULL FROM statements WHERE predicate IN ('oio:inSubset', 'oio:hasSynonymType') AND object IS NOT NULL",
    _ODD,
)
def normalize(spark, sf_dir):
    return authoring.normalize(statements(spark, sf_dir, "odd"))


@_query("SELECT DISTINCT subject AS old, concat('n:', lpad(CAST(CAST(split_part(subject, ':', 2) AS INTEGER) + 25 AS VARCHAR), 3, '0')) AS new FROM statements WHERE subject LIKE 'oddi:%'", _ODD)
def mint_ids(spark, sf_dir):
    """New ids beside the 25 that are in use."""
    return authoring.mint(statements(spark, sf_dir, "odd"), "oddi:", "n:", 0, 1000, 3)


@_query(f"SELECT DISTINCT {_ALL} FROM statements WHERE subject = 'nation:7' OR object = 'nation:7'", _ODD)
def grep_entity(spark, sf_dir):
    return authoring.grep(statements(spark, sf_dir, "odd"), "^nation_7$", ids_only=True)


@_query(f"SELECT DISTINCT {_ALL} FROM statements UNION SELECT DISTINCT subject, subject, 'rdfs:isDefinedBy', 'http://example.org/new', NULL, NULL, NULL FROM statements WHERE predicate = 'rdf:type' AND object IN ('owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty', 'owl:AnnotationProperty', 'owl:NamedIndividual') AND subject NOT LIKE '\\_:%' ESCAPE '\\' UNION SELECT 'http://example.org/new', 'http://example.org/new', 'owl:versionIRI', 'http://example.org/new/2', NULL, NULL, NULL", {"old_statements": ODD_STATEMENTS, "statements": f"SELECT CASE WHEN stanza = 'http://example.org/tables' THEN 'http://example.org/new' ELSE stanza END AS stanza, CASE WHEN subject = 'http://example.org/tables' THEN 'http://example.org/new' ELSE subject END AS subject, predicate, object, value, datatype, language FROM old_statements"})
def annotate_header(spark, sf_dir):
    return authoring.annotate(statements(spark, sf_dir, "odd"), ontology="http://example.org/new", version="http://example.org/new/2", defined_by=True)


@_query("SELECT DISTINCT x.subject AS subject_id, l.label AS subject_label, CASE WHEN x.value LIKE 'crm:%' THEN 'skos:exactMatch' ELSE 'oio:hasDbXref' END AS predicate_id, x.value AS object_id, 'semapv:UnspecifiedMatching' AS mapping_justification FROM statements x LEFT JOIN (SELECT subject, min(value) AS label FROM statements WHERE predicate = 'rdfs:label' GROUP BY 1) l ON l.subject = x.subject WHERE x.predicate = 'oio:hasDbXref' AND x.value LIKE '%:%' AND x.subject IN (SELECT subject FROM statements WHERE predicate = 'rdf:type' AND object = 'owl:Class') AND x.subject NOT IN (SELECT subject FROM statements WHERE predicate = 'owl:deprecated' AND value = 'true')")
def xref_extract(spark, sf_dir):
    return mappings.xref_extract(statements(spark, sf_dir), predicates={"crm": "skos:exactMatch"}, every=True)


_PATTERN = {"relations": {"made by": "rel:made_by"}, "vars": {"brand": ""}, "data_vars": {"kind": ""}, "subClassOf": {"text": "'made by' some %s", "vars": ["brand"]}, "def": {"text": "A part: %s.", "vars": ["kind"]}}


@_query("SELECT 'SubClassOf' AS type, concat('part:', CAST(p_partkey AS VARCHAR)) AS s, concat('[\"ObjectSomeValuesFrom\",\"rel:made_by\",\"brand:', replace(p_brand, ' ', '_'), '\"]') AS o FROM part UNION ALL SELECT 'AnnotationAssertion', concat('part:', CAST(p_partkey AS VARCHAR)), concat('A part: ', p_type, '.') FROM part")
def pattern_generate(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    table = part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("defined_class"), F.concat(F.lit("brand:"), F.replace("p_brand", F.lit(" "), F.lit("_"))).alias("brand"), F.col("p_type").alias("kind"))
    return _plain(patterns.generate(table, _PATTERN)).filter("type <> 'Declaration'")


@_query("SELECT subject AS id FROM sups WHERE object IN ('region:1', 'region:2')", _EL)
def dl_query_text(spark, sf_dir):
    """Classes below an expression in Manchester syntax."""
    return dl_query(axiom_table(spark, sf_dir), manchester.expression("<region:1> or region:2")).filter("id not in ('region:1', 'region:2')")


@_query("SELECT DISTINCT subject AS subject_id, predicate AS predicate_id, value AS source_value FROM statements WHERE predicate IN ('rdfs:label', 'IAO:0000115', 'oio:hasExactSynonym') AND value IS NOT NULL AND subject NOT LIKE '\\_:%' ESCAPE '\\' AND NOT (predicate = 'rdfs:label' AND subject LIKE 'nation:%')")
def untranslated(spark, sf_dir):
    """What nobody has translated, where the nations' labels are."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    done = nation.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("subject_id"), F.lit("rdfs:label").alias("predicate_id"), F.col("n_name").alias("source_value"), F.lit("de").alias("translation_language"))
    return lint.untranslated(statements(spark, sf_dir), done, "de").select("subject_id", "predicate_id", "source_value")


@_query("SELECT DISTINCT object AS x FROM entailed_edge WHERE subject = 'customer:1' AND predicate = 'rdfs:subClassOf'")
def sparql_seeded_path(spark, sf_dir):
    return Engine(quads_of(statements(spark, sf_dir))).query("SELECT ?x { customer:1 rdfs:subClassOf+ ?x }")


@_query("SELECT count(*) + 2 AS lines, CAST(sum(CASE WHEN value IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS bound FROM (SELECT t.subject, d.value FROM statements t LEFT JOIN statements d ON d.subject = t.subject AND d.predicate = 'IAO:0000115' WHERE t.predicate = 'rdf:type' AND t.object = 'owl:Class') x")
def sparql_json_document(spark, sf_dir):
    """Lines of a result document, and how many of them bind the definition."""
    rows = Engine(quads_of(statements(spark, sf_dir))).solutions("SELECT ?x ?d { ?x rdf:type owl:Class OPTIONAL { ?x IAO:0000115 ?d } }")
    return results.document(rows, "json").agg(F.count("*").alias("lines"), F.sum(F.col("value").contains('"d":{').cast("int")).alias("bound"))


@_query(f"SELECT {_ALL} FROM statements UNION ALL SELECT DISTINCT subject, subject, 'rdf:type', 'rdf:List', NULL, NULL, NULL FROM statements WHERE predicate IN ('rdf:first', 'rdf:rest') AND subject NOT IN (SELECT subject FROM statements WHERE predicate = 'rdf:type' AND object = 'rdf:List')", _ODD)
def lists_typed(spark, sf_dir):
    return results.lists_typed(statements(spark, sf_dir, "odd"))


@_query(f"SELECT {_ALL} FROM statements UNION ALL SELECT DISTINCT subject, subject, predicate, object, value, datatype, language FROM owl_reified_axiom r WHERE NOT EXISTS (SELECT 1 FROM statements s WHERE s.subject = r.subject AND s.predicate = r.predicate AND coalesce(s.object, '') = coalesce(r.object, '') AND coalesce(s.value, '') = coalesce(r.value, '') AND coalesce(s.datatype, '') = coalesce(r.datatype, ''))", {"old_statements": ODD_STATEMENTS, "statements": f"SELECT {_ALL} FROM old_statements WHERE NOT (predicate = 'rdfs:label' AND subject LIKE 'customer:%')"})
def reasserted(spark, sf_dir):
    """The customers' labels, left out, come back from the axioms that annotate them."""
    return results.reasserted(statements(spark, sf_dir, "odd").filter("not (predicate = 'rdfs:label' and subject like 'customer:%')"))
