"""Quality rules over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import qc
from quillgraph.plans.view_sql import with_views
from quillgraph.sources.driver_tables import ODD_STATEMENTS, statements

QUERIES: dict = {}
SQL: dict = {}


def _run(rule):
    return lambda spark, sf_dir: rule(qc.Data(statements(spark, sf_dir, "odd")))


for _name, _rule in (qc.RULES | qc.CHECKS).items():
    QUERIES[f"qc_{_name}"] = _run(_rule)


def qc_report(spark, sf_dir):
    """Violations by severity and rule."""
    return qc.report(statements(spark, sf_dir, "odd")).groupBy("severity", "rule").agg(F.count("*").alias("n"))


QUERIES["qc_report"] = qc_report

_T = {
    "statements": ODD_STATEMENTS,
    "t": "SELECT DISTINCT subject AS e, predicate AS p, coalesce(object, value) AS o, CASE WHEN object IS NULL THEN coalesce(datatype, 'xsd:string') ELSE '' END AS lit, coalesce(language, '') AS lang FROM statements",
    "named": "SELECT * FROM t WHERE e NOT LIKE '\\_:%' ESCAPE '\\'",
    "dead": "SELECT DISTINCT e FROM t WHERE p = 'owl:deprecated' AND o = 'true' AND lit = 'xsd:boolean'",
    "alive": "SELECT * FROM t WHERE e NOT IN (SELECT e FROM dead)",
    "live": "SELECT * FROM named WHERE e NOT IN (SELECT e FROM dead)",
    "classes": "SELECT DISTINCT e FROM t WHERE p = 'rdf:type' AND o = 'owl:Class' AND lit = ''",
    "restrictions": "SELECT DISTINCT e FROM t WHERE p = 'rdf:type' AND o = 'owl:Restriction' AND lit = ''",
    "said": "SELECT DISTINCT e FROM live WHERE p NOT IN ('rdf:type', 'owl:equivalentClass', 'owl:disjointWith', 'owl:equivalentProperty', 'owl:sameAs', 'owl:differentFrom', 'owl:inverseOf')",
    "subsets": "SELECT e FROM t WHERE p = 'rdfs:subPropertyOf' AND o = 'oio:SubsetProperty'",
    "gone": "SELECT e FROM dead WHERE e IN (SELECT e FROM classes)",
    "parents": "SELECT e, o FROM t WHERE p = 'rdfs:subClassOf'",
    "up": "SELECT e, o FROM parents UNION SELECT q.e, up.o FROM parents q JOIN up ON q.o = up.e",
    "rests": "SELECT e, o FROM t WHERE p = 'rdf:rest'",
    "tail": "SELECT e, o FROM rests UNION SELECT r.e, tail.o FROM rests r JOIN tail ON r.o = tail.e",
    "heads": "SELECT e, o AS list FROM t WHERE p = 'owl:intersectionOf'",
    "cells": "SELECT e AS list, o AS cell FROM tail UNION SELECT list, list FROM heads",
    "members": "SELECT h.e AS x, f.o AS m FROM heads h JOIN cells c ON c.list = h.list JOIN t f ON f.e = c.cell AND f.p = 'rdf:first'",
    "fillers": "SELECT e, o FROM t WHERE p = 'owl:someValuesFrom'",
    "labelled": "SELECT DISTINCT e FROM t WHERE p = 'rdfs:label'",
    "dead_use": "SELECT o AS e, p, e AS o FROM t WHERE p IN ('owl:equivalentProperty', 'rdfs:subPropertyOf', 'owl:inverseOf') AND o IN (SELECT e FROM dead) AND o IN (SELECT e FROM t WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty') UNION SELECT o, p, e FROM t WHERE p IN ('owl:equivalentProperty', 'rdfs:subPropertyOf') AND o IN (SELECT e FROM dead) AND o IN (SELECT e FROM t WHERE p = 'rdf:type' AND o = 'owl:DatatypeProperty') UNION SELECT e, p, o FROM t WHERE p IN (SELECT e FROM dead) UNION SELECT a.e, b.o, a.o FROM t a JOIN t b ON b.e = a.o AND b.p = 'owl:onProperty' WHERE b.o IN (SELECT e FROM dead) AND b.e IN (SELECT e FROM restrictions)",
    "short": "SELECT s.o AS e, p.o AS p, v.o AS o FROM t s JOIN t p ON p.e = s.e AND p.p = 'owl:annotatedProperty' JOIN t v ON v.e = s.e AND v.p = 'owl:annotatedTarget' JOIN t k ON k.e = s.e AND k.p = 'oio:hasSynonymType' AND k.o IN ('OMO:0003000', 'OMO:0003012') WHERE s.p = 'owl:annotatedSource'",
    "inferred": "SELECT s.o AS e, v.o AS o FROM t s JOIN t p ON p.e = s.e AND p.p = 'owl:annotatedProperty' AND p.o = 'rdfs:subClassOf' JOIN t v ON v.e = s.e AND v.p = 'owl:annotatedTarget' JOIN t k ON k.e = s.e AND k.p = 'oio:is_inferred' AND contains(k.o, 'true') WHERE s.p = 'owl:annotatedSource'",
}
_DEF = "('IAO:0000115', 'IAO:0000600')"
_EXACT = "('IAO:0000118', 'oio:hasExactSynonym')"
_ANY = "('IAO:0000118', 'oio:hasExactSynonym', 'oio:hasBroadSynonym', 'oio:hasRelatedSynonym', 'oio:hasNarrowSynonym')"
_IRIS = "'RO:0002161', 'RO:0002175', 'foaf:depicted_by', 'oio:inSubset', 'dcterms:contributor'"
_PAD = "regexp_matches(o, '^\\s|\\s$')"
_BLANK = "o LIKE '\\_:%' ESCAPE '\\'"
_SHOWN = f"CASE WHEN {_BLANK} THEN 'blank node' ELSE o END"


def _rows(source: str, where: str, value: str = "o") -> str:
    return f"SELECT DISTINCT e AS entity, p AS property, {value} AS value FROM {source} WHERE {where}"


def _absent(source: str, prop: str, where: str = "true", entity: str = "e") -> str:
    return f"SELECT DISTINCT {entity} AS entity, '{prop}' AS property, CAST(NULL AS VARCHAR) AS value FROM {source} WHERE {where}"


def _no(prop: str) -> str:
    return f"e NOT IN (SELECT e FROM t WHERE p IN ({prop}))"


def _undeclared(used_by: str, kind: str) -> str:
    return _absent("t", "rdfs:subPropertyOf", f"p = '{used_by}' AND o NOT IN (SELECT e FROM t WHERE p = 'rdfs:subPropertyOf' AND o = '{kind}')", "o")


def _several(source: str, where: str, value: str = "o") -> str:
    """Rows of entities with more than one value for the property."""
    return f"SELECT DISTINCT x.e AS entity, x.p AS property, x.shown AS value FROM (SELECT *, {value} AS shown, count(*) OVER (PARTITION BY e, p) AS n FROM (SELECT DISTINCT e, p, o, lit, lang FROM {source} WHERE {where})) x WHERE x.n > 1"


_SQL = {
    "annotation_whitespace": _rows("named", f"p IN (SELECT e FROM t WHERE p = 'rdf:type' AND o = 'owl:AnnotationProperty') AND {_PAD}"),
    "deprecated_boolean_datatype": _rows("named", "p = 'owl:deprecated' AND lit NOT IN ('', 'xsd:boolean')"),
    "deprecated_class_reference": "SELECT e AS entity, p AS property, o AS value FROM t WHERE e IN (SELECT e FROM gone) AND (p IN ('owl:equivalentClass', 'owl:disjointWith', 'owl:ObjectProperty', 'owl:DataProperty') OR p = 'rdfs:subClassOf' AND o NOT IN ('oio:ObsoleteClass', 'owl:Thing')) UNION SELECT o, p, e FROM t WHERE p IN ('rdfs:subClassOf', 'owl:equivalentClass', 'owl:disjointWith') AND o IN (SELECT e FROM gone) UNION SELECT 'blank node', p, o FROM t WHERE p IN ('owl:someValuesFrom', 'owl:allValuesFrom') AND o IN (SELECT e FROM gone) AND e IN (SELECT e FROM restrictions)",
    "deprecated_property_reference": _rows("dead_use", "true", _SHOWN),
    "duplicate_definition": _rows("alive", f"p IN {_DEF} AND e NOT LIKE '\\_:%' ESCAPE '\\' AND (p, o, lit, lang) IN (SELECT (p, o, lit, lang) FROM alive WHERE p IN {_DEF} GROUP BY p, o, lit, lang HAVING count(DISTINCT e) > 1)"),
    "duplicate_label": "SELECT DISTINCT a.e AS entity, a.p AS property, a.o AS value FROM named a JOIN named b ON a.p = b.p AND a.o = b.o AND a.lit = b.lit AND a.lang = b.lang AND a.e <> b.e WHERE a.p = 'rdfs:label' AND NOT (a.e IN (SELECT e FROM dead) AND b.e IN (SELECT e FROM dead))",
    "duplicate_exact_synonym": _rows("live", f"p IN {_EXACT} AND (p, upper(o)) IN (SELECT (p, upper(o)) FROM live WHERE p IN {_EXACT} AND (e, p, o) NOT IN (SELECT (e, p, o) FROM short) GROUP BY p, upper(o) HAVING count(DISTINCT e) > 1)"),
    "duplicate_label_synonym": f"SELECT DISTINCT a.e AS entity, b.p AS property, a.o AS value FROM live a JOIN live b ON a.o = b.o AND a.lit = b.lit AND a.lang = b.lang WHERE a.p = 'rdfs:label' AND b.p IN {_EXACT}",
    "duplicate_scoped_synonym": f"SELECT DISTINCT a.e AS entity, a.p AS property, a.o AS value FROM named a JOIN named b ON a.e = b.e AND a.o = b.o AND a.lit = b.lit AND a.lang = b.lang AND a.p <> b.p WHERE a.p IN {_ANY} AND b.p IN {_ANY}",
    "equivalent_pair": _rows("named", f"p = 'owl:equivalentClass' AND NOT {_BLANK}"),
    "equivalent_class_axiom_no_genus": "SELECT DISTINCT n.e AS entity, CASE WHEN r.o LIKE '\\_:%' ESCAPE '\\' THEN 'blank node' ELSE r.o END AS property, f.o AS value FROM named n JOIN restrictions k ON k.e = n.o JOIN fillers f ON f.e = n.o JOIN t r ON r.e = n.o AND r.p = 'owl:onProperty' WHERE n.p = 'owl:equivalentClass' AND f.o NOT LIKE '\\_:%' ESCAPE '\\'",
    "illegal_use_of_built_in_vocabulary": _rows("t", "e = 'rdf:type'", _SHOWN),
    "invalid_entity_uri": "SELECT DISTINCT e AS entity, CAST(NULL AS VARCHAR) AS property, o AS value FROM named WHERE p = 'rdf:type' AND (starts_with(e, 'https://purl.obolibrary.org/obo/') OR starts_with(e, 'http://purl.org/obo/') OR starts_with(e, 'http://www.obofoundry.org/'))",
    "invalid_xref": _rows("named", "p = 'oio:hasDbXref' AND NOT regexp_matches(o, '^[A-Za-z_][A-Za-z0-9_.-]*[A-Za-z0-9_]:[^\\s]+$')"),
    "label_formatting": _rows("named", "p = 'rdfs:label' AND (contains(o, chr(10)) OR contains(o, chr(9)))"),
    "label_whitespace": _rows("named", f"p = 'rdfs:label' AND {_PAD}"),
    "lowercase_definition": _rows("live", f"p IN {_DEF} AND NOT regexp_matches(o, '^[A-Z0-9]')"),
    "missing_definition": _absent("said", "IAO:0000115", f"{_no(_DEF[1:-1])} AND e NOT IN (SELECT e FROM t WHERE p = 'rdf:type' AND o IN ('owl:Ontology', 'owl:NamedIndividual')) AND e NOT IN (SELECT e FROM subsets)"),
    "missing_label": _absent("said", "rdfs:label", "e NOT IN (SELECT e FROM t WHERE p = 'rdfs:label' AND o <> '') AND e NOT IN (SELECT e FROM t WHERE p = 'rdf:type' AND o = 'owl:Ontology') AND e NOT IN (SELECT e FROM subsets)"),
    "missing_superclass": _absent("said", "rdfs:subClassOf", "e IN (SELECT e FROM classes) AND " + _no("'rdfs:subClassOf'")),
    "missing_obsolete_label": _rows("named", "p = 'rdfs:label' AND e IN (SELECT e FROM dead) AND NOT regexp_matches(o, '(?i)^obsolete')"),
    "misused_obsolete_label": _rows("live", "p = 'rdfs:label' AND e <> 'oio:ObsoleteClass' AND regexp_matches(o, '(?i)^obsolete')"),
    "misused_replaced_by": _rows("live", "p = 'IAO:0100001'"),
    "missing_ontology_description": _absent("t", "dcterms:description", "p = 'rdf:type' AND o = 'owl:Ontology' AND " + _no("'dc:description', 'dcterms:description'")),
    "missing_ontology_license": _absent("t", "dcterms:license", "p = 'rdf:type' AND o = 'owl:Ontology' AND " + _no("'dcterms:license'")),
    "missing_ontology_title": _absent("t", "dcterms:title", "p = 'rdf:type' AND o = 'owl:Ontology' AND " + _no("'dc:title', 'dcterms:title'")),
    "missing_subset_declaration": _undeclared("oio:inSubset", "oio:SubsetProperty"),
    "missing_synonymtype_declaration": _undeclared("oio:hasSynonymType", "oio:SynonymTypeProperty"),
    "multiple_definitions": _several("live", f"p IN {_DEF}"),
    "multiple_labels": _several("named", "p = 'rdfs:label'"),
    "multiple_equivalent_classes": _several("named", "p = 'owl:equivalentClass' AND o NOT IN (SELECT e FROM t WHERE p = 'owl:unionOf')", _SHOWN),
    "multiple_equivalent_class_definitions": _several("(SELECT n.e, n.p, h.list AS o, n.lit, n.lang FROM named n JOIN heads h ON h.e = n.o WHERE n.p = 'owl:equivalentClass')", "true", _SHOWN),
    "multiple_asserted_superclasses": "SELECT * FROM (" + _several("t", f"p = 'rdfs:subClassOf' AND NOT {_BLANK} AND e IN (SELECT e FROM classes)") + ") y WHERE (y.entity, y.value) NOT IN (SELECT (e, o) FROM inferred)",
    "label_with_iri": _rows("named", "p = 'rdfs:label' AND regexp_matches(o, 'https?:')"),
    "dc_properties": _rows("named", "p LIKE 'dc:%'"),
    "illegal_date": _rows("t", "p IN ('dcterms:date', 'dcterms:issued', 'dcterms:created', 'oio:creation_date') AND lit <> '' AND NOT (lit = 'xsd:date' AND regexp_matches(o, '^\\d{4}-\\d\\d-\\d\\d$')) AND NOT (lit = 'xsd:dateTime' AND regexp_matches(o, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z'))"),
    "iri_range": _rows("named", f"p IN ({_IRIS}) AND ({_BLANK} OR lit <> '')"),
    "iri_range_advanced": _rows("named", f"p IN ({_IRIS}, 'rdfs:seeAlso') AND ({_BLANK} OR lit <> '')"),
    "multiple_replaced_by": "SELECT DISTINCT a.e AS entity, a.p AS property, concat(a.o, '|', b.o) AS value FROM t a JOIN t b ON a.e = b.e AND b.p = 'IAO:0100001' AND a.o <> b.o WHERE a.p = 'IAO:0100001'",
    "owldef_self_reference": "SELECT DISTINCT n.e AS entity, n.p AS property, n.e AS value FROM named n JOIN members m ON m.x = n.o LEFT JOIN fillers f ON f.e = m.m WHERE n.p = 'owl:equivalentClass' AND (m.m = n.e OR f.o = n.e)",
    "redundant_subclass_of": "SELECT DISTINCT a.e AS entity, a.o AS property, u.o AS value FROM named a JOIN up u ON u.e = a.o JOIN named d ON d.e = a.e AND d.p = a.p AND d.o = u.o WHERE a.p = 'rdfs:subClassOf' AND a.e IN (SELECT e FROM labelled) AND a.o IN (SELECT e FROM labelled) AND u.o IN (SELECT e FROM labelled)",
    "taxon_range": _rows("named", f"p IN ('RO:0002161', 'RO:0002175') AND ({_BLANK} OR lit <> '' OR NOT starts_with(o, 'NCBITaxon:'))"),
    "term_tracker_uri": _rows("t", "p = 'IAO:0000233' AND lit NOT IN ('', 'xsd:anyURI')", "lit"),
}
for _name, _sql in _SQL.items():
    SQL[f"qc_{_name}"] = with_views(_sql, _T)
SQL["qc_report"] = with_views(
    "SELECT severity, rule, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{level}' AS severity, '{name}' AS rule, entity FROM ({_SQL[name]}) q" for name, level in qc.SEVERITIES.items())
    + ") r WHERE entity IS NULL OR NOT (" + " OR ".join(f"starts_with(entity, '{b}')" for b in qc.BUILT_IN) + ") GROUP BY severity, rule",
    _T,
)
