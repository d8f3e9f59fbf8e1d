"""Repository tables over the driver's tables, and their SQL."""

from __future__ import annotations

from quillgraph.operators import exports
from quillgraph.plans.qc_queries import _T
from quillgraph.plans.view_sql import with_views
from quillgraph.sources.driver_tables import statements

QUERIES: dict = {}
SQL: dict = {}

_MORE = _T | {
    "definitions": "SELECT DISTINCT e, o FROM t WHERE p = 'IAO:0000115'",
    "refs": "SELECT e, string_agg(o, ' ' ORDER BY o) AS xrefs FROM t WHERE p = 'oio:hasDbXref' GROUP BY 1",
    "both_edges": "SELECT e AS x, p, o AS y FROM t WHERE p = 'rdfs:subClassOf' UNION ALL SELECT s.e, q.o, f.o FROM t s JOIN restrictions r ON r.e = s.o JOIN t q ON q.e = s.o AND q.p = 'owl:onProperty' JOIN t f ON f.e = s.o AND f.p = 'owl:someValuesFrom' WHERE s.p = 'rdfs:subClassOf'",
    "typed_axioms": "SELECT s.o AS e, q.o AS p, v.o AS o, v.lit, v.lang, k.o AS kind FROM t s JOIN t x ON x.e = s.e AND x.p = 'rdf:type' AND x.o = 'owl:Axiom' JOIN t q ON q.e = s.e AND q.p = 'owl:annotatedProperty' JOIN t v ON v.e = s.e AND v.p = 'owl:annotatedTarget' JOIN t k ON k.e = s.e AND k.p = 'oio:hasSynonymType' WHERE s.p = 'owl:annotatedSource'",
}
_NAMED = "NOT LIKE '\\_:%' ESCAPE '\\'"
_SQL = {
    "basic_report": f"SELECT c.e AS cls, d.o AS def, coalesce(r.xrefs, '') AS xrefs FROM classes c LEFT JOIN definitions d ON d.e = c.e LEFT JOIN refs r ON r.e = c.e WHERE c.e {_NAMED}",
    "class_count_by_prefix": f"SELECT split_part(e, ':', 1) AS prefix, count(*) AS classes FROM classes WHERE e {_NAMED} GROUP BY 1",
    "edges": "SELECT x, p, y FROM both_edges WHERE x IN (SELECT e FROM classes) AND y IN (SELECT e FROM classes)",
    "obsoletes": "SELECT c.e AS cls, r.o AS replaced_by, k.o AS consider FROM gone c LEFT JOIN (SELECT DISTINCT e, o FROM t WHERE p = 'IAO:0100001') r ON r.e = c.e LEFT JOIN (SELECT DISTINCT e, o FROM t WHERE p = 'oio:consider') k ON k.e = c.e",
    "simple_seed": f"SELECT term FROM (SELECT e AS term FROM t WHERE p = 'rdf:type' AND o IN ('owl:AnnotationProperty', 'owl:ObjectProperty') UNION SELECT o FROM t WHERE p IN ('oio:inSubset', 'oio:hasSynonymType')) x WHERE term {_NAMED}",
    "subsets_labelled": "SELECT s.o AS subset, l.o AS label FROM t s JOIN t l ON l.e = s.e AND l.p = 'rdfs:label' WHERE s.p = 'oio:inSubset' AND s.e IN (SELECT e FROM classes)",
    "synonyms": "SELECT s.e AS cls, s.p AS predicate, s.o AS value, y.kind AS type FROM t s LEFT JOIN typed_axioms y ON y.e = s.e AND y.p = s.p AND y.o = s.o AND y.lit = s.lit AND y.lang = s.lang WHERE s.p IN ('rdfs:label', 'oio:hasRelatedSynonym', 'oio:hasNarrowSynonym', 'oio:hasBroadSynonym', 'oio:hasExactSynonym') AND s.e IN (SELECT e FROM classes)",
    "terms": f"SELECT term FROM (SELECT o AS term FROM t WHERE p <> 'rdf:type' AND lit = '' UNION SELECT e FROM t WHERE o <> 'owl:Ontology') x WHERE term {_NAMED}",
    "xrefs": "SELECT e AS cls, o AS xref FROM t WHERE p = 'oio:hasDbXref' AND e IN (SELECT e FROM classes)",
}


def _run(make):
    return lambda spark, sf_dir: make(statements(spark, sf_dir, "odd"))


for _name, _sql in _SQL.items():
    QUERIES[f"export_{_name}"] = _run(getattr(exports, _name))
    SQL[f"export_{_name}"] = with_views(_sql, _MORE)
