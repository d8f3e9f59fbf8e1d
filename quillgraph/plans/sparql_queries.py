"""SPARQL over the driver's tables as statements."""

from __future__ import annotations

from quillgraph.plans.view_sql import with_views
from quillgraph.sources.driver_tables import statements
from quillgraph.sparql.compile import Engine, quads_of

QUERIES: dict = {}
SQL: dict = {}


def _query(name: str, text: str, sql: str | None, update: bool = False) -> None:
    def run(spark, sf_dir):
        engine = Engine(quads_of(statements(spark, sf_dir)))
        if not update:
            return engine.query(text)
        return Engine(engine.update(text)).query("SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p")

    QUERIES[f"sparql_{name}"] = run
    if sql:
        SQL[f"sparql_{name}"] = with_views(sql)


_query("bgp", "SELECT ?c ?label ?n { ?c rdfs:subClassOf ?n ; rdfs:label ?label . ?n rdfs:subClassOf region:1 }", f"SELECT a.subject AS c, l.value AS label, a.object AS n FROM statements a JOIN statements l ON l.subject = a.subject AND l.predicate = 'rdfs:label' JOIN statements b ON b.subject = a.object AND b.predicate = 'rdfs:subClassOf' AND b.object = 'region:1' WHERE a.predicate = 'rdfs:subClassOf'")
_query("filter", 'SELECT ?x ?v { ?x oio:hasExactSynonym ?v . FILTER(REGEX(?v, "^b", "i") && !isBlank(?x) || STRENDS(STR(?x), ":7")) }', "SELECT subject AS x, value AS v FROM statements WHERE predicate = 'oio:hasExactSynonym' AND (value ILIKE 'b%' OR subject LIKE '%:7')")
_query("optional", "SELECT ?x ?d { ?x rdf:type owl:Class OPTIONAL { ?x IAO:0000115 ?d FILTER(CONTAINS(?d, 'A')) } }", "SELECT t.subject AS x, d.value AS d FROM statements t LEFT JOIN statements d ON d.subject = t.subject AND d.predicate = 'IAO:0000115' AND contains(d.value, 'A') WHERE t.predicate = 'rdf:type' AND t.object = 'owl:Class'")
_query("union", "SELECT ?x ?v { { ?x rdfs:label ?v } UNION { ?x oio:hasExactSynonym ?v } }", "SELECT subject AS x, value AS v FROM statements WHERE predicate IN ('rdfs:label', 'oio:hasExactSynonym')")
_query("minus", "SELECT ?x { ?x rdf:type owl:Class MINUS { ?x owl:deprecated ?d } }", "SELECT subject AS x FROM statements WHERE predicate = 'rdf:type' AND object = 'owl:Class' AND subject NOT IN (SELECT subject FROM statements WHERE predicate = 'owl:deprecated')")
_query("not_exists", "SELECT ?x { ?x rdf:type owl:Class FILTER NOT EXISTS { ?x owl:deprecated true } }", "SELECT subject AS x FROM statements WHERE predicate = 'rdf:type' AND object = 'owl:Class' AND subject NOT IN (SELECT subject FROM statements WHERE predicate = 'owl:deprecated' AND value = 'true')")
_query("exists", "SELECT ?x ?v { ?x rdfs:label ?v FILTER EXISTS { ?x owl:deprecated true } }", "SELECT subject AS x, value AS v FROM statements WHERE predicate = 'rdfs:label' AND subject IN (SELECT subject FROM statements WHERE predicate = 'owl:deprecated')")
_query("bind_values", "SELECT ?x ?u ?p { VALUES ?p { rdfs:label oio:hasExactSynonym } ?x ?p ?v BIND(UCASE(CONCAT(?v, '-', STRAFTER(STR(?x), ':'))) AS ?u) }", "SELECT subject AS x, upper(concat(value, '-', split_part(subject, ':', 2))) AS u, predicate AS p FROM statements WHERE predicate IN ('rdfs:label', 'oio:hasExactSynonym')")
_query("path_plus", "SELECT ?x ?y { ?x rdfs:subClassOf+ ?y . ?x rdf:type owl:Class }", "SELECT e.subject AS x, e.object AS y FROM entailed_edge e WHERE e.predicate = 'rdfs:subClassOf' AND e.subject IN (SELECT id FROM class_node)")
_query("path_star_list", "SELECT ?x ?m { ?x owl:equivalentClass/owl:intersectionOf/rdf:rest*/rdf:first ?m }", "SELECT subject AS x, object AS m FROM owl_equivalent_to_intersection_member")
_query("path_inverse_alternative", "SELECT ?a ?b { ?a (^rdfs:subClassOf|owl:annotatedSource) ?b }", "SELECT object AS a, subject AS b FROM statements WHERE predicate = 'rdfs:subClassOf' UNION ALL SELECT subject, object FROM statements WHERE predicate = 'owl:annotatedSource'")
_query("group_count", "SELECT ?n (COUNT(DISTINCT ?x) AS ?k) (MIN(?x) AS ?lo) { ?x rdfs:subClassOf ?n } GROUP BY ?n HAVING (?k > 5)", "SELECT object AS n, CAST(count(DISTINCT subject) AS VARCHAR) AS k, min(subject) AS lo FROM statements WHERE predicate = 'rdfs:subClassOf' GROUP BY 1 HAVING count(DISTINCT subject) > 5")
_query("group_concat", "SELECT ?n (GROUP_CONCAT(?x; SEPARATOR='|') AS ?xs) { ?x rdfs:subClassOf ?n } GROUP BY ?n", "SELECT object AS n, string_agg(subject, '|' ORDER BY subject) AS xs FROM statements WHERE predicate = 'rdfs:subClassOf' GROUP BY 1")
_query("subselect", "SELECT ?x ?v { { SELECT ?v (COUNT(?y) AS ?k) { ?y oio:hasExactSynonym ?v } GROUP BY ?v HAVING (?k > 1) } ?x oio:hasExactSynonym ?v }", "SELECT subject AS x, value AS v FROM statements WHERE predicate = 'oio:hasExactSynonym' AND value IN (SELECT value FROM statements WHERE predicate = 'oio:hasExactSynonym' GROUP BY 1 HAVING count(*) > 1)")
_query("order_limit", "SELECT DISTINCT ?v { ?x rdfs:label ?v } ORDER BY DESC(?v) LIMIT 7 OFFSET 2", "SELECT DISTINCT value AS v FROM statements WHERE predicate = 'rdfs:label' ORDER BY value DESC LIMIT 7 OFFSET 2")
_query("ask", "ASK { ?x owl:deprecated true }", "SELECT count(*) > 0 AS ask FROM statements WHERE predicate = 'owl:deprecated' AND value = 'true'")
_query("construct", "CONSTRUCT { ?n ex:has ?x } WHERE { ?x rdfs:subClassOf ?n FILTER(!isBlank(?n)) }", "SELECT DISTINCT concat('<', object, '>') AS s, '<ex:has>' AS p, concat('<', subject, '>') AS o FROM statements WHERE predicate = 'rdfs:subClassOf' AND object NOT LIKE '\\_:%' ESCAPE '\\'")
_query("describe", "DESCRIBE nation:3", "SELECT DISTINCT concat('<', subject, '>') AS s, concat('<', predicate, '>') AS p, CASE WHEN object IS NULL THEN concat('\"', value, '\"^^', datatype) ELSE concat('<', object, '>') END AS o FROM statements WHERE subject = 'nation:3'")
_query("update", "DELETE { ?x owl:deprecated ?d } INSERT { ?x ex:old true } WHERE { ?x owl:deprecated ?d } ; DELETE WHERE { ?x dcterms:creator ?y }", "SELECT CASE predicate WHEN 'owl:deprecated' THEN 'ex:old' ELSE predicate END AS p, CAST(count(*) AS VARCHAR) AS n FROM (SELECT DISTINCT subject, predicate, object, value, datatype FROM statements) WHERE predicate <> 'dcterms:creator' GROUP BY 1", update=True)
