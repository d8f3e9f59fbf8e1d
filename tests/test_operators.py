"""Operators on tiny frames with known results."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.curies import expanded, shortened
from quillgraph.ontology import MappingSet, Ontology
from quillgraph.operators import axioms as ax
from quillgraph.operators import graph, mappings, qc, text, vectors
from quillgraph.operators.closure import closure, paths
from quillgraph.operators.components import connected_components
from quillgraph.plans.views import COLUMNS, NAMES, Views
from quillgraph.reason.el import classify, dl_query
from quillgraph.sources import ofn, rdf, tables
from quillgraph.sparql.compile import Engine, quads_of
from quillgraph.streaming.incremental import IncrementalClosure

SUB = "rdfs:subClassOf"


def edges(spark, rows):
    return spark.createDataFrame(rows, "subject string, predicate string, object string")


def got(df):
    return {tuple(r) for r in df.collect()}


def statements(spark, rows):
    """(subject, predicate, object or None, value, datatype)."""
    return spark.createDataFrame([(s, s, p, o, v, d, None) for s, p, o, v, d in rows], ", ".join(f"{c} string" for c in COLUMNS))


def test_closure_with_cycle_and_depth(spark):
    e = edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("b", "q", "z"), ("a", "p", "c")])
    out = {(s, p, o): d for s, p, o, d in got(closure(e))}
    assert out["a", "p", "c"] == 1 and out["a", "p", "a"] == 2 and ("a", "q", "z") not in out and len(out) == 10
    with pytest.raises(RuntimeError):
        paths(e)


def test_walks_of_any_length(spark):
    """A list of 150 cells is no cycle; two ways of one length are two rows."""
    chain = [(f"n{i}", "p", f"n{i + 1}") for i in range(150)]
    out = paths(edges(spark, chain))
    assert out.count() == 150 * 151 // 2 and out.filter("subject = 'n0' and object = 'n150' and depth = 150").count() == 1
    twice = paths(edges(spark, [("a", "p", "b"), ("a", "p", "c"), ("b", "p", "d"), ("c", "p", "d"), ("d", "p", "e")]), by=())
    assert twice.filter("subject = 'a' and object = 'e'").count() == 2 and twice.count() == 5 + 2 + 1 + 1 + 2
    with pytest.raises(RuntimeError):
        paths(edges(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "b")]))


def test_closure_is_idempotent_and_matches_a_plain_one(spark):
    rng = random.Random(3)
    rows = {(f"n{rng.randrange(25)}", "p", f"n{rng.randrange(25)}") for _ in range(40)}
    once = closure(edges(spark, sorted(rows))).select("subject", "predicate", "object")
    want = {(a, b) for a, _, b in rows}
    while True:
        more = {(a, d) for a, b in want for c, d in want if b == c} - want
        if not more:
            break
        want |= more
    assert {(a, b) for a, _, b in got(once)} == want
    assert got(closure(once).select("subject", "predicate", "object")) == got(once)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 80)] + [(200, 201), (7, 7)], "a long, b long")
    out = dict(got(connected_components(e, "a", "b")))
    assert out[80] == 0 and out[201] == 200 and len(out) == 83


def relation_graph(spark):
    e = edges(spark, [("X_2", SUB, "X_1"), ("X_3", SUB, "X_2"), ("Y_2", SUB, "Y_1"), ("X_3", "part_of", "Y_2")])
    return graph.full_graph(e, transitive=["part_of"])


def test_relation_graph_and_pruning(spark):
    full = relation_graph(spark)
    assert full.count() == 11
    pruned = got(graph.nonredundant_graph(full, transitive=["part_of"]))
    assert pruned == {("X_3", "part_of", "Y_2"), ("X_3", SUB, "X_2"), ("X_2", SUB, "X_1"), ("Y_2", SUB, "Y_1")}
    ic = {t: v for t, _, v in got(graph.information_content(full))}
    assert ic["X_3"] == pytest.approx(100) and ic["X_1"] == pytest.approx(31.7394, abs=1e-3)


def test_collapse_and_cliques(spark):
    e = edges(spark, [("b", SUB, "a"), ("c", SUB, "b"), ("d", SUB, "a"), ("e", SUB, "a")])
    assert got(graph.collapse(e)) == {("c", "a"), ("d", "a"), ("e", "a")}
    to, out = graph.merge_equivalent_sets(spark.createDataFrame([("X:1", "Y:1"), ("Y:1", "Z:1")], "subject string, object string"), edges(spark, [("Z:1", SUB, "Q:1")]), ["Y", "X"])
    assert {l for _, l in got(to)} == {"Y:1"} and got(out) == {("Y:1", SUB, "Q:1")}


SAMPLE = [("HP:0000010", "skos:exactMatch", "MP:0000010", "semapv:LexicalMatching", "0.8"), ("HP:0000020", "skos:exactMatch", "MP:0000020", "semapv:LexicalMatching", "0.9"), ("HP:0000010", "skos:exactMatch", "MP:0000010", "semapv:ManualMappingCuration", "0.5")]
SLOTS = "subject_id string, predicate_id string, object_id string, mapping_justification string, confidence string"


def test_mapping_set(spark):
    m = spark.createDataFrame(SAMPLE, SLOTS)
    assert sorted(r["confidence"] for r in mappings.dedupe(m).collect()) == ["0.8", "0.9"]
    assert mappings.dedupe(m.withColumn("confidence", F.lit(None).cast("string"))).count() == 3
    assert got(mappings.dedupe(mappings.dedupe(m))) == got(mappings.dedupe(m))
    assert {(s, n) for _, n, s in got(mappings.clique_summary(m))} == {("HP:0000010|MP:0000010", 2), ("HP:0000020|MP:0000020", 2)}
    other = spark.createDataFrame([("HP:0000010", "skos:exactMatch", "MP:0000010", "x", "0.7"), ("HP:0000030", "skos:exactMatch", "MP:0000030", "x", "0.6")], SLOTS)
    tags = {(r["subject_id"], r["comment"]) for r in mappings.diff(m, other).collect()}
    assert tags == {("HP:0000010", "COMMON_TO_BOTH"), ("HP:0000020", "UNIQUE_1"), ("HP:0000030", "UNIQUE_2")}
    back = mappings.invert(mappings.invert(m))
    assert got(back.select(*m.columns)) == got(m)
    assert mappings.invert(m.withColumn("predicate_id", F.lit("ex:none"))).count() == 0
    assert {r["mapping_cardinality"] for r in mappings.cardinality(m).collect()} == {"1:1"}
    many = m.union(spark.createDataFrame([("HP:0000099", "skos:exactMatch", "MP:0000020", "x", None), ("HP:1", "p", "sssom:NoTermFound", "x", None)], SLOTS))
    cards = {(r["subject_id"], r["mapping_cardinality"]) for r in mappings.cardinality(many).collect()}
    assert ("HP:0000099", "n:1") in cards and ("HP:1", "1:0") in cards
    bad = mappings.validate(m.withColumn("confidence", F.lit("1.5")).withColumn("object_id", F.lit("no curie")), ["HP", "skos"])
    assert {(r["category"], r["slot"]) for r in bad.collect()} == {("datatype", "confidence"), ("curie", "object_id")}
    assert got(mappings.dosql("SELECT max(confidence) AS best FROM df", maps=m)) == {(0.9,)}
    assert MappingSet(m).select({"object_id": ["MP:*20"]}).rows.count() == 1


def test_mapping_files(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# curie_map:\n#   HP: http://x/HP_\n# license: \"free\"\nsubject_id\tpredicate_id\tobject_id\nHP:1\tskos:exactMatch\tNA\n")
    rows, meta = tables.read_sssom(spark, str(tmp_path / "m.tsv"))
    assert meta == {"curie_map": {"HP": "http://x/HP_"}, "license": "free"} and got(rows) == {("HP:1", "skos:exactMatch", None)}


EL_CASES = {
    "chain": ("SubClassOf(:E :Tissue) SubClassOf(:E ObjectSomeValuesFrom(:part :W)) SubClassOf(:W ObjectSomeValuesFrom(:part :H)) TransitiveObjectProperty(:part) SubClassOf(ObjectIntersectionOf(:Tissue ObjectSomeValuesFrom(:part :H)) :HT)", {(":E", ":Tissue"), (":E", ":HT")}, set()),
    "domain and union": ("ObjectPropertyDomain(:r :C) SubClassOf(:A ObjectSomeValuesFrom(:s :B)) SubObjectPropertyOf(:s :r) SubClassOf(ObjectUnionOf(:C :D) :U)", {(":A", ":C"), (":A", ":U"), (":C", ":U"), (":D", ":U")}, set()),
    "disjoint": ("SubClassOf(:A :B) SubClassOf(:A :C) DisjointClasses(:B :C) SubClassOf(:D ObjectSomeValuesFrom(:r :A))", set(), {":A", ":D"}),
    "range": ("ObjectPropertyRange(:r :B) SubClassOf(:A ObjectSomeValuesFrom(:r owl:Thing)) SubClassOf(ObjectSomeValuesFrom(:r :B) :C)", {(":A", ":C")}, set()),
}


@pytest.mark.parametrize("name", EL_CASES)
def test_classification(spark, name):
    body, want, bad = EL_CASES[name]
    c = classify(ofn.axioms(spark, f"Ontology({body})"))
    assert got(c.subsumptions()) == want and {r[0] for r in c.unsatisfiable().collect()} == bad and c.is_consistent()


def test_dl_query_and_reduction(spark):
    a = ofn.axioms(spark, "Ontology(SubClassOf(:A :B) SubClassOf(:B :C) SubClassOf(:A :C) SubClassOf(:A ObjectSomeValuesFrom(:r :B)))")
    assert got(dl_query(a, ["ObjectSomeValuesFrom", ":r", ":C"])) == {(":A",)}
    assert got(ax.told_edges(ax.reduce(a))) == {(":A", ":B"), (":B", ":C")}


def test_axiom_sets(spark):
    doc = 'Prefix(:=<http://e/>) Ontology(<http://o> Declaration(Class(:A)) SubClassOf(Annotation(rdfs:comment "x") :A :B) EquivalentClasses(:D ObjectIntersectionOf(:A ObjectSomeValuesFrom(:r :B))) SubClassOf(:Z :Y) AnnotationAssertion(rdfs:label :A "a label"@en))'
    a = ofn.axioms(spark, doc)
    b = ofn.axioms(spark, "Ontology(SubClassOf(:Z :Y) EquivalentClasses(ObjectIntersectionOf(ObjectSomeValuesFrom(:r :B) :A) :D))")
    assert a.count() == 5 and ax.merge(a, b).count() == 5 and ax.unmerge(a, b).count() == 3
    assert {r["change"] for r in ax.diff(b, a).collect()} == {"added"}
    relaxed = got(ax.unmerge(ax.relax(a), a).select("body"))
    assert {json.loads(x)[2] if isinstance(json.loads(x)[2], str) else "some" for (x,) in relaxed} == {":A", "some"}
    renamed = ax.rename(a, {":A": ":A2"})
    assert renamed.filter("body like '%\":A\"%'").count() == 0 and renamed.count() == 5
    module = ax.extract_bottom(a, spark.createDataFrame([(":D",)], "id string"))
    assert {r["type"] for r in module.collect()} == {"EquivalentClasses", "SubClassOf", "Declaration", "AnnotationAssertion"} and module.filter("body like '%:Z%'").count() == 0
    assert ax.mireot(a, spark.createDataFrame([(":A",)], "id string")).filter("type = 'SubClassOf'").count() == 1
    assert Ontology(axioms=a).measure().filter("metric = 'total_axioms'").first()["value"] == 5
    with pytest.raises(NotImplementedError):
        Ontology(axioms=a).reason("hermit")


def test_views_on_made_rows(spark):
    s = statements(spark, [
        ("A:1", "rdf:type", "owl:Class", None, None), ("A:1", "rdfs:label", None, " one", "xsd:string"), ("A:1", "rdfs:label", None, "uno", "xsd:string"), ("A:1", SUB, "a:b", None, None), ("A:1", SUB, "BB:2", None, None), ("A:1", SUB, "_:r", None, None),
        ("_:r", "owl:onProperty", "R:1", None, None), ("_:r", "owl:someValuesFrom", "C:3", None, None), ("p:1", "rdf:type", "owl:ReflexiveProperty", None, None),
        ("_:l1", "rdf:first", "m1", None, None), ("_:l1", "rdf:rest", "_:l2", None, None), ("_:l2", "rdf:first", "m2", None, None), ("_:l2", "rdf:rest", "rdf:nil", None, None),
        ("_:x", "owl:annotatedSource", "A:1", None, None), ("_:x", "owl:annotatedProperty", "rdfs:label", None, None), ("_:x", "owl:annotatedTarget", None, "uno", "xsd:string"), ("_:x", "oio:hasDbXref", None, "ref:1", "xsd:string"),
    ])
    v, fixed = Views(s), Views(s, strict=False)
    assert got(v["edge"]) == {("A:1", "R:1", "C:3"), ("A:1", SUB, "BB:2")} and ("A:1", SUB, "a:b") in got(fixed["edge"])
    assert got(v["irreflexive_property_node"]) == {("p:1",)} == got(fixed["reflexive_property_node"]) and v["reflexive_property_node"].isEmpty()
    assert got(v["rdf_list_member_statement"]) == {("_:l1", "m1"), ("_:l1", "m2"), ("_:l2", "m2")}
    assert got(v["trailing_whitespace_problem"]) == {("A:1", "rdfs:label", " one")} and fixed["trailing_whitespace_problem"].isEmpty()
    assert {r["value"] for r in v["node_with_two_labels_problem"].collect()} == {" one", "uno"}
    assert got(v["axiom_dbxref_annotation"].select("subject", "value", "annotation_value")) == {("A:1", "uno", "ref:1")}
    assert len(NAMES) == 82 and v["owl_axiom"].columns[0] == "id"


def test_sparql(spark):
    s = statements(spark, [("A", SUB, "B", None, None), ("B", SUB, "C", None, None), ("A", "rdfs:label", None, "x y", "xsd:string"), ("B", "ex:n", None, "10", "xsd:integer"), ("C", "ex:n", None, "9.5", "xsd:decimal")])
    e = Engine(quads_of(s))
    assert got(e.query("PREFIX r: <rdfs:> SELECT ?a ?b { ?a r:subClassOf ?b }")) == {("A", "B"), ("B", "C")}
    assert got(e.query("ASK { <A> rdfs:subClassOf <B> }")) == {(True,)}
    assert got(e.query("SELECT (COUNT(*) AS ?n) { ?a rdfs:subClassOf ?b }")) == {("2",)}
    assert got(e.query("SELECT ?x { <A> rdfs:subClassOf* ?x }")) == {("A",), ("B",), ("C",)}
    assert got(e.query("SELECT ?x ?n { ?x ex:n ?n FILTER(?n > 9.7) }")) == {("B", "10")}
    assert got(e.query("SELECT ?x ?l { ?x rdfs:subClassOf ?y OPTIONAL { ?x rdfs:label ?l } FILTER(!BOUND(?l)) }")) == {("B", None)}
    assert got(e.query('SELECT ?x ?z { { ?x rdfs:label ?l } UNION { ?x ex:n ?n } OPTIONAL { ?x ex:n ?n } BIND(IF(BOUND(?n), ?n + 1, "none") AS ?z) }')) == {("A", "none"), ("B", "11"), ("C", "10.5")}
    assert got(e.query("SELECT ?x { ?x rdfs:subClassOf ?y MINUS { ?x rdfs:label ?l } }")) == {("B",)}
    assert [r[0] for r in e.query("SELECT ?n { ?x ex:n ?n } ORDER BY ?n").collect()] == ["9.5", "10"]
    with pytest.raises(SyntaxError):
        e.query("SELECT ?x { ?x ")


def test_rules_and_sparql_agree(spark):
    s = statements(spark, [("A:1", "rdf:type", "owl:Class", None, None), ("A:1", "rdfs:label", None, "same", "xsd:string"), ("A:2", "rdfs:label", None, "same", "xsd:string"), ("A:2", "owl:deprecated", None, "true", "xsd:boolean"), ("A:3", "rdfs:label", None, "dead", "xsd:string"), ("A:3", "owl:deprecated", None, "True", "xsd:string"), ("A:4", "rdfs:label", None, "nbsp ", "xsd:string"), ("A:5", "rdfs:label", None, "tab\t", "xsd:string")])
    e, d = Engine(quads_of(s)), qc.Data(s)
    pairs = {
        "duplicate_label": "SELECT DISTINCT ?entity ?value { ?entity rdfs:label ?value . ?e2 rdfs:label ?value . FILTER(?entity != ?e2) FILTER NOT EXISTS { ?entity owl:deprecated true . ?e2 owl:deprecated true } }",
        "label_whitespace": "SELECT DISTINCT ?entity ?value { ?entity rdfs:label ?value FILTER(REGEX(?value, '\\\\s$') || REGEX(?value, '^\\\\s')) }",
        "missing_obsolete_label": "SELECT ?entity ?value { ?entity owl:deprecated true ; rdfs:label ?value FILTER(!REGEX(?value, '^obsolete', 'i')) }",
        "deprecated_boolean_datatype": "SELECT ?entity ?value { ?entity owl:deprecated ?value FILTER(DATATYPE(?value) != xsd:boolean) }",
    }
    for name, query in pairs.items():
        assert got(qc.RULES[name](d).select("entity", "value")) == got(e.query(query)), name
    assert got(qc.label_whitespace(d).select("entity")) == {("A:5",)}
    assert not qc.verify(s, {"x": qc.RULES["label_formatting"]})["x"]
    assert qc.report(s).filter("severity = 'ERROR'").count() >= 4


def test_readers(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://e/a> <http://www.w3.org/2000/01/rdf-schema#label> "x \\"q\\""@en .\n# note\n<http://e/a> <http://e/p> _:b .\n<http://e/a> <http://e/p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> <http://g> .\n')
    q = rdf.read_ntriples(spark, str(tmp_path / "a.nt"))
    rows = got(rdf.statements_of(q).select("subject", "predicate", "object", "value", "datatype", "language"))
    assert ("<http://e/a>", "rdfs:label", None, 'x \\"q\\"', None, "en") in rows and ("<http://e/a>", "<http://e/p>", None, "5", "xsd:integer", None) in rows
    rdf.write_ntriples(q, str(tmp_path / "out"))
    assert got(rdf.read_ntriples(spark, str(tmp_path / "out"))) == got(q)
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:owl="http://www.w3.org/2002/07/owl#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#"><owl:Class rdf:about="http://e/A"><rdfs:label xml:lang="en">a</rdfs:label><rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://e/r"/></owl:Restriction></rdfs:subClassOf></owl:Class></rdf:RDF>'
    (tmp_path / "a.owl").write_text(xml)
    (tmp_path / "a.ttl").write_text("@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix e: <http://e/> .\ne:A a owl:Class ; rdfs:label \"a\"@en ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty e:r ] .\n")
    plain = lambda df: {tuple("_" if x and x.startswith("_:") else x for x in r) for r in got(df.select("subject", "predicate", "object", "value", "language"))}
    assert plain(Ontology.read(spark, str(tmp_path / "a.owl")).statements) == plain(Ontology.read(spark, str(tmp_path / "a.ttl")).statements)
    (tmp_path / "a.obo").write_text('format-version: 1.2\n\n[Term]\nid: X:1\nname: one\nsynonym: "uno" EXACT []\nis_a: X:0 ! zero\nrelationship: part_of X:9\n')
    o = got(Ontology.read(spark, str(tmp_path / "a.obo")).statements.select("subject", "predicate", "object", "value"))
    assert {("X:1", "rdfs:label", None, "one"), ("X:1", "oio:hasExactSynonym", None, "uno"), ("X:1", SUB, "X:0", None), ("X:1", "rdf:type", "owl:Class", None)} <= o and len(o) == 8
    (tmp_path / "g.json").write_text('{"graphs": [{"id": "g", "nodes": [{"id": "a", "lbl": "A"}], "edges": [{"sub": "a", "pred": "is_a", "obj": "b"}]}]}')
    nodes, e = tables.read_obograph(spark, str(tmp_path / "g.json"))
    assert got(e) == {("a", SUB, "b")} and nodes.first()["label"] == "A"
    (tmp_path / "h.json").write_text('{"graphs": [{"id": "g", "nodes": [{"id": "a", "lbl": "A", "type": "CLASS", "meta": {"definition": {"val": "d"}, "deprecated": true}}], "edges": [{"sub": "a", "pred": "is_a", "obj": "b"}, {"sub": "a", "pred": "part_of", "obj": "c"}]}]}')
    o = Ontology.read(spark, str(tmp_path / "h.json")).statements
    assert {("a", "rdf:type", "owl:Class", None), ("a", "rdfs:label", None, "A"), ("a", "IAO:0000115", None, "d"), ("a", "owl:deprecated", None, "true"), ("a", SUB, "b", None)} <= got(o.select("subject", "predicate", "object", "value")) and o.count() == 9


def test_blank_nodes_belong_to_their_file(spark, tmp_path):
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="http://e/"><rdf:Description><e:p>{}</e:p></rdf:Description><rdf:Description rdf:nodeID="n"><e:q rdf:resource="#x"/></rdf:Description></rdf:RDF>'
    for kind, body in (("owl", xml), ("ttl", "@prefix e: <http://e/> .\n[] e:p \"{}\" .\n_:n e:q <#x> .")):
        (tmp_path / kind).mkdir()
        for i in (1, 2):
            (tmp_path / kind / f"{i}.{kind}").write_text(body.format(i))
        q = (rdf.read_rdfxml if kind == "owl" else rdf.read_turtle)(spark, str(tmp_path / kind))
        assert q.select("s").distinct().count() == 4 and q.filter("s not like '\\_:%'").isEmpty()
        assert {r["o"].rsplit("/", 1)[1] for r in q.filter("p = '<http://e/q>'").collect()} == {f"1.{kind}#x>", f"2.{kind}#x>"}


def test_relative_references(spark):
    """Examples of the generic URI syntax, and bases that change within a document."""
    base = "http://a/b/c/d;p?q"
    for ref, want in {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "#s": "http://a/b/c/d;p?q#s", "": base, "..": "http://a/b/", "../../g": "http://a/g", "../../../g": "http://a/g", "g?y#s": "http://a/b/c/g?y#s", "urn:x:y": "urn:x:y"}.items():
        assert rdf.resolved(base, ref) == want, ref
    text = "@base <http://e/one/> .\n@prefix p: <v#> .\n<a> p:x <../b> . # <not> read\nBASE <http://f/>\n<a> p:x \"<a> stays\" , <#c> ."
    assert {r[1:] for r in rdf.parse_turtle(text)} == {("<http://e/one/a>", "<http://e/one/v#x>", "<http://e/b>"), ("<http://f/a>", "<http://e/one/v#x>", '"<a> stays"^^http://www.w3.org/2001/XMLSchema#string'), ("<http://f/a>", "<http://e/one/v#x>", "<http://f/#c>")}


def test_long_headers_are_whole(spark, tmp_path):
    lines = ["#curie_map:", *[f"#  P{i}: http://p/{i}/" for i in range(3000)], "#license: free", "subject_id\tpredicate_id", "a\tb", "#after: x", "c\td"]
    (tmp_path / "m.tsv").write_text("\n".join(lines) + "\n")
    rows, head = tables.read_sssom(spark, str(tmp_path / "m.tsv"))
    assert rows.count() == 2 and len(head["curie_map"]) == 3000 and head["license"] == "free" and "after" not in head


def test_curies_templates_and_export(spark):
    df = spark.createDataFrame([("http://purl.obolibrary.org/obo/IAO_0000115",), ("http://x/y",)], "i string")
    short = df.select(shortened(F.col("i")).alias("c"))
    assert got(short) == {("IAO:0000115",), ("<http://x/y>",)} and got(short.select(expanded(F.col("c")))) == got(df)
    t = spark.createDataFrame([("X:1", "one", "a|b", "X:0")], "id string, name string, syn string, up string")
    s = tables.template(t, {"id": "ID", "name": "LABEL", "syn": "A oio:hasExactSynonym SPLIT=|", "up": "SC part_of some %"})
    assert s.count() == 7
    assert got(tables.export(s, ["rdfs:label", "oio:hasExactSynonym"]).filter("id = 'X:1'")) == {("X:1", "one", "a|b")}


def test_text_and_vectors(spark):
    docs = spark.createDataFrame([(1, "The HEART wall é heart."), (2, None)], "id long, text string")
    terms = spark.createDataFrame([("heart", "H:1"), ("heart wall", "H:2"), ("ab", "H:3")], "key string, iri string")
    spans = text.tag(docs, terms, "id")
    assert got(spans.select("start", "end", "iri")) == {(4, 9, "H:1"), (4, 14, "H:2"), (18, 23, "H:1")}
    assert got(text.without_contained(spans, "id").select("start", "end")) == {(4, 14), (18, 23)}
    t = spark.createDataFrame([("A:1", "l", "Heart  Wall"), ("B:1", "l", " heart wall"), ("C:1", "l", "HEART wall"), ("A:2", "l", "heart wall")], "id string, field string, value string")
    assert text.lexmatch(t).count() == 5
    best = text.lexmatch(t, [{"predicate": "skos:exactMatch", "weight": 2.0, "subject": ["l"], "object": ["l"]}], minimum=0.7)
    assert {round(r["confidence"], 3) for r in best.collect()} == {0.8}
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [3.0, 0.0]), ("z", [0.0, 0.0])], "k string, embedding array<double>")
    assert {(a, b, round(s, 6)) for a, b, s in got(vectors.semsim(v, v, "k", 0.5)) if a < b} == {("a", "c", 1.0)}
    assert [r["k"] for r in vectors.search(v, [1.0, 0.1], "k", 2).collect()] == ["a", "c"]
    mean = vectors.average(v.withColumn("g", F.lit(1)), "g").first()["embedding"]
    assert mean == pytest.approx([0.8944, 0.4472], abs=1e-3)
    with pytest.raises(ValueError):
        vectors.average(v.union(spark.createDataFrame([("q", [1.0])], v.schema)), "k")


def test_tags_are_those_of_the_sql(spark, tmp_path):
    """Capitals beyond A-Z, those whose lower case depends on the place or has two characters, items of any length, nulls and repeated rows."""
    duckdb = pytest.importorskip("duckdb")
    from quillgraph.plans.registry import QUERIES, SQL

    docs = ["QUÉ ES EL SEÑOR", "qué es el señor", "ΟΔΟΣ ΜΟΥ", "οδος, οδοσ", "İstanbul ISTANBUL i\u0307", "STRASSE Straße ẞ", "", None, "a", "Å \U00010400 \u0000x"]
    items = ["Señor", "SEÑOR", "ΟΔΟΣ", "οδοσ μου", "istanbul", "İ", "i\u0307", "ß", "ss", "a", "", None, "\U00010428 ", "å", "\u0000X"]
    spark.createDataFrame([*enumerate(docs), (None, docs[0]), (1, docs[1])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*enumerate(items), (None, "es"), (0, "es"), (0, "Señor")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = duckdb.connect()
    for name in ("documents", "benchmark"):
        plain.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = QUERIES["tag_documents"](spark, str(tmp_path)).collect()
    want = plain.execute(SQL["tag_documents"]).fetchall()
    assert len(found) == len(want) and {tuple(r) for r in found} == set(want) and (0, 1) in set(want)


def test_incremental_closure(spark, tmp_path):
    rows = [("a", "b"), ("c", "d"), ("b", "c"), ("d", "e"), ("z", "a")]
    inc = IncrementalClosure(spark)
    for i in range(0, 5, 2):
        inc.add(spark.createDataFrame(rows[i : i + 2], "subject string, object string"))
    whole = closure(spark.createDataFrame(rows, "subject string, object string"), by=()).select("subject", "object")
    assert got(inc.pairs) == got(whole)
    # a new object on the same folder goes on; a batch that comes again changes nothing
    again = IncrementalClosure(spark, inc.at)
    assert got(again.pairs) == got(whole)
    again.add(spark.createDataFrame(rows[4:], "subject string, object string"), 2)
    assert got(again.pairs) == got(whole)
    again.add(spark.createDataFrame([("e", "f")], "subject string, object string"))
    assert got(again.pairs.filter("object = 'f'")) == {(x, "f") for x in "abcdez"}


def test_incremental_closure_goes_on_after_a_restart(spark, tmp_path):
    schema = "subject string, object string"
    for i, row in enumerate([("a", "b"), ("b", "c")]):
        spark.createDataFrame([row], schema).write.mode("append").parquet(str(tmp_path / "in"))
        inc = IncrementalClosure(spark)
        query = inc.start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "at"))
        query.processAllAvailable()
        query.stop()
        assert got(inc.pairs) == ({("a", "b")} if i == 0 else {("a", "b"), ("b", "c"), ("a", "c")})
