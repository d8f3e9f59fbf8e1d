"""Further syntaxes, documents of results, mapping sets from ontologies, editors' operators."""

import csv
import io
import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quillgraph.ontology import Ontology
from quillgraph.operators import authoring, mappings
from quillgraph.operators import axioms as ax
from quillgraph.plans.views import COLUMNS
from quillgraph.sources import lint, manchester, ofn, owx, patterns, templates
from quillgraph.sparql import results
from quillgraph.sparql.compile import Engine, quads_of

SUB = "rdfs:subClassOf"


def got(df):
    return {tuple(r) for r in df.collect()}


def statements(spark, rows):
    """(subject, predicate, object or None, value, datatype)."""
    return spark.createDataFrame([(s, s, p, o, v, d, None) for s, p, o, v, d in rows], ", ".join(f"{c} string" for c in COLUMNS))


def spo(df):
    return {(r["subject"], r["predicate"], r["object"] or r["value"]) for r in df.collect()}


def test_manchester():
    names = {"heart": "X:1", "part of": "r:p", "two words": "X:2"}
    for text, want in {
        "heart": "X:1",
        "'part of' some heart and not (X:3 or 'two words')": ["ObjectIntersectionOf", ["ObjectSomeValuesFrom", "r:p", "X:1"], ["ObjectComplementOf", ["ObjectUnionOf", "X:3", "X:2"]]],
        "r:q min 2 heart": ["ObjectMinCardinality", "2", "r:q", "X:1"],
        "r:q exactly 1": ["ObjectExactCardinality", "1", "r:q"],
        "inverse(r:q) only ({i:a, i:b})": ["ObjectAllValuesFrom", ["ObjectInverseOf", "r:q"], ["ObjectOneOf", "i:a", "i:b"]],
        "<http://e/A> that r:q Self": ["ObjectIntersectionOf", "http://e/A", ["ObjectHasSelf", "r:q"]],
        "r:q value i:a or r:q some r:z some X:1": ["ObjectUnionOf", ["ObjectHasValue", "r:q", "i:a"], ["ObjectSomeValuesFrom", "r:q", ["ObjectSomeValuesFrom", "r:z", "X:1"]]],
    }.items():
        assert manchester.expression(text, names) == want, text
        assert manchester.expression(manchester.written(want)) == want, text
    for bad in ("", "heart and", "(heart", "liver", "r:q some", "r:q min x heart", "heart )"):
        with pytest.raises(SyntaxError):
            manchester.expression(bad, names)


def test_owl_xml(spark, tmp_path):
    (tmp_path / "a.owx").write_text('''<Ontology xmlns="http://www.w3.org/2002/07/owl#" xml:base="http://e/o">
      <Prefix name="e" IRI="http://e/"/><Declaration><Class abbreviatedIRI="e:A"/></Declaration>
      <SubClassOf><Annotation><AnnotationProperty IRI="http://e/note"/><Literal xml:lang="en">say "so"</Literal></Annotation><Class IRI="http://e/A"/><ObjectSomeValuesFrom><ObjectProperty IRI="#r"/><Class IRI="http://e/B"/></ObjectSomeValuesFrom></SubClassOf>
      <EquivalentClasses><Class IRI="http://e/Z"/><ObjectMinCardinality cardinality="2"><ObjectProperty IRI="#r"/></ObjectMinCardinality><Class IRI="http://e/C"/></EquivalentClasses>
      <AnnotationAssertion><AnnotationProperty IRI="http://e/n"/><IRI>#x</IRI><Literal datatypeIRI="http://www.w3.org/2001/XMLSchema#integer">5</Literal></AnnotationAssertion></Ontology>''')
    a = Ontology.read(spark, str(tmp_path / "a.owx")).axioms
    want = ofn.parse('''Prefix(e:=<http://e/>) Ontology(<http://e/o> Declaration(Class(e:A)) SubClassOf(Annotation(e:note "say \\"so\\""@en) e:A ObjectSomeValuesFrom(<http://e/o#r> e:B))
      EquivalentClasses(e:C e:Z ObjectMinCardinality(2 <http://e/o#r>)) AnnotationAssertion(e:n <http://e/o#x> "5"^^<http://www.w3.org/2001/XMLSchema#integer>))''', expand=True)
    assert {r["body"] for r in a.collect()} == {w[2] for w in want} and {r["axiom_id"] for r in a.collect()} == {w[0] for w in want}
    assert owx.parse('<Ontology xmlns="http://www.w3.org/2002/07/owl#"/>') == []


def test_patterns(spark):
    pattern = {
        "classes": {"abnormal": "P:0", "quality": "P:q"}, "relations": {"has part": "r:h", "inheres in": "r:i"}, "vars": {"entity": "'anatomy'"}, "list_vars": {"also": "'x'"}, "data_vars": {"code": "xsd:string"},
        "name": {"text": "abnormal %s", "vars": ["entity"]}, "def": {"text": "Any abnormality of %s (%s).", "vars": ["entity", "short"]}, "equivalentTo": {"text": "'has part' some (quality and ('inheres in' some %s))", "vars": ["entity"]},
        "subClassOf": {"multi_clause": {"sep": " and ", "clauses": [{"text": "abnormal"}, {"text": "%s", "vars": ["also"]}]}}, "logical_axioms": [{"axiom_type": "GCI", "text": "%s SubClassOf 'has part' some quality", "vars": ["entity"]}],
        "substitutions": [{"in": "code", "out": "short", "match": "^.*-(\\w+)$", "sub": "\\1"}], "exact_synonym": {"value": "code"},
    }
    table = spark.createDataFrame([("X:1", "A:1", "C:1|C:2", "ab-cd"), ("X:2", "A:2", None, None), (None, "A:3", None, None)], "defined_class string, entity string, also string, code string")
    out = patterns.generate(table, pattern, {"A:1": "heart"})
    bodies = {r["body"] for r in out.collect()}
    assert {'["AnnotationAssertion", "rdfs:label", "X:1", "\\"abnormal heart\\""]', '["AnnotationAssertion", "IAO:0000115", "X:1", "\\"Any abnormality of heart (cd).\\""]', '["AnnotationAssertion", "oio:hasExactSynonym", "X:1", "\\"ab-cd\\""]'} <= bodies
    assert '["EquivalentClasses", "X:1", ["ObjectSomeValuesFrom", "r:h", ["ObjectIntersectionOf", "P:q", ["ObjectSomeValuesFrom", "r:i", "A:1"]]]]' in bodies
    assert '["SubClassOf", "X:1", ["ObjectIntersectionOf", "C:1", "C:2", "P:0"]]' in bodies and '["SubClassOf", "X:2", "P:0"]' in bodies and '["SubClassOf", "A:2", ["ObjectSomeValuesFrom", "r:h", "P:q"]]' in bodies
    assert not any("X:2" in b and "IAO" in b for b in bodies) and patterns.terms(pattern) == ["P:0", "P:q", "r:h", "r:i"]


def test_templates(spark):
    headers = {"i": "ID", "l": "LABEL", "t": "TYPE", "d": "A IAO:0000115", "n": ">AL rdfs:comment@en", "s": "SC 'part of' some % SPLIT=|", "e": "EC % and ('part of' some heart)", "k": "CLASS_TYPE", "c": "C %", "r": "RANGE", "x": "CHARACTERISTIC", "p": "IP %", "f": "I knows", "y": "AT ex:n^^xsd:integer"}
    rows = [
        ("X:1", "heart", None, "Pumps.", "note", "X:2|chest", None, "disjoint", "lung", None, None, None, None, "5"), ("X:2", "lung", "owl:Class", None, "unused", None, "chest", None, "heart", None, None, None, None, None), ("X:3", "chest", *[None] * 12),
        ("r:p", "part of", "owl:ObjectProperty", None, None, None, None, None, None, "heart", "transitive", "r:h", None, None), ("i:1", None, "lung", None, None, None, None, None, None, None, None, None, "i:2", None), (None, "nobody", *[None] * 12),
    ]
    table = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in headers))
    got_ = {r["body"] for r in templates.axioms(table, headers, {"knows": "r:k"}).collect()}
    want = [
        ["Declaration", ["Class", "X:1"]], ["AnnotationAssertion", "rdfs:label", "X:1", '"heart"'], ["AnnotationAssertion", ["Annotation", "rdfs:comment", '"note"@en'], "IAO:0000115", "X:1", '"Pumps."'], ["SubClassOf", "X:1", ["ObjectSomeValuesFrom", "r:p", "X:2"]], ["SubClassOf", "X:1", ["ObjectSomeValuesFrom", "r:p", "X:3"]],
        ["DisjointClasses", "X:1", "X:2"], ["AnnotationAssertion", "ex:n", "X:1", '"5"^^xsd:integer'], ["Declaration", ["Class", "X:2"]], ["AnnotationAssertion", "rdfs:label", "X:2", '"lung"'], ["EquivalentClasses", "X:2", ["ObjectIntersectionOf", "X:3", ["ObjectSomeValuesFrom", "r:p", "X:1"]]], ["SubClassOf", "X:2", "X:1"],
        ["Declaration", ["Class", "X:3"]], ["AnnotationAssertion", "rdfs:label", "X:3", '"chest"'], ["Declaration", ["ObjectProperty", "r:p"]], ["AnnotationAssertion", "rdfs:label", "r:p", '"part of"'], ["ObjectPropertyRange", "r:p", "X:1"], ["TransitiveObjectProperty", "r:p"], ["InverseObjectProperties", "r:p", "r:h"],
        ["Declaration", ["NamedIndividual", "i:1"]], ["ClassAssertion", "X:2", "i:1"], ["ObjectPropertyAssertion", "r:k", "i:1", "i:2"],
    ]
    assert got_ == {ofn.row(w)[2] for w in want}
    with pytest.raises(Exception, match="unknown template"):
        templates.axioms(table, {"i": "ID", "l": "NONSENSE x"}).collect()


def test_table_lint_and_translations(spark, tmp_path):
    (tmp_path / "t.tsv").write_bytes(b"# note\nid\tname\t\tid\nA\t x\ty\tz\nB\tq \t\n\nC\tr\r\ty\t\xc3\xa9\n")
    found = got(lint.lint_table(spark, str(tmp_path / "t.tsv"), "#").select("line", "code", "cell"))
    assert found == {(2, "E6", 3), (2, "E10", 1), (2, "E10", 4), (3, "E2", 2), (4, "E3", 2), (4, "E4", None), (5, "E5", None), (6, "E1", None), (6, "W1", None)}
    one = spark.createDataFrame([("X:2", "rdfs:label", "b", "NA"), ("X:1", "rdfs:label", "a", "eins")], "subject_id string, predicate_id string, source_value string, translation_value string")
    two = spark.createDataFrame([("X:1", "rdfs:label", "a", "eins", "de"), ("X:1", "rdfs:label", "a", "un", "fr")], "subject_id string, predicate_id string, source_value string, translation_value string, extra string")
    merged = lint.merge_translations([one, two])
    assert merged.columns == [*one.columns, "extra"] and [tuple(r) for r in merged.collect()] == [("X:1", "rdfs:label", "a", "eins", None), ("X:1", "rdfs:label", "a", "eins", "de"), ("X:1", "rdfs:label", "a", "un", "fr"), ("X:2", "rdfs:label", "b", None, None)]
    assert lint.merge_translations([one, two], known_only=True).columns == one.columns
    s = statements(spark, [("X:1", "rdfs:label", None, "a", "xsd:string"), ("X:2", "rdfs:label", None, "b", "xsd:string")])
    done = spark.createDataFrame([("X:1", "rdfs:label", "a", "eins", "de", "OFFICIAL")], "subject_id string, predicate_id string, source_value string, translation_value string, translation_language string, translation_status string")
    assert [r["subject_id"] for r in lint.untranslated(s, done, "de").collect()] == ["X:2"]
    assert got(lint.translated(done).select("subject", "value", "language")) == {("X:1", "eins", "de")}


def test_mapping_sets_from_ontologies(spark):
    s = statements(spark, [
        ("o", "oio:treat-xrefs-as-equivalent", None, "A", None), ("o", "oio:treat-xrefs-as-genus-differentia", None, "B part_of NCBITaxon:1", None),
        *[(f"X:{i}", "rdf:type", "owl:Class", None, None) for i in range(1, 5)], ("X:1", "rdfs:label", None, "one", "xsd:string"), ("X:1", "oio:hasDbXref", None, "A:1", "xsd:string"), ("X:1", "oio:hasDbXref", None, "B:1", "xsd:string"),
        ("X:2", "oio:hasDbXref", None, "A:1", "xsd:string"), ("X:3", "oio:hasDbXref", None, "C:1", "xsd:string"), ("X:4", "oio:hasDbXref", None, "A:4", "xsd:string"), ("X:4", "owl:deprecated", None, "true", "xsd:boolean"), ("r:1", "oio:hasDbXref", None, "A:9", "xsd:string"),
    ])
    keys = lambda **k: got(mappings.xref_extract(s, **k).select("subject_id", "predicate_id", "object_id"))
    base = {("X:1", "skos:exactMatch", "A:1"), ("X:1", "semapv:crossSpeciesExactMatch", "B:1"), ("X:2", "skos:exactMatch", "A:1")}
    assert keys() == base and keys(every=True) == base | {("X:3", "oio:hasDbXref", "C:1")} and keys(obsolete=True) == base | {("X:4", "skos:exactMatch", "A:4")}
    assert keys(predicates={"C": "skos:closeMatch"}, ignore_header=True) == {("X:3", "skos:closeMatch", "C:1")}
    assert got(mappings.xref_extract(s, drop_duplicates=True).select("object_id", "mapping_cardinality")) == {("B:1", "1:n")}
    df = spark.createDataFrame([("B:1", "skos:exactMatch", "Y:1", "0.91249", "t", "a|b"), ("A:1", "skos:broadMatch", "Y:2", "1.0", "t", None)], "subject_id string, predicate_id string, object_id string, confidence string, mapping_tool string, author_id string")
    rows, head = mappings.canonicalize(df, {"curie_map": {"A": "a", "B": "b", "Y": "y", "Z": "z", "skos": "s"}, "license": "x"})
    assert head == {"curie_map": {"A": "a", "B": "b", "Y": "y"}, "license": "x", "mapping_tool": "t"} and rows.columns == ["subject_id", "predicate_id", "object_id", "author_id", "confidence"]
    assert [(r["subject_id"], r["confidence"]) for r in rows.collect()] == [("A:1", "1"), ("B:1", "0.912")]
    assert mappings.annotate({"creator_id": "a", "license": "x"}, {"creator_id": ["b"], "license": ["y", "z"]}) == {"creator_id": ["a", "b"], "license": "z"}
    assert mappings.annotate({"creator_id": ["a"]}, {"creator_id": ["b"]}, replace=True) == {"creator_id": ["b"]}
    made = mappings.inject(df, [{"where": {"predicate_id": ["skos:broad*"]}, "do": "stop"}, {"do": "make", "subject": "{subject_id}", "predicate": "oio:hasDbXref", "value": "{object_id} by {mapping_tool}"}])
    assert spo(made) == {("B:1", "oio:hasDbXref", "Y:1 by t")}
    lines = [json.loads(r["value"]) for r in mappings.to_json(df, head).collect()]
    assert lines[0] == head and {"confidence": 0.91249, "author_id": ["a", "b"]}.items() <= lines[1].items()


def test_authoring(spark):
    s = statements(spark, [
        ("http://o", "rdf:type", "owl:Ontology", None, None), ("http://o", "owl:versionIRI", "http://o/1", None, None), ("X:0000001", "rdf:type", "owl:Class", None, None), ("X:0000001", "rdfs:label", None, "Heart", "xsd:string"), ("X:0000001", "oio:inSubset", "X:slim", None, None), ("X:0000001", "IAO:0000115", None, "Pumps.", "xsd:string"),
        ("X:990002", "rdf:type", "owl:Class", None, None), ("X:990002", SUB, "X:0000001", None, None), ("X:990002", "IAO:0000115", None, "Like $sub_X:0000001 or $sub_Y:9", "xsd:string"), ("X:990001", "rdf:type", "owl:Class", None, None), ("X:990001", SUB, "X:990002", None, None), ("X:990001", "IAO:0000115", None, "$sub_X:0000001", "xsd:string"), ("X:990001", "oio:inSubset", "X:slim", None, None),
        ("X:990002", SUB, "_:r", None, None), ("_:r", "owl:someValuesFrom", "X:0000001", None, None), ("X:990001", "r:x", "_:q", None, None), ("_:q", "owl:someValuesFrom", "X:990002", None, None),
    ])
    a = authoring.annotate(s, ontology="http://n", version="http://n/2", values={"dc:title": "T"}, links={"dcterms:license": "http://l"}, defined_by=True)
    head = {(p, v) for x, p, v in spo(a) if x == "http://n"}
    assert head == {("rdf:type", "owl:Ontology"), ("owl:versionIRI", "http://n/2"), ("dc:title", "T"), ("dcterms:license", "http://l")} and a.filter("predicate = 'rdfs:isDefinedBy' and object = 'http://n'").count() == 3
    with pytest.raises(ValueError):
        authoring.annotate(s.filter("predicate <> 'rdf:type'"))
    n = authoring.normalize(s, source=True)
    assert spo(n) - spo(s) == {("X:slim", "rdfs:subPropertyOf", "oio:SubsetProperty"), ("http://o", "dc:source", "http://o/1")} and authoring.normalize(s, prefixes=("Z:",)).count() == s.count()
    names = authoring.mint(s, "X:99", "X:", 1, 100)
    assert got(names) == {("X:990001", "X:0000002"), ("X:990002", "X:0000003")}
    assert ("X:0000002", SUB, "X:0000003") in spo(authoring.renamed(s, names)) and authoring.renamed(s, names).count() == s.count()
    with pytest.raises(ValueError):
        authoring.mint(s, "X:99", "X:", 1, 3)
    assert spo(authoring.grep(s, "heart").filter("subject = 'X:0000001'")) == {x for x in spo(s) if x[0] == "X:0000001"} and ("X:990002", SUB, "X:0000001") in spo(authoring.grep(s, "X_0000001", ids_only=True))
    assert authoring.grep(s, "heart", ids_only=True).isEmpty() and authoring.grep(s, "heart", case=True).isEmpty()
    d = {x: v for x, p, v in spo(authoring.rewrite_definitions(s)) if p == "IAO:0000115"}
    assert d == {"X:0000001": "Pumps.", "X:990002": "Like Pumps. or No definition for Y:9.", "X:990001": "Pumps (from X)."}
    cut = spo(authoring.subset(s, "X:slim"))
    assert not any("X:990002" in x or "_:r" in x or "_:q" in x for x in cut) and ("X:990001", "rdf:type", "owl:Class") in cut
    assert ("X:990001", SUB, "X:0000001") in spo(authoring.subset(s, "X:slim", fill_gaps=True)) and spo(authoring.subset(s, "X:slim", ancestors=True)) == spo(s)
    macro = s.union(statements(spark, [("r:m", "OMO:0002000", None, "CONSTRUCT { ?x ex:over ?y } WHERE { ?x rdfs:subClassOf ?y FILTER(!isBlank(?y)) }", "xsd:string")]))
    assert got(authoring.expand(macro)) == {("<X:990002>", "<ex:over>", "<X:0000001>", "r:m"), ("<X:990001>", "<ex:over>", "<X:990002>", "r:m")} and authoring.expand(macro, never=("r:m",)).isEmpty()


def test_modules_and_taxa(spark):
    of = lambda *lines: ofn.axioms(spark, "Ontology(<http://x>\n" + "\n".join(lines) + "\n)")
    a = of("SubClassOf(:A :B)", "SubClassOf(:B :C)", "SubClassOf(:X :A)", "SubClassOf(:C ObjectSomeValuesFrom(:r :D))", "EquivalentClasses(:E ObjectIntersectionOf(:A :F))", "Declaration(Class(:X))", "Declaration(Class(:B))")
    seed = spark.createDataFrame([(":A",)], "id string")
    logic = lambda df: {r["body"] for r in df.filter("type <> 'Declaration'").collect()}
    up = {'["SubClassOf", ":A", ":B"]', '["SubClassOf", ":B", ":C"]', '["SubClassOf", ":C", ["ObjectSomeValuesFrom", ":r", ":D"]]'}
    assert logic(ax.extract_bottom(a, seed)) == up and logic(ax.extract_top(a, seed)) == {'["SubClassOf", ":X", ":A"]', '["EquivalentClasses", ":E", ["ObjectIntersectionOf", ":A", ":F"]]'}
    assert logic(ax.extract(a, seed, "star")) == set()
    two = spark.createDataFrame([(":A",), (":C",)], "id string")
    assert logic(ax.extract_star(a, two)) == {'["SubClassOf", ":A", ":B"]', '["SubClassOf", ":B", ":C"]'}
    edit = of("SubClassOf(:Mine :B)")
    assert logic(authoring.import_module(edit, a)) == up - {'["SubClassOf", ":A", ":B"]'}
    noted = of('SubClassOf(Annotation(rdfs:comment "x") Annotation(rdfs:seeAlso "y") :A :B)')
    assert logic(authoring.strip_axiom_annotations(noted)) == {'["SubClassOf", ":A", ":B"]'} and "seeAlso" in next(iter(logic(authoring.strip_axiom_annotations(noted, ("rdfs:comment",)))))
    taxa = of("DisjointClasses(:Bird :Fish)", "SubClassOf(:Wing ObjectSomeValuesFrom(RO:0002160 :Bird))", "SubClassOf(:Feather ObjectSomeValuesFrom(:part :Wing))", "SubClassOf(:Plume :Wing)", "SubClassOf(:Tail :Part)", "AnnotationAssertion(RO:0002161 :Beak :Fish)", "Declaration(Class(:Beak))")
    assert {r["id"] for r in authoring.species_subset(taxa, ":Fish").collect()} & {":Wing", ":Plume", ":Beak", ":Tail"} == {":Wing", ":Plume", ":Beak"}


def test_result_documents(spark):
    s = statements(spark, [("X:1", "rdfs:label", None, 'a "b", <c> & d', "xsd:string"), ("X:1", "ex:n", None, "5", "xsd:integer"), ("X:2", "ex:n", None, "7", "xsd:integer")])
    e = Engine(quads_of(s))
    rows = e.solutions("SELECT ?x ?l ?n { ?x ex:n ?n OPTIONAL { ?x rdfs:label ?l } } ORDER BY ?n")
    text = lambda fmt: "\n".join(r["value"] for r in results.document(rows, fmt).collect())
    doc = json.loads(text("json"))
    assert doc["head"]["vars"] == ["x", "l", "n"] and doc["results"]["bindings"] == [
        {"x": {"type": "uri", "value": "X:1"}, "l": {"type": "literal", "value": 'a "b", <c> & d'}, "n": {"type": "literal", "value": "5", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}},
        {"x": {"type": "uri", "value": "X:2"}, "n": {"type": "literal", "value": "7", "datatype": "http://www.w3.org/2001/XMLSchema#integer"}},
    ]
    assert list(csv.reader(io.StringIO(text("csv")))) == [["x", "l", "n"], ["X:1", 'a "b", <c> & d', "5"], ["X:2", "", "7"]]
    assert text("tsv").split("\n")[0] == "?x\t?l\t?n" and text("tsv").split("\n")[2].split("\t")[:2] == ["<X:2>", ""]
    ns = "{http://www.w3.org/2005/sparql-results#}"
    assert [b.findtext(f"{ns}binding[@name='l']/{ns}literal") for b in ET.fromstring(text("xml")).iter(f"{ns}result")] == ['a "b", <c> & d', None]
    assert json.loads("".join(r["value"] for r in results.document(rows.limit(0), "json").collect()))["results"]["bindings"] == []
    assert "Scan" in e.explain("SELECT ?x { ?x ex:n ?n }") and results.format_of("a/b.srx") == "xml"
    with pytest.raises(ValueError):
        results.format_of("a.doc")


def test_paths_from_known_ends(spark):
    rows = [(f"n{i}", SUB, f"n{i + 1}", None, None) for i in range(6)] + [("n6", SUB, "n3", None, None), ("n2", "ex:mark", "yes", None, None), ("n5", "ex:mark", "yes", None, None), ("z1", SUB, "z2", None, None)]
    e = Engine(quads_of(statements(spark, rows)))
    ids = lambda q: sorted(r[0] for r in e.query(q).collect())
    assert ids("SELECT ?x { <n4> rdfs:subClassOf* ?x }") == ["n3", "n4", "n5", "n6"] and ids("SELECT ?x { <n4> rdfs:subClassOf+ ?x }") == ["n3", "n4", "n5", "n6"]
    assert ids("SELECT ?x { ?x rdfs:subClassOf+ <n2> }") == ["n0", "n1"] and ids("SELECT ?x { <n0> rdfs:subClassOf/^rdfs:subClassOf ?x }") == ["n0"]
    assert ids("SELECT ?y { ?x ex:mark yes: . ?x rdfs:subClassOf* ?y }".replace("yes:", "<yes>")) == sorted(["n2", "n3", "n4", "n5", "n6"] + ["n3", "n4", "n5", "n6"])
    assert ids("SELECT ?x { <nowhere> rdfs:subClassOf* ?x }") == ["nowhere"] and ids("SELECT ?x { <n0> (rdfs:subClassOf|ex:mark)? ?x }") == ["n0", "n1"]
    whole = {tuple(r) for r in e.query("SELECT ?a ?b { ?a rdfs:subClassOf+ ?b }").collect()}
    for a in ("n0", "n3", "z1"):
        assert {b for x, b in whole if x == a} == set(ids(f"SELECT ?b {{ <{a}> rdfs:subClassOf+ ?b }}"))


def test_joins_on_variables_that_may_be_unbound(spark):
    rows = [("a", "ex:p", "1", None, None), ("b", "ex:p", "2", None, None), ("a", "ex:l", None, "x", "xsd:string"), ("c", "ex:q", None, "x", "xsd:string"), ("d", "ex:q", None, "y", "xsd:string")]
    e = Engine(quads_of(statements(spark, rows)))
    text = "SELECT ?s ?v ?t { ?s ex:p ?o OPTIONAL { ?s ex:l ?v } ?t ex:q ?v }"
    assert got(e.query(text)) == {("a", "x", "c"), ("b", "x", "c"), ("b", "y", "d")}
    assert "NestedLoop" not in e.explain("SELECT ?s ?t { ?s ex:p ?o OPTIONAL { ?s ex:l ?v } { ?t ex:q ?v . ?s ex:p ?z } }")


def test_statements_after_updates(spark):
    s = statements(spark, [("_:x", "owl:annotatedSource", "A", None, None), ("_:x", "owl:annotatedProperty", SUB, None, None), ("_:x", "owl:annotatedTarget", "B", None, None), ("_:y", "owl:annotatedSource", "A", None, None), ("_:y", "owl:annotatedProperty", "rdfs:label", None, None), ("_:y", "owl:annotatedTarget", None, "l", "xsd:string"), ("A", "rdfs:label", None, "l", "xsd:string"), ("_:l", "rdf:first", "A", None, None)])
    assert spo(results.reasserted(s)) - spo(s) == {("A", SUB, "B")} and spo(results.lists_typed(s)) - spo(s) == {("_:l", "rdf:type", "rdf:List")}
    o = Ontology(axioms=ofn.axioms(spark, "Ontology(<http://x> SubClassOf(:A :B) SubClassOf(:B :C))"), statements=s)
    assert [r[0] for r in o.query("SELECT ?x { <:A> rdfs:subClassOf ?x }", inferred=True).orderBy("x").collect()] == [":B", ":C"]
    assert {r[0] for r in o.dl_query("not-a-name:X or :C".replace("not-a-name:X or ", "")).collect()} == {":A", ":B"}
