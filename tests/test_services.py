"""Reasoner services on small sets of axioms with known results."""

import pytest

from quillgraph.operators import axioms as ax
from quillgraph.reason import services
from quillgraph.reason.el import classify
from quillgraph.sources import ofn


def of(spark, *lines):
    return ofn.axioms(spark, "Ontology(<http://x>\n" + "\n".join(lines) + "\n)")


def bodies(df):
    return {r["body"] for r in df.select("body").collect()}


def got(df):
    return {tuple(r) for r in df.collect()}


def test_taxonomy_and_assertions(spark):
    a = of(spark, "SubClassOf(:A :B)", "EquivalentClasses(:B :C)", "SubClassOf(:C :D)", "SubClassOf(:Bad :X)", "SubClassOf(:Bad :Y)", "DisjointClasses(:X :Y)",
           "ClassAssertion(:A :i)", "ObjectPropertyAssertion(:r :i :j)", "SubObjectPropertyOf(:r :s)", "ClassAssertion(:D :j)")
    c = classify(a)
    groups, edges = services.taxonomy(c)
    assert got(groups) == {(":A", ":A"), (":B", ":B"), (":C", ":B"), (":D", ":D"), (":X", ":X"), (":Y", ":Y"), (":Bad", "owl:Nothing")}
    assert got(edges) == {(":A", ":B"), (":B", ":D")}
    assert got(services.property_assertions(c)) == {(":i", ":r", ":j"), (":i", ":s", ":j")}
    assert got(services.direct_types(c)) == {(":i", ":A"), (":j", ":D")}


def test_inferred_axioms(spark):
    a = of(spark, "EquivalentClasses(:F ObjectIntersectionOf(:G ObjectSomeValuesFrom(:r :H)))", "SubClassOf(:K :G)", "SubClassOf(:K ObjectSomeValuesFrom(:r :L))", "SubClassOf(:L :H)",
           'SubClassOf(Annotation(rdfs:comment "x") :F :M)', "ClassAssertion(:K :k)")
    c = classify(a)
    of_a = lambda **k: services.inferred(a, classified=c, **k)
    assert bodies(of_a()) == {'["SubClassOf", ":K", ":F"]', '["SubClassOf", ":F", ":G"]'}
    new = of_a(indirect=True, annotate=True)
    assert '["SubClassOf", ":K", ":M", ["Annotations", ["Annotation", "oio:is_inferred", "\\"true\\""]]]' in bodies(new) and new.count() == 3
    assert '["SubClassOf", ":H", "owl:Thing"]' in bodies(of_a(owl_thing=True))
    assert bodies(of_a(generators=("ClassAssertion",), indirect=True)) == {f'["ClassAssertion", ":{x}", ":k"]' for x in "FGM"}
    whole = services.reason(a, classified=c)
    assert whole.count() == a.count() + 2
    assert {r["axiom_id"] for r in of_a().collect()} == {ofn.row(["SubClassOf", x, y])[0] for x, y in ((":K", ":F"), (":F", ":G"))}
    bad = ax.merge(a, of(spark, "SubClassOf(:Z :P)", "SubClassOf(:Z :Q)", "DisjointClasses(:P :Q)"))
    c_bad = classify(bad)
    with pytest.raises(ValueError, match=":Z"):
        services.inferred(bad, classified=c_bad)
    assert not any(":Z" in b for b in bodies(services.inferred(bad, unsatisfiable=True, classified=c_bad)))
    two = of(spark, "SubClassOf(:A :B)", "SubClassOf(:B :A)")
    c_two = classify(two)
    assert bodies(services.inferred(two, generators=("EquivalentClass",), classified=c_two)) == {'["EquivalentClasses", ":A", ":B"]'}
    with pytest.raises(ValueError):
        services.inferred(two, generators=("EquivalentClass",), equivalents="asserted-only", classified=c_two)


def test_alignment(spark):
    a = of(spark, "SubClassOf(:A :Root)", "SubClassOf(:B :A)", "SubClassOf(:P :Q)", "SubClassOf(ex:S :P)", 'AnnotationAssertion(owl:deprecated :Dead "true"^^xsd:boolean)', "Declaration(Class(:Dead))")
    roots = spark.createDataFrame([(":Root",)], "id string")
    assert got(services.unaligned(a, roots, "all")) == {(":P",), (":Q",), ("ex:S",)}
    assert got(services.unaligned(a, roots)) == {(":Q",)}
    assert got(services.unaligned(a, roots, "base-root", (":P", "ex:"))) == {(":P",)}


def test_explanations(spark):
    a = of(spark, "SubClassOf(:A :B)", "SubClassOf(:B :C)", "SubClassOf(:A :D)", "SubClassOf(:D :C)", "SubClassOf(:C :E)", "SubClassOf(:U :V)")
    found = services.explain(a, ":A", ":C", most=5)
    assert {frozenset(f) for f in found} == {frozenset(['["SubClassOf", ":A", ":B"]', '["SubClassOf", ":B", ":C"]']), frozenset(['["SubClassOf", ":A", ":D"]', '["SubClassOf", ":D", ":C"]'])}
    assert services.explain(a, ":U", ":C") == []
    bad = of(spark, "SubClassOf(:A :B)", "DisjointClasses(:B :C)", "SubClassOf(:A :C)", "SubClassOf(:X ObjectSomeValuesFrom(:r :A))", "SubClassOf(:A :Other)")
    (one,) = services.explain(bad, ":A")
    assert len(one) == 3 and not any("Other" in b for b in one)
    assert got(services.unsatisfiable_roots(bad)) == {(":A",)}


def test_small_and_large_reasoners_agree(spark):
    """The driver's rules against the tables' rules, for every class of a set that uses all of them."""
    a = of(spark, "SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(:B ObjectSomeValuesFrom(:s :C))", "SubObjectPropertyOf(ObjectPropertyChain(:r :s) :t)", "SubObjectPropertyOf(:t :u)", "TransitiveObjectProperty(:u)",
           "SubClassOf(ObjectSomeValuesFrom(:u :C) :D)", "SubClassOf(:C ObjectIntersectionOf(:E :F))", "SubClassOf(ObjectIntersectionOf(:E :F) :G)", "ObjectPropertyRange(:s :H)", "SubClassOf(ObjectSomeValuesFrom(:s :H) :I)", "ObjectPropertyDomain(:r :J)",
           "ReflexiveObjectProperty(:v)", "SubClassOf(ObjectSomeValuesFrom(:v :E) :K)", "DisjointClasses(:E :L)", "SubClassOf(:M ObjectSomeValuesFrom(:r ObjectIntersectionOf(:C :L)))", "EquivalentClasses(:N ObjectUnionOf(:O :P))", "SubClassOf(ObjectHasValue(:r :i) :Q)", "SubClassOf(:R ObjectHasValue(:r :i))")
    c = classify(a)
    large = got(c.S.filter(c._plain("x") & c._plain("d")).select("x", "d")) | {(r["id"], "owl:Nothing") for r in c.unsatisfiable().collect()}
    rows = [r["body"] for r in a.collect()]
    small = {(x, d) for x, _ in large for d in services._below(rows, x) if not d.startswith(("x:", "i:")) and d != "owl:Thing" and " in " not in d}
    assert small == large and (":A", ":D") in small and (":M", "owl:Nothing") in small and (":B", ":I") in small


def test_profiles(spark):
    a = of(spark, "SubClassOf(:A ObjectAllValuesFrom(:r :B))", "SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(ObjectUnionOf(:A :B) :C)", "InverseObjectProperties(:r :s)", "SubObjectPropertyOf(ObjectPropertyChain(:r :s) :t)",
           "SubClassOf(:A ObjectMinCardinality(2 :t :B))", "SubObjectPropertyOf(:t :u)", "FunctionalObjectProperty(:u)", "Declaration(ObjectProperty(:p))", "Declaration(AnnotationProperty(:p))")
    faults = lambda p: {(r["type"], r["violation"]) for r in services.profile_violations(a, p).collect()}
    assert faults("EL") == {("SubClassOf", "ObjectAllValuesFrom as supclass"), ("SubClassOf", "ObjectUnionOf as subclass"), ("InverseObjectProperties", "InverseObjectProperties axiom"), ("SubClassOf", "ObjectMinCardinality as supclass"), ("FunctionalObjectProperty", "FunctionalObjectProperty axiom")}
    assert ("SubClassOf", "ObjectUnionOf as subclass") in faults("QL") and ("SubObjectPropertyOf", "ObjectPropertyChain") in faults("QL")
    assert faults("RL") == {("SubClassOf", "ObjectSomeValuesFrom as supclass"), ("SubClassOf", "ObjectMinCardinality as supclass")}
    assert faults("DL") == {("SubClassOf", "non-simple role :t"), ("FunctionalObjectProperty", "non-simple role :u"), ("Declaration", "ObjectProperty and AnnotationProperty: :p")}


def test_materialised_axioms_are_as_written(spark):
    a = of(spark, "SubClassOf(:A ObjectSomeValuesFrom(:r :B))", "SubClassOf(:B :C)")
    new = {(r["axiom_id"], r["body"], tuple(r["signature"])) for r in ax.unmerge(ax.materialise(a), a).collect()}
    assert new == {(i, b, tuple(n)) for i, _, b, n in [ofn.row(["SubClassOf", ":A", ["ObjectSomeValuesFrom", ":r", ":C"]])]}
