"""The relational view layer over ``statements`` and ``entailed_edge``.

``Views(statements, entailed_edge)[name]`` is a lazy DataFrame. By default views give the results of the published
definitions, surprises included: the two (ir)reflexive views are each other's, one-letter prefixes count as blank
nodes, ``node`` leaves out nodes that only occur as objects, and the whitespace lint also reports leading blanks.
``strict=False`` gives what the names say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure, paths

COLUMNS = ("stanza", "subject", "predicate", "object", "value", "datatype", "language")

#: Views that keep the statements of one predicate.
BY_PREDICATE = {
    "rdf_type_statement": "rdf:type",
    "rdfs_subclass_of_statement": "rdfs:subClassOf",
    "rdfs_subproperty_of_statement": "rdfs:subPropertyOf",
    "rdfs_label_statement": "rdfs:label",
    "rdfs_domain_statement": "rdfs:domain",
    "rdfs_range_statement": "rdfs:range",
    "rdf_first_statement": "rdf:first",
    "rdf_rest_statement": "rdf:rest",
    "owl_imports_statement": "owl:imports",
    "owl_inverse_of_statement": "owl:inverseOf",
    "owl_complement_of_statement": "owl:complementOf",
    "owl_equivalent_class_statement": "owl:equivalentClass",
    "owl_same_as_statement": "owl:sameAs",
    "owl_disjoint_class_statement": "owl:disjointWith",
    "has_text_definition_statement": "IAO:0000115",
    "has_exact_synonym_statement": "oio:hasExactSynonym",
    "has_broad_synonym_statement": "oio:hasBroadSynonym",
    "has_narrow_synonym_statement": "oio:hasNarrowSynonym",
    "has_related_synonym_statement": "oio:hasRelatedSynonym",
    "has_exact_match_statement": "skos:hasExactMatch",
    "has_broad_match_statement": "skos:hasBroadMatch",
    "has_narrow_match_statement": "skos:hasNarrowMatch",
    "has_related_match_statement": "skos:hasRelatedMatch",
    "has_dbxref_statement": "oio:hasDbXref",
    "contributor": "dcterms:contributor",
    "creator": "dcterms:creator",
}
#: Views of the nodes of one type.
BY_TYPE = {
    "rdf_list_node": "rdf:List",
    "class_node": "owl:Class",
    "property_node": "owl:Property",
    "named_individual_node": "owl:NamedIndividual",
    "ontology_node": "owl:Ontology",
    "object_property_node": "owl:ObjectProperty",
    "transitive_property_node": "owl:TransitiveProperty",
    "symmetric_property_node": "owl:SymmetricProperty",
    "asymmetric_property_node": "owl:AsymmetricProperty",
    "annotation_property_node": "owl:AnnotationProperty",
}
#: Restrictions by the predicate of their filler.
RESTRICTIONS = {"owl_some_values_from": "owl:someValuesFrom", "owl_all_values_from": "owl:allValuesFrom", "owl_has_value": "owl:hasValue", "owl_has_self": "owl:hasSelf"}
#: Unions of predicates.
BY_PREDICATES = {
    "has_synonym_statement": ["oio:hasExactSynonym", "oio:hasBroadSynonym", "oio:hasNarrowSynonym", "oio:hasRelatedSynonym"],
    "has_match_statement": ["skos:hasExactMatch", "skos:hasBroadMatch", "skos:hasNarrowMatch", "skos:hasRelatedMatch"],
    "has_mapping_statement": ["skos:hasExactMatch", "skos:hasBroadMatch", "skos:hasNarrowMatch", "skos:hasRelatedMatch", "oio:hasDbXref"],
    "ontology_status_statement": ["<http://obofoundry.github.io/vocabulary/activity_status>", "pav:status"],
}
#: Tables that the published schema declares and never fills.
EMPTY = {
    "rdf_level_summary_statistic": "element string, count_value bigint",
    "anonymous_expression": "id string",
    "anonymous_class_expression": "id string",
    "anonymous_property_expression": "id string",
    "anonymous_individual_expression": "id string",
    "owl_restriction": "on_property string, filler string, id string",
    "owl_complex_axiom": "subject string, predicate string, object string",
    "repair_action": "subject string, description string",
    "problem": "subject string, predicate string, value string",
    "lexical_problem": "subject string, predicate string, value string",
    "relation_graph_construct": "subject string, predicate string, object string",
    "subgraph_query": "subject string, predicate string, object string, anchor_object string, anchor_predicate string",
    "term_association": "id string, subject string, predicate string, object string, evidence_type string, publication string, source string",
}
_REIFIED = ("owl:annotatedSource", "owl:annotatedProperty", "owl:annotatedTarget")


class Views:
    def __init__(self, statements: DataFrame, entailed_edge: DataFrame | None = None, strict: bool = True):
        self.statements = statements.select(*COLUMNS)
        self._entailed, self.strict = entailed_edge, strict
        self._made: dict[str, DataFrame] = {}

    @property
    def entailed_edge(self) -> DataFrame:
        if self._entailed is None:
            self._entailed = closure(self["edge"]).select("subject", "predicate", "object")
        return self._entailed

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        s = self.statements
        if name in BY_PREDICATE:
            return s.filter(F.col("predicate") == BY_PREDICATE[name])
        if name in BY_PREDICATES:
            return s.filter(F.col("predicate").isin(BY_PREDICATES[name])).distinct()
        if name in BY_TYPE:
            return self._typed(BY_TYPE[name])
        if name in RESTRICTIONS:
            return self._restriction(RESTRICTIONS[name])
        if name in EMPTY:
            return s.sparkSession.createDataFrame([], EMPTY[name])
        if name not in _MADE:
            raise KeyError(name)
        return _MADE[name](self)

    def _typed(self, kind: str) -> DataFrame:
        return self["rdf_type_statement"].filter(F.col("object") == kind).select(F.col("subject").alias("id")).distinct()

    def _restriction(self, predicate: str) -> DataFrame:
        on = self.statements.filter("predicate = 'owl:onProperty'").select(F.col("subject").alias("id"), F.col("object").alias("on_property"))
        filler = self.statements.filter(F.col("predicate") == predicate)
        if predicate == "owl:hasSelf":
            filler = filler.filter("value = 'true'")
        return on.join(filler.select(F.col("subject").alias("id"), F.col("object").alias("filler")), "id").select("id", "on_property", "filler")

    def _blank(self, column: str):
        return F.col(column).rlike("^.:" if self.strict else "^_:")

    def _reified(self) -> DataFrame:
        source, prop, target = (self.statements.filter(F.col("predicate") == p) for p in _REIFIED)
        return (
            source.select(F.col("subject").alias("id"), "stanza", F.col("object").alias("subject"))
            .join(prop.select(F.col("subject").alias("id"), F.col("object").alias("predicate")), "id")
            .join(target.select(F.col("subject").alias("id"), "object", "value", "datatype", "language"), "id")
        )


def _view(make: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    _MADE[make.__name__] = make
    return make


_MADE: dict[str, Callable[[Views], DataFrame]] = {}
_EDGE = ("subject", "predicate", "object")


@_view
def node_to_node_statement(v: Views) -> DataFrame:
    return v.statements.filter("object is not null")


@_view
def node_to_value_statement(v: Views) -> DataFrame:
    return v.statements.filter("value is not null")


@_view
def rdfs_subclass_of_named_statement(v: Views) -> DataFrame:
    return v["rdfs_subclass_of_statement"].filter(~v._blank("object"))


@_view
def rdf_rest_transitive_statement(v: Views) -> DataFrame:
    return paths(v["rdf_rest_statement"], by=()).select("subject", "object")


@_view
def rdf_list_member_statement(v: Views) -> DataFrame:
    first = v["rdf_first_statement"].select(F.col("subject").alias("cell"), F.col("object").alias("member"))
    later = v["rdf_rest_transitive_statement"].join(first, F.col("object") == F.col("cell")).select("subject", F.col("member").alias("object"))
    return later.union(first.select("cell", "member")).distinct()


@_view
def node(v: Views) -> DataFrame:
    objects = v.statements.filter("datatype is not null" if v.strict else "object is not null")
    return v.statements.select(F.col("subject").alias("id")).union(objects.select("object")).distinct()


@_view
def node_identifier(v: Views) -> DataFrame:
    has = F.instr("id", ":")
    return v["node"].select("id", F.when(has > 0, F.substring_index("id", ":", 1)).otherwise(F.when(F.col("id").isNotNull(), "")).alias("prefix"), F.expr("substr(id, instr(id, ':') + 1)").alias("local_identifier"))


@_view
def blank_node(v: Views) -> DataFrame:
    return v["node"].filter(v._blank("id"))


@_view
def iri_node(v: Views) -> DataFrame:
    return v["node"].filter(~v._blank("id"))


@_view
def count_of_predicates(v: Views) -> DataFrame:
    return v.statements.groupBy(F.col("predicate").alias("element")).agg(F.count("*").alias("count_value")).orderBy(F.desc("count_value"), "element")


@_view
def count_of_instantiated_classes(v: Views) -> DataFrame:
    return v["rdf_type_statement"].groupBy(F.col("object").alias("element")).agg(F.count("*").alias("count_value")).orderBy(F.desc("count_value"), "element")


@_view
def count_of_subclasses(v: Views) -> DataFrame:
    return v["rdfs_subclass_of_statement"].groupBy(F.col("object").alias("element")).agg(F.countDistinct("subject").alias("count_value")).orderBy(F.desc("count_value"), "element")


@_view
def reflexive_property_node(v: Views) -> DataFrame:
    return v._typed("owl:IrreflexiveProperty" if v.strict else "owl:ReflexiveProperty")


@_view
def irreflexive_property_node(v: Views) -> DataFrame:
    return v._typed("owl:ReflexiveProperty" if v.strict else "owl:IrreflexiveProperty")


@_view
def deprecated_node(v: Views) -> DataFrame:
    return v.statements.filter("predicate = 'owl:deprecated' and value = 'true'").select(F.col("subject").alias("id")).distinct()


@_view
def owl_reified_axiom(v: Views) -> DataFrame:
    return v._reified().select("id", *COLUMNS)


@_view
def owl_axiom(v: Views) -> DataFrame:
    return v["owl_reified_axiom"].union(v.statements.select(F.lit(None).cast("string").alias("id"), *COLUMNS)).distinct()


@_view
def owl_axiom_annotation(v: Views) -> DataFrame:
    about = v.statements.filter(~F.col("predicate").isin(*_REIFIED, "rdf:type"))
    about = about.select(F.col("stanza"), F.col("subject").alias("id"), *[F.col(c).alias(f"annotation_{c}") for c in ("subject", "predicate", "object", "value", "language", "datatype")])
    return v._reified().drop("stanza").join(about, "id").select("stanza", *COLUMNS[1:], "id", *[f"annotation_{c}" for c in ("subject", "predicate", "object", "value", "language", "datatype")])


@_view
def owl_subclass_of_some_values_from(v: Views) -> DataFrame:
    some = v["owl_some_values_from"].select(F.col("id").alias("object"), F.col("on_property").alias("p"), F.col("filler").alias("o"))
    return v["rdfs_subclass_of_statement"].select("stanza", "subject", "object").join(some, "object").select("stanza", "subject", F.col("p").alias("predicate"), F.col("o").alias("object"))


@_view
def owl_equivalent_to_intersection_member(v: Views) -> DataFrame:
    both = v.statements.filter("predicate = 'owl:intersectionOf'").select(F.col("subject").alias("object"), F.col("object").alias("list"))
    member = v["rdf_list_member_statement"].select(F.col("subject").alias("list"), F.col("object").alias("member"))
    return v["owl_equivalent_class_statement"].select("stanza", "subject", "object").join(both, "object").join(member, "list").select("stanza", "subject", F.col("member").alias("object"))


@_view
def orcid(v: Views) -> DataFrame:
    return v["rdfs_label_statement"].filter(F.lower("subject").startswith("orcid:")).select(F.col("subject").alias("id"), F.col("value").alias("label"))


@_view
def axiom_dbxref_annotation(v: Views) -> DataFrame:
    return v["owl_axiom_annotation"].filter("annotation_predicate = 'oio:hasDbXref'")


@_view
def trailing_whitespace_problem(v: Views) -> DataFrame:
    padded = F.col("value").endswith(" ")
    return v.statements.filter(padded | F.col("value").startswith(" ") if v.strict else padded).select("subject", "predicate", "value")


@_view
def property_used_with_datatype_values_and_objects(v: Views) -> DataFrame:
    with_objects = v.statements.filter("object is not null").select("predicate").distinct()
    return v.statements.filter("value is not null").join(with_objects, "predicate", "left_semi").select(F.col("predicate").alias("subject"), "predicate", F.col("datatype").alias("value")).distinct()


@_view
def node_with_two_labels_problem(v: Views) -> DataFrame:
    label = v["rdfs_label_statement"].filter("value is not null").select("subject", "predicate", "value")
    other = label.select("subject", F.col("value").alias("other"))
    return label.join(other, "subject").filter("value != other").select("subject", "predicate", "value")


@_view
def all_problems(v: Views) -> DataFrame:
    return v["node_with_two_labels_problem"].union(v["trailing_whitespace_problem"]).distinct()


@_view
def edge(v: Views) -> DataFrame:
    types = v["rdf_type_statement"].join(v["class_node"].withColumnRenamed("id", "object"), "object", "left_semi")
    arms = [v["owl_subclass_of_some_values_from"], v["rdfs_subclass_of_named_statement"], v["rdfs_subproperty_of_statement"], types]
    out = arms[0].select(*_EDGE)
    for arm in arms[1:]:
        out = out.union(arm.select(*_EDGE))
    return out.distinct()


def _anchored(v: Views, other: DataFrame, by: str, anchor: str) -> DataFrame:
    far = other.select(F.col(by).alias("_by"), F.col("predicate").alias("anchor_predicate"), F.col(anchor).alias("anchor_object"))
    return v["edge"].join(far, F.col("subject") == F.col("_by")).drop("_by")


@_view
def subgraph_edge_by_ancestor(v: Views) -> DataFrame:
    return _anchored(v, v.entailed_edge, "subject", "object")


@_view
def subgraph_edge_by_descendant(v: Views) -> DataFrame:
    return _anchored(v, v.entailed_edge, "object", "subject")


@_view
def subgraph_edge_by_ancestor_or_descendant(v: Views) -> DataFrame:
    return v["subgraph_edge_by_ancestor"].union(v["subgraph_edge_by_descendant"]).distinct()


@_view
def subgraph_edge_by_parent(v: Views) -> DataFrame:
    return _anchored(v, v["edge"], "subject", "object")


@_view
def subgraph_edge_by_child(v: Views) -> DataFrame:
    return _anchored(v, v["edge"], "object", "subject")


@_view
def subgraph_edge_by_self(v: Views) -> DataFrame:
    return v["edge"].select(*_EDGE, F.col("predicate").alias("anchor_predicate"), F.col("subject").alias("anchor_object"))


@_view
def entailed_subclass_of_edge(v: Views) -> DataFrame:
    return v.entailed_edge.filter("predicate = 'rdfs:subClassOf'")


@_view
def entailed_type_edge(v: Views) -> DataFrame:
    return v.entailed_edge.filter("predicate = 'rdf:type'")


@_view
def entailed_edge_cycle(v: Views) -> DataFrame:
    back = v.entailed_edge.select(F.col("object").alias("subject"), F.col("subject").alias("object"), F.col("predicate").alias("secondary_predicate"))
    return v.entailed_edge.join(back, ["subject", "object"]).select(*_EDGE, "secondary_predicate")


@_view
def entailed_edge_same_predicate_cycle(v: Views) -> DataFrame:
    return v["entailed_edge_cycle"].filter("predicate = secondary_predicate")


@_view
def transitive_edge(v: Views) -> DataFrame:
    return paths(v["edge"]) if v.strict else closure(v["edge"])


NAMES = [*BY_PREDICATE, *BY_PREDICATES, *BY_TYPE, *RESTRICTIONS, *_MADE]
