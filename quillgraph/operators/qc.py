"""Quality rules over ``statements``: each gives the violations (``entity``, ``property``, ``value``).

``report`` runs a profile of rules; ``verify`` wants no violations. Subjects and objects that begin with ``_:`` are blank.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure

#: The default profile.
SEVERITIES = {
    "annotation_whitespace": "WARN",
    "deprecated_boolean_datatype": "ERROR",
    "deprecated_class_reference": "ERROR",
    "deprecated_property_reference": "ERROR",
    "duplicate_definition": "ERROR",
    "duplicate_exact_synonym": "WARN",
    "duplicate_label_synonym": "WARN",
    "duplicate_label": "ERROR",
    "duplicate_scoped_synonym": "WARN",
    "equivalent_pair": "WARN",
    "equivalent_class_axiom_no_genus": "WARN",
    "illegal_use_of_built_in_vocabulary": "ERROR",
    "invalid_xref": "WARN",
    "label_formatting": "ERROR",
    "label_whitespace": "ERROR",
    "lowercase_definition": "INFO",
    "missing_definition": "WARN",
    "missing_label": "ERROR",
    "missing_obsolete_label": "WARN",
    "missing_ontology_description": "ERROR",
    "missing_ontology_license": "ERROR",
    "missing_ontology_title": "ERROR",
    "missing_subset_declaration": "WARN",
    "missing_superclass": "INFO",
    "missing_synonymtype_declaration": "WARN",
    "misused_obsolete_label": "ERROR",
    "misused_replaced_by": "ERROR",
    "multiple_definitions": "ERROR",
    "multiple_equivalent_classes": "WARN",
    "multiple_equivalent_class_definitions": "ERROR",
    "multiple_labels": "ERROR",
    "invalid_entity_uri": "WARN",
}
#: Properties that rules speak of.
DEFINITIONS = ["IAO:0000115", "IAO:0000600"]
EXACT = ["IAO:0000118", "oio:hasExactSynonym"]
SYNONYMS = [*EXACT, "oio:hasBroadSynonym", "oio:hasRelatedSynonym", "oio:hasNarrowSynonym"]
NOT_CONTENT = ["rdf:type", "owl:equivalentClass", "owl:disjointWith", "owl:equivalentProperty", "owl:sameAs", "owl:differentFrom", "owl:inverseOf"]
BUILT_IN = ("owl:", "rdf:", "rdfs:", "xsd:")
TAXON_PROPERTIES = ["RO:0002161", "RO:0002175"]
IRI_PROPERTIES = [*TAXON_PROPERTIES, "foaf:depicted_by", "oio:inSubset", "dcterms:contributor"]
ABBREVIATED_SYNONYM_TYPES = ["OMO:0003000", "OMO:0003012"]

Rule = Callable[["Data"], DataFrame]
RULES: dict[str, Rule] = {}
CHECKS: dict[str, Rule] = {}


class Data:
    """Statements as triples: ``e`` (subject), ``p``, ``o`` (object or literal), ``lit`` (datatype, empty for objects), ``lang``."""

    def __init__(self, statements: DataFrame):
        kind = F.when(F.col("object").isNull(), F.coalesce("datatype", F.lit("xsd:string"))).otherwise("")
        self.t = statements.select(F.col("subject").alias("e"), F.col("predicate").alias("p"), F.coalesce("object", "value").alias("o"), kind.alias("lit"), F.coalesce("language", F.lit("")).alias("lang")).distinct()

    def of(self, *predicates: str) -> DataFrame:
        return self.t.filter(F.col("p").isin(*predicates))

    def named(self, *predicates: str) -> DataFrame:
        return self.of(*predicates).filter(~blank("e"))

    def typed(self, kind: str) -> DataFrame:
        return self.of("rdf:type").filter((F.col("o") == kind) & (F.col("lit") == "")).select("e").distinct()

    @property
    def deprecated(self) -> DataFrame:
        return self.of("owl:deprecated").filter("o = 'true' and lit = 'xsd:boolean'").select("e").distinct()

    def live(self, df: DataFrame) -> DataFrame:
        return df.join(self.deprecated, "e", "left_anti")


def blank(c: str) -> Column:
    return F.col(c).startswith("_:")


def out(df: DataFrame, entity: str = "e", prop: str | Column = "p", value: str | Column | None = "o") -> DataFrame:
    v = F.lit(None).cast("string") if value is None else F.col(value) if isinstance(value, str) else value
    return df.select(F.col(entity).alias("entity"), (F.col(prop) if isinstance(prop, str) else prop).alias("property"), v.alias("value")).distinct()


def shown(c: str) -> Column:
    """Blank nodes have no name to show."""
    return F.when(blank(c), "blank node").otherwise(F.col(c))


def rule(f: Rule) -> Rule:
    RULES[f.__name__] = f
    return f


def check(f: Rule) -> Rule:
    CHECKS[f.__name__] = f
    return f


def _padded(df: DataFrame) -> DataFrame:
    return df.filter(F.col("o").rlike("\\s$") | F.col("o").rlike("^\\s"))


@rule
def annotation_whitespace(d: Data) -> DataFrame:
    props = d.typed("owl:AnnotationProperty").withColumnRenamed("e", "p")
    return out(_padded(d.t.filter(~blank("e")).join(props, "p", "left_semi")))


@rule
def deprecated_boolean_datatype(d: Data) -> DataFrame:
    return out(d.named("owl:deprecated").filter("lit <> '' and lit <> 'xsd:boolean'"))


@rule
def deprecated_class_reference(d: Data) -> DataFrame:
    gone = d.typed("owl:Class").join(d.deprecated, "e")
    target = gone.withColumnRenamed("e", "o")
    between = ("owl:equivalentClass", "owl:disjointWith")
    kept = d.of("rdfs:subClassOf").filter(~F.col("o").isin("oio:ObsoleteClass", "owl:Thing"))
    arms = [
        out(kept.join(gone, "e", "left_semi")),
        out(d.of(*between).join(gone, "e", "left_semi")),
        out(d.of("rdfs:subClassOf", *between).join(target, "o", "left_semi"), "o", "p", "e"),
        out(d.of("owl:ObjectProperty", "owl:DataProperty").join(gone, "e", "left_semi")),
        out(d.of("owl:someValuesFrom", "owl:allValuesFrom").join(target, "o", "left_semi").join(d.typed("owl:Restriction"), "e", "left_semi").withColumn("e", F.lit("blank node"))),
    ]
    return reduce(DataFrame.union, arms).distinct()


@rule
def deprecated_property_reference(d: Data) -> DataFrame:
    gone = d.deprecated
    about = {"owl:ObjectProperty": ("owl:equivalentProperty", "rdfs:subPropertyOf", "owl:inverseOf"), "owl:DatatypeProperty": ("owl:equivalentProperty", "rdfs:subPropertyOf")}
    arms = [d.of(*ps).join(d.typed(kind).join(gone, "e").withColumnRenamed("e", "o"), "o", "left_semi").select(F.col("o").alias("e"), "p", F.col("e").alias("o")) for kind, ps in about.items()]
    arms.append(d.t.join(gone.withColumnRenamed("e", "p"), "p", "left_semi").select("e", "p", "o"))
    on = d.of("owl:onProperty").join(gone.withColumnRenamed("e", "o"), "o", "left_semi").join(d.typed("owl:Restriction"), "e", "left_semi").select(F.col("e").alias("o"), F.col("o").alias("prop"))
    arms.append(d.t.select("e", "o").join(on, "o").select("e", F.col("prop").alias("p"), "o"))
    return out(reduce(DataFrame.union, arms), value=shown("o"))


def _shared(df: DataFrame) -> DataFrame:
    """Rows whose property and value belong to more than one entity."""
    many = df.groupBy("p", "o", "lit", "lang").agg(F.count_distinct("e").alias("n")).filter("n > 1")
    return df.join(many, ["p", "o", "lit", "lang"], "left_semi")


@rule
def duplicate_definition(d: Data) -> DataFrame:
    return out(_shared(d.live(d.of(*DEFINITIONS))).filter(~blank("e")))


@rule
def duplicate_label(d: Data) -> DataFrame:
    # a pair of two deprecated entities does not count: with a live entity any other one does, of deprecated ones only live ones do
    labels = d.named("rdfs:label").join(d.deprecated.withColumn("dead", F.lit(1)), "e", "left")
    groups = labels.groupBy("p", "o", "lit", "lang").agg(F.count_distinct("e").alias("n"), F.count_distinct(F.when(F.col("dead").isNull(), F.col("e"))).alias("alive"))
    return out(labels.join(groups.filter("n > 1 and alive > 0"), ["p", "o", "lit", "lang"]))


@rule
def duplicate_exact_synonym(d: Data) -> DataFrame:
    parts = {name: d.of(p).select(F.col("e").alias("a"), F.col("o").alias(name)) for p, name in (("owl:annotatedSource", "e"), ("owl:annotatedProperty", "p"), ("owl:annotatedTarget", "o"))}
    short = d.of("oio:hasSynonymType").filter(F.col("o").isin(*ABBREVIATED_SYNONYM_TYPES)).select(F.col("e").alias("a"))
    excluded = parts["e"].join(parts["p"], "a").join(parts["o"], "a").join(short, "a", "left_semi").select("e", "p", "o")
    synonyms = d.live(d.named(*EXACT)).withColumn("k", F.upper("o"))
    many = synonyms.join(excluded, ["e", "p", "o"], "left_anti").groupBy("p", "k").agg(F.count_distinct("e").alias("n")).filter("n > 1")
    return out(synonyms.join(many, ["p", "k"], "left_semi"))


@rule
def duplicate_label_synonym(d: Data) -> DataFrame:
    synonym = d.live(d.named(*EXACT)).select("o", "lit", "lang", "p").distinct()
    return out(d.live(d.named("rdfs:label")).drop("p").join(synonym, ["o", "lit", "lang"]))


@rule
def duplicate_scoped_synonym(d: Data) -> DataFrame:
    rows = d.named(*SYNONYMS)
    many = rows.groupBy("e", "o", "lit", "lang").agg(F.count_distinct("p").alias("n")).filter("n > 1")
    return out(rows.join(many, ["e", "o", "lit", "lang"], "left_semi"))


@rule
def equivalent_pair(d: Data) -> DataFrame:
    return out(d.named("owl:equivalentClass").filter(~blank("o")))


@rule
def equivalent_class_axiom_no_genus(d: Data) -> DataFrame:
    r = d.typed("owl:Restriction").withColumnRenamed("e", "r")
    filler = d.of("owl:someValuesFrom").filter(~blank("o")).select(F.col("e").alias("r"), F.col("o").alias("v"))
    on = d.of("owl:onProperty").select(F.col("e").alias("r"), F.col("o").alias("on"))
    return out(d.named("owl:equivalentClass").select("e", F.col("o").alias("r")).join(r, "r").join(filler, "r").join(on, "r"), prop=shown("on"), value="v")


@rule
def illegal_use_of_built_in_vocabulary(d: Data) -> DataFrame:
    return out(d.t.filter("e = 'rdf:type'"), value=shown("o"))


@rule
def invalid_entity_uri(d: Data) -> DataFrame:
    e = F.col("e")
    bad = e.startswith("https://purl.obolibrary.org/obo/") | e.startswith("http://purl.org/obo/") | e.startswith("http://www.obofoundry.org/")
    return out(d.named("rdf:type").filter(bad), prop=F.lit(None).cast("string"))


@rule
def invalid_xref(d: Data) -> DataFrame:
    return out(d.named("oio:hasDbXref").filter(~F.col("o").rlike("^[A-Za-z_][A-Za-z0-9_.-]*[A-Za-z0-9_]:[^\\s]+$")))


@rule
def label_formatting(d: Data) -> DataFrame:
    return out(d.named("rdfs:label").filter(F.col("o").rlike("[\\n\\t]")))


@rule
def label_whitespace(d: Data) -> DataFrame:
    return out(_padded(d.named("rdfs:label")))


@rule
def lowercase_definition(d: Data) -> DataFrame:
    return out(d.live(d.named(*DEFINITIONS)).filter(~F.col("o").rlike("^[A-Z0-9]")))


def _described(d: Data) -> DataFrame:
    """Named entities that something is said of."""
    return d.t.filter(~blank("e") & ~F.col("p").isin(*NOT_CONTENT)).select("e").distinct()


def _without(df: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda x, y: x.join(y.select("e"), "e", "left_anti"), others, df)


def _missing(df: DataFrame, prop: str) -> DataFrame:
    return out(df, prop=F.lit(prop), value=None)


@rule
def missing_definition(d: Data) -> DataFrame:
    subsets = d.of("rdfs:subPropertyOf").filter("o = 'oio:SubsetProperty'")
    return _missing(_without(d.live(_described(d)), d.of(*DEFINITIONS), d.typed("owl:Ontology"), d.typed("owl:NamedIndividual"), subsets), "IAO:0000115")


@rule
def missing_label(d: Data) -> DataFrame:
    subsets = d.of("rdfs:subPropertyOf").filter("o = 'oio:SubsetProperty'")
    return _missing(_without(d.live(_described(d)), d.of("rdfs:label").filter("o <> ''"), d.typed("owl:Ontology"), subsets), "rdfs:label")


@rule
def missing_superclass(d: Data) -> DataFrame:
    return _missing(_without(d.live(_described(d)).join(d.typed("owl:Class"), "e", "left_semi"), d.of("rdfs:subClassOf")), "rdfs:subClassOf")


@rule
def missing_obsolete_label(d: Data) -> DataFrame:
    return out(d.named("rdfs:label").join(d.deprecated, "e", "left_semi").filter(~F.col("o").rlike("(?i)^obsolete")))


@rule
def misused_obsolete_label(d: Data) -> DataFrame:
    return out(d.live(d.named("rdfs:label")).filter((F.col("e") != "oio:ObsoleteClass") & F.col("o").rlike("(?i)^obsolete")))


@rule
def misused_replaced_by(d: Data) -> DataFrame:
    return out(d.live(d.named("IAO:0100001")))


def _ontology_without(d: Data, prop: str, *props: str) -> DataFrame:
    return _missing(_without(d.typed("owl:Ontology"), d.of(*(props or (prop,)))), prop)


@rule
def missing_ontology_description(d: Data) -> DataFrame:
    return _ontology_without(d, "dcterms:description", "dc:description", "dcterms:description")


@rule
def missing_ontology_license(d: Data) -> DataFrame:
    return _ontology_without(d, "dcterms:license")


@rule
def missing_ontology_title(d: Data) -> DataFrame:
    return _ontology_without(d, "dcterms:title", "dc:title", "dcterms:title")


def _undeclared(d: Data, used_by: str, kind: str) -> DataFrame:
    declared = d.of("rdfs:subPropertyOf").filter(F.col("o") == kind)
    return _missing(_without(d.of(used_by).select(F.col("o").alias("e")).distinct(), declared), "rdfs:subPropertyOf")


@rule
def missing_subset_declaration(d: Data) -> DataFrame:
    return _undeclared(d, "oio:inSubset", "oio:SubsetProperty")


@rule
def missing_synonymtype_declaration(d: Data) -> DataFrame:
    return _undeclared(d, "oio:hasSynonymType", "oio:SynonymTypeProperty")


def _several(df: DataFrame) -> DataFrame:
    """Rows of entities with more than one value for the property."""
    many = df.groupBy("e", "p").agg(F.count_distinct("o", "lit", "lang").alias("n")).filter("n > 1")
    return df.join(many, ["e", "p"], "left_semi")


@rule
def multiple_definitions(d: Data) -> DataFrame:
    return out(_several(d.live(d.named(*DEFINITIONS))))


@rule
def multiple_labels(d: Data) -> DataFrame:
    return out(_several(d.named("rdfs:label")))


@rule
def multiple_equivalent_classes(d: Data) -> DataFrame:
    unions = d.of("owl:unionOf").select(F.col("e").alias("o"))
    return out(_several(d.named("owl:equivalentClass").join(unions, "o", "left_anti")), value=shown("o"))


@rule
def multiple_equivalent_class_definitions(d: Data) -> DataFrame:
    lists = d.of("owl:intersectionOf").select(F.col("e").alias("o"), F.col("o").alias("list"))
    rows = d.named("owl:equivalentClass").join(lists, "o").withColumn("o", F.col("list"))
    return out(_several(rows), value=shown("o"))


@rule
def multiple_asserted_superclasses(d: Data) -> DataFrame:
    about = {name: d.of(p).select(F.col("e").alias("a"), F.col("o").alias(name)) for p, name in (("owl:annotatedSource", "e"), ("owl:annotatedTarget", "o"))}
    marks = d.of("oio:is_inferred").filter(F.col("o").contains("true")).select(F.col("e").alias("a"))
    on = d.of("owl:annotatedProperty").filter("o = 'rdfs:subClassOf'").select(F.col("e").alias("a"))
    inferred = about["e"].join(about["o"], "a").join(on, "a", "left_semi").join(marks, "a", "left_semi").select("e", "o")
    rows = _several(d.of("rdfs:subClassOf").filter(~blank("o")).join(d.typed("owl:Class"), "e", "left_semi"))
    return out(rows.join(inferred, ["e", "o"], "left_anti"))


@check
def dc_properties(d: Data) -> DataFrame:
    return out(d.t.filter(F.col("p").startswith("dc:") & ~blank("e")))


@check
def illegal_date(d: Data) -> DataFrame:
    date = (F.col("lit") == "xsd:date") & F.col("o").rlike("^\\d{4}-\\d\\d-\\d\\d$")
    moment = (F.col("lit") == "xsd:dateTime") & F.col("o").rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z")
    return out(d.of("dcterms:date", "dcterms:issued", "dcterms:created", "oio:creation_date").filter((F.col("lit") != "") & ~date & ~moment))


@check
def iri_range(d: Data) -> DataFrame:
    return out(d.named(*IRI_PROPERTIES).filter(blank("o") | (F.col("lit") != "")))


@check
def iri_range_advanced(d: Data) -> DataFrame:
    return out(d.named(*IRI_PROPERTIES, "rdfs:seeAlso").filter(blank("o") | (F.col("lit") != "")))


@check
def label_with_iri(d: Data) -> DataFrame:
    return out(d.named("rdfs:label").filter(F.col("o").rlike("https?:")))


@check
def multiple_replaced_by(d: Data) -> DataFrame:
    rows = d.of("IAO:0100001")
    pairs = rows.join(rows.select("e", F.col("o").alias("o2")), "e").filter("o <> o2")
    return out(pairs, value=F.concat_ws("|", "o", "o2"))


@check
def owldef_self_reference(d: Data) -> DataFrame:
    cells = closure(d.of("rdf:rest").select(F.col("e").alias("subject"), F.col("o").alias("object")), by=()).select(F.col("subject").alias("list"), F.col("object").alias("cell"))
    heads = d.of("owl:intersectionOf").select(F.col("e").alias("o"), F.col("o").alias("list"))
    cells = cells.union(heads.select("list", F.col("list").alias("cell"))).distinct()
    members = heads.join(cells, "list").join(d.of("rdf:first").select(F.col("e").alias("cell"), F.col("o").alias("m")), "cell")
    fillers = d.of("owl:someValuesFrom").select(F.col("e").alias("m"), F.col("o").alias("f"))
    rows = d.named("owl:equivalentClass").join(members, "o")
    return out(rows.filter("e = m").select("e", "p", "m").union(rows.join(fillers, "m").filter("e = f").select("e", "p", "f")), value="m")


@check
def redundant_subclass_of(d: Data) -> DataFrame:
    labelled = d.of("rdfs:label").select("e").distinct()
    direct = d.named("rdfs:subClassOf").select("e", "o").join(labelled, "e", "left_semi")
    up = closure(d.of("rdfs:subClassOf").select(F.col("e").alias("subject"), F.col("o").alias("object")), by=()).select(F.col("subject").alias("mid"), F.col("object").alias("o"))
    over = direct.withColumnRenamed("o", "mid").join(labelled.withColumnRenamed("e", "mid"), "mid", "left_semi").join(up, "mid").select("e", "o", "mid")
    hit = over.join(direct, ["e", "o"], "left_semi").join(labelled.withColumnRenamed("e", "o"), "o", "left_semi")
    return out(hit, prop="mid")


@check
def taxon_range(d: Data) -> DataFrame:
    return out(d.named(*TAXON_PROPERTIES).filter(blank("o") | (F.col("lit") != "") | ~F.col("o").startswith("NCBITaxon:")))


@check
def term_tracker_uri(d: Data) -> DataFrame:
    return out(d.t.filter("p = 'IAO:0000233' and lit <> '' and lit <> 'xsd:anyURI'"), value="lit")


def report(statements: DataFrame, profile: dict[str, str] | None = None, custom: dict[str, Rule] | None = None, base: tuple[str, ...] = ()) -> DataFrame:
    """(``severity``, ``rule``, ``entity``, ``property``, ``value``) of every rule of the profile; entities of the built-in vocabulary are left out."""
    d, rules = Data(statements), RULES | (custom or {})
    arms = [rules[name](d).select(F.lit(level).alias("severity"), F.lit(name).alias("rule"), "entity", "property", "value") for name, level in (profile or SEVERITIES).items()]
    rows = reduce(DataFrame.unionByName, arms)
    rows = rows.filter(~reduce(lambda x, y: x | y, [F.coalesce(F.col("entity").startswith(p), F.lit(False)) for p in BUILT_IN]))
    return rows.filter(reduce(lambda x, y: x | y, [F.col("entity").startswith(b) for b in base])) if base else rows


def verify(statements: DataFrame, rules: dict[str, Rule]) -> dict[str, bool]:
    """Whether each rule finds nothing."""
    d = Data(statements)
    return {name: r(d).isEmpty() for name, r in rules.items()}
