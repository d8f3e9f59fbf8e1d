"""Tables that a repository publishes of its ontology, over ``statements``. Subjects and objects that begin with ``_:`` are blank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.qc import Data, blank

#: Predicates of labels and synonyms.
NAMES = ["rdfs:label", "oio:hasRelatedSynonym", "oio:hasNarrowSynonym", "oio:hasBroadSynonym", "oio:hasExactSynonym"]


def _classes(d: Data) -> DataFrame:
    return d.typed("owl:Class").withColumnRenamed("e", "cls")


def basic_report(statements: DataFrame) -> DataFrame:
    """(``cls``, ``def``, ``xrefs``): a row for each named class and definition, its cross-references sorted and joined by blanks."""
    d = Data(statements)
    xrefs = d.of("oio:hasDbXref").groupBy(F.col("e").alias("cls")).agg(F.array_join(F.sort_array(F.collect_list("o")), " ").alias("xrefs"))
    definitions = d.of("IAO:0000115").select(F.col("e").alias("cls"), F.col("o").alias("def")).distinct()
    rows = _classes(d).filter(~blank("cls")).join(definitions, "cls", "left").join(xrefs, "cls", "left")
    return rows.select("cls", "def", F.coalesce("xrefs", F.lit("")).alias("xrefs"))


def class_count_by_prefix(statements: DataFrame) -> DataFrame:
    """(``prefix``, ``classes``): named classes by the prefix of their CURIE."""
    named = _classes(Data(statements)).filter(~blank("cls"))
    return named.groupBy(F.substring_index("cls", ":", 1).alias("prefix")).agg(F.count("*").alias("classes"))


def edges(statements: DataFrame) -> DataFrame:
    """(``x``, ``p``, ``y``) between declared classes: subclass axioms, and existential restrictions as edges of their property."""
    d = Data(statements)
    up = d.of("rdfs:subClassOf").select(F.col("e").alias("x"), F.col("o").alias("y"))
    filler = d.of("owl:someValuesFrom").select(F.col("e").alias("r"), F.col("o").alias("y"))
    on = d.of("owl:onProperty").select(F.col("e").alias("r"), F.col("o").alias("p"))
    some = up.withColumnRenamed("y", "r").join(d.typed("owl:Restriction").withColumnRenamed("e", "r"), "r").join(on, "r").join(filler, "r").select("x", "p", "y")
    both = up.select("x", F.lit("rdfs:subClassOf").alias("p"), "y").union(some)
    classes = _classes(d)
    return both.join(classes.withColumnRenamed("cls", "x"), "x", "left_semi").join(classes.withColumnRenamed("cls", "y"), "y", "left_semi").select("x", "p", "y")


def obsoletes(statements: DataFrame) -> DataFrame:
    """(``cls``, ``replaced_by``, ``consider``) of deprecated classes, a row for each pair of replacements."""
    d = Data(statements)
    rows = _classes(d).join(d.deprecated.withColumnRenamed("e", "cls"), "cls")
    for predicate, name in (("IAO:0100001", "replaced_by"), ("oio:consider", "consider")):
        rows = rows.join(d.of(predicate).select(F.col("e").alias("cls"), F.col("o").alias(name)).distinct(), "cls", "left")
    return rows.select("cls", "replaced_by", "consider")


def simple_seed(statements: DataFrame) -> DataFrame:
    """(``term``): annotation and object properties, and the values of subsets and synonym types."""
    d = Data(statements)
    used = d.of("oio:inSubset", "oio:hasSynonymType").select("o")
    return d.typed("owl:AnnotationProperty").union(d.typed("owl:ObjectProperty")).union(used).select(F.col("e").alias("term")).filter(~blank("term")).distinct()


def subsets_labelled(statements: DataFrame) -> DataFrame:
    """(``subset``, ``label``): the labels of each subset's classes."""
    d = Data(statements)
    labels = d.of("rdfs:label").select(F.col("e").alias("cls"), F.col("o").alias("label"), "lit", "lang")
    return _classes(d).join(d.of("oio:inSubset").select(F.col("e").alias("cls"), F.col("o").alias("subset"), F.col("lit").alias("kind")), "cls").join(labels, "cls").select("subset", "label")


def synonyms(statements: DataFrame) -> DataFrame:
    """(``cls``, ``predicate``, ``value``, ``type``): labels and synonyms of classes, with the synonym type that an annotation of the axiom gives."""
    d = Data(statements)
    said = d.of(*NAMES).select(F.col("e").alias("cls"), F.col("p").alias("predicate"), F.col("o").alias("value"), "lit", "lang")
    parts = {name: d.of(p).select(F.col("e").alias("a"), F.col("o").alias(name)) for p, name in (("owl:annotatedSource", "cls"), ("owl:annotatedProperty", "predicate"), ("oio:hasSynonymType", "type"))}
    target = d.of("owl:annotatedTarget").select(F.col("e").alias("a"), F.col("o").alias("value"), "lit", "lang")
    typed = parts["cls"].join(d.typed("owl:Axiom").withColumnRenamed("e", "a"), "a").join(parts["predicate"], "a").join(target, "a").join(parts["type"], "a").drop("a")
    return said.join(_classes(d), "cls", "left_semi").join(typed, ["cls", "predicate", "value", "lit", "lang"], "left").select("cls", "predicate", "value", "type")


def terms(statements: DataFrame, prefix: str | None = None) -> DataFrame:
    """(``term``): all that statements are about or point to, but for types and ontologies; ``prefix`` keeps those that begin with it."""
    d = Data(statements)
    pointed = d.t.filter("p <> 'rdf:type' and lit = ''").select(F.col("o").alias("term"))
    about = d.t.filter("o <> 'owl:Ontology'").select(F.col("e").alias("term"))
    out = pointed.union(about).filter(~blank("term")).distinct()
    return out if prefix is None else out.filter(F.col("term").startswith(prefix))


def xrefs(statements: DataFrame) -> DataFrame:
    """(``cls``, ``xref``) of declared classes."""
    d = Data(statements)
    return d.of("oio:hasDbXref").select(F.col("e").alias("cls"), F.col("o").alias("xref")).join(_classes(d), "cls", "left_semi")
