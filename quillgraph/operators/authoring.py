"""Editors' operators: header annotations, declarations, ids, macros, slices, definitions. Over ``statements`` unless said otherwise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.operators import axioms as ax
from quillgraph.operators.closure import closure
from quillgraph.operators.graph import span_gaps
from quillgraph.plans.views import COLUMNS


def stated(df: DataFrame, subject: Column, predicate: str | Column, object: Column | None = None, value: Column | None = None, datatype: str = "xsd:string") -> DataFrame:
    null = F.lit(None).cast("string")
    p = F.lit(predicate) if isinstance(predicate, str) else predicate
    return df.select(subject.alias("stanza"), subject.alias("subject"), p.alias("predicate"), (null if object is None else object).alias("object"), (null if value is None else value).alias("value"), (null if value is None else F.lit(datatype)).alias("datatype"), null.alias("language"))


def annotate(statements: DataFrame, ontology: str | None = None, version: str | None = None, values: dict[str, str] | None = None, links: dict[str, str] | None = None, defined_by: bool = False) -> DataFrame:
    """The ontology's header with a new name, a version, annotations (``values``: texts, ``links``: IRIs) and, with ``defined_by``, each declared entity's
    ``rdfs:isDefinedBy``. A header that is missing is made, and needs ``ontology``.
    """
    old = [r[0] for r in statements.filter("predicate = 'rdf:type' and object = 'owl:Ontology'").select("subject").distinct().limit(2).collect()]
    if len(old) > 1:
        raise ValueError("more than one ontology header")
    name = ontology or (old[0] if old else None)
    if name is None:
        raise ValueError("no ontology header, and no name for one")
    out = statements.select(*COLUMNS)
    if old and old[0] != name:
        for c in ("stanza", "subject", "object"):
            out = out.withColumn(c, F.when(F.col(c) == old[0], F.lit(name)).otherwise(F.col(c)))
    if version is not None:
        out = out.filter(~((F.col("subject") == name) & (F.col("predicate") == "owl:versionIRI")))
    one, me = statements.sparkSession.range(1), F.lit(name)
    new = [stated(one, me, "rdf:type", F.lit("owl:Ontology"))]
    new += [stated(one, me, "owl:versionIRI", F.lit(version))] if version is not None else []
    new += [stated(one, me, p, value=F.lit(v)) for p, v in (values or {}).items()] + [stated(one, me, p, F.lit(v)) for p, v in (links or {}).items()]
    if defined_by:
        kinds = ["owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "owl:AnnotationProperty", "owl:NamedIndividual"]
        mine = statements.filter(F.col("predicate").eqNullSafe("rdf:type") & F.col("object").isin(kinds) & ~F.col("subject").startswith("_:")).select("subject").distinct()
        new.append(stated(mine, F.col("subject"), "rdfs:isDefinedBy", me))
    return reduce(DataFrame.unionByName, new, out).distinct()


def normalize(statements: DataFrame, prefixes: tuple[str, ...] = (), source: bool = False) -> DataFrame:
    """The statements, with declarations of the subset and synonym-type properties in use (those that begin with one of ``prefixes``, if given), and, with
    ``source``, the header's version as its ``dc:source``.
    """
    out = [statements.select(*COLUMNS)]
    for used, kind in (("oio:inSubset", "oio:SubsetProperty"), ("oio:hasSynonymType", "oio:SynonymTypeProperty")):
        ids = statements.filter((F.col("predicate") == used) & F.col("object").isNotNull()).select("object").distinct()
        if prefixes:
            ids = ids.filter(reduce(lambda a, b: a | b, [F.col("object").startswith(p) for p in prefixes]))
        out.append(stated(ids, F.col("object"), "rdfs:subPropertyOf", F.lit(kind)))
    if source:
        version = statements.filter("predicate = 'owl:versionIRI'")
        out.append(stated(version, F.col("subject"), "dc:source", F.col("object")))
    return reduce(DataFrame.unionByName, out).distinct()


def mint(statements: DataFrame, temporary: str, prefix: str, low: int, high: int, width: int = 7) -> DataFrame:
    """(``old``, ``new``): an id for every entity that begins with ``temporary``, in ascending order of its number: the lowest ones of ``low`` to ``high`` (not included)
    that nothing uses. Raises if there are not enough.
    """
    ids = statements.select(F.explode(F.array("subject", "predicate", "object")).alias("id")).filter("id is not null").distinct()
    number = lambda c, p: F.substr(c, F.lit(len(p) + 1)).try_cast("long")
    old = ids.filter(F.col("id").startswith(temporary)).select(F.col("id").alias("old"), number(F.col("id"), temporary).alias("k"))
    n = old.count()
    used = ids.filter(F.col("id").startswith(prefix) & ~F.col("id").startswith(temporary)).select(number(F.col("id"), prefix).alias("k")).filter(F.col("k").between(low, high - 1)).distinct()
    # of the first n + used numbers at least n are free
    room = statements.sparkSession.range(low, min(high, low + n + used.count())).withColumnRenamed("id", "k").join(used, "k", "left_anti")
    rank = lambda df, *by: df.withColumn("r", F.row_number().over(Window.orderBy(*by)))  # noqa: E731  as many rows as there are new ids
    out = rank(old, F.col("k").asc_nulls_last(), "old").select("old", "r").join(rank(room, "k").select("k", "r"), "r")
    if out.count() < n:
        raise ValueError(f"{n} ids are wanted, fewer are free from {low} to {high}")
    return out.select("old", F.concat(F.lit(prefix), F.lpad(F.col("k").cast("string"), width, "0")).alias("new"))


def renamed(statements: DataFrame, names: DataFrame) -> DataFrame:
    """The statements with the ids of ``names`` (``old``, ``new``) in place of the old ones."""
    out = statements.select(*COLUMNS)
    for c in ("stanza", "subject", "predicate", "object"):
        out = out.join(names.select(F.col("old").alias(c), F.col("new").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
    return out.select(*COLUMNS)


def grep(statements: DataFrame, pattern: str, ids_only: bool = False, case: bool = False) -> DataFrame:
    """All statements that mention an entity whose id, or an annotation of whom, matches ``pattern``. An id matches with a colon or an underscore after its prefix."""
    p = pattern if case else f"(?i){pattern}"
    by_id = lambda c: F.col(c).rlike(p) | F.regexp_replace(c, "^([^:/]+):", "$1_").rlike(p) | F.regexp_replace(c, "_([^_/]+)$", ":$1").rlike(p)
    hits = statements.filter(by_id("subject")).select(F.col("subject").alias("id")).union(statements.filter(by_id("object")).select("object"))
    if not ids_only:
        hits = hits.union(statements.filter(F.col("value").rlike(p)).select("subject"))
    hits = hits.filter("id is not null").distinct()
    rows = statements.select(*COLUMNS)
    found = [rows.join(hits.withColumnRenamed("id", c), c, "left_semi").select(*COLUMNS) for c in ("subject", "predicate", "object")]
    return reduce(DataFrame.union, found).distinct()


def import_module(edit: DataFrame, source: DataFrame, method: str = "bot") -> DataFrame:
    """The module of ``source`` (axioms) for those of its names that ``edit`` (axioms) mentions."""
    seeds = edit.select(F.explode("signature").alias("id")).distinct().join(source.select(F.explode("signature").alias("id")).distinct(), "id", "left_semi")
    return ax.extract(source, seeds, method)


def expand(statements: DataFrame, only: tuple[str, ...] = (), never: tuple[str, ...] = (), prefixes: dict[str, str] | None = None) -> DataFrame:
    """What the macros say: entities with an ``OMO:0002000`` carry a CONSTRUCT query, which runs over all statements. (``s``, ``p``, ``o``, ``source``: the entity.)"""
    from quillgraph.sparql.compile import Engine, quads_of

    macros = statements.filter("predicate = 'OMO:0002000' and value is not null").select("subject", "value").distinct()
    macros = macros.filter(F.col("subject").isin(*only)) if only else macros
    macros = macros.filter(~F.col("subject").isin(*never)) if never else macros
    engine = Engine(quads_of(statements), prefixes)
    parts = [engine.query(r["value"]).select("s", "p", "o", F.lit(r["subject"]).alias("source")) for r in macros.orderBy("subject", "value").collect()]  # queries are few and run one by one
    return reduce(DataFrame.unionByName, parts).distinct() if parts else statements.sparkSession.createDataFrame([], "s string, p string, o string, source string")


def subset(statements: DataFrame, name: str, ancestors: bool = False, fill_gaps: bool = False) -> DataFrame:
    """The slice of the classes that are in the subset ``name``: statements that mention no other class. ``ancestors`` adds all superclasses; ``fill_gaps``
    bridges the hierarchy over classes that are left out.
    """
    classes = statements.filter("predicate = 'rdf:type' and object = 'owl:Class' and subject not like '\\\\_:%'").select(F.col("subject").alias("id")).distinct()
    keep = statements.filter((F.col("predicate") == "oio:inSubset") & (F.coalesce("object", "value") == name)).select(F.col("subject").alias("id")).distinct()
    edges = statements.filter("predicate = 'rdfs:subClassOf' and object not like '\\\\_:%'").select("subject", "object").distinct()
    if ancestors:
        up = closure(edges, by=()).select("subject", "object")
        keep = keep.union(up.join(keep.withColumnRenamed("id", "subject"), "subject", "left_semi").select("object")).distinct()
    gone = classes.join(keep, "id", "left_anti")
    out = statements.select(*COLUMNS)
    # an anonymous expression goes with any class that goes, however deep
    links = out.filter("object like '\\\\_:%'").select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    direct = out.filter("subject like '\\\\_:%'").join(gone.withColumnRenamed("id", "object"), "object", "left_semi").select(F.col("subject").alias("id")).distinct()
    over = closure(links, by=()).join(direct.withColumnRenamed("id", "subject"), "subject", "left_semi").select(F.col("object").alias("id")).filter("id like '\\\\_:%'")
    blank = direct.union(over).distinct()
    drop = gone.union(blank).distinct()
    # and all that hangs on a class that goes
    below = closure(out.filter("object like '\\\\_:%'").select("subject", "object"), by=()).join(drop.withColumnRenamed("id", "subject"), "subject", "left_semi").select(F.col("object").alias("id"))
    drop = drop.union(below).distinct()
    left = out.join(drop.withColumnRenamed("id", "subject"), "subject", "left_anti").join(drop.withColumnRenamed("id", "object"), "object", "left_anti").select(*COLUMNS)
    if not fill_gaps:
        return left
    bridged = span_gaps(edges, gone)
    return left.unionByName(stated(bridged, F.col("subject"), "rdfs:subClassOf", F.col("object"))).distinct()


def rewrite_definitions(statements: DataFrame, prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Definitions with ``$sub_PFX:1234`` get that term's definition instead; one that is nothing else also tells where it is from. A term without one is said to have none.

    ``prefixes`` keeps to subjects that begin with one of them. One placeholder in a definition is replaced at a time, from left to right, until none is left.
    """
    mark = r"\$sub_([A-Za-z]+:[A-Za-z0-9]+)"
    definition = statements.filter("predicate = 'IAO:0000115' and value is not null")
    known = definition.filter(~F.col("value").rlike(mark)).groupBy(F.col("subject").alias("ref")).agg(F.min("value").alias("text"))
    mine = F.col("value").rlike(mark) & (reduce(lambda a, b: a | b, [F.col("subject").startswith(p) for p in prefixes]) if prefixes else F.lit(True))
    todo = definition.filter(mine).select(*COLUMNS).withColumn("whole", F.col("value").rlike(f"^{mark}$"))
    rest = statements.select(*COLUMNS).exceptAll(todo.select(*COLUMNS))
    most = todo.agg(F.max(F.size(F.regexp_extract_all("value", F.lit(mark), F.lit(1))))).first()[0] or 0
    for _ in range(most):
        todo = todo.withColumn("ref", F.regexp_extract("value", mark, 1)).join(known, "ref", "left")
        told = F.when(F.col("whole"), F.concat(F.regexp_replace("text", "\\.$", ""), F.lit(" (from "), F.substring_index("ref", ":", 1), F.lit(")."))).otherwise(F.col("text"))
        told = F.coalesce(told, F.concat(F.lit("No definition for "), F.col("ref"), F.lit(".")))
        todo = todo.withColumn("value", F.when(F.col("ref") != "", F.replace("value", F.concat(F.lit("$sub_"), F.col("ref")), told)).otherwise(F.col("value"))).drop("ref", "text")
    return rest.unionByName(todo.select(*COLUMNS))


def strip_axiom_annotations(axioms: DataFrame, properties: tuple[str, ...] = ()) -> DataFrame:
    """Axioms without the annotations of ``properties`` (all, if none is named)."""
    def change(body: list) -> list:
        notes = [k for k in body[1:] if isinstance(k, list) and k[0] == "Annotation"]
        gone = [k for k in notes if not properties or k[1] in properties]
        return [[body[0], *[k for k in body[1:] if k not in gone]]]

    return ax._rewritten(axioms, change)


def species_subset(axioms: DataFrame, taxon: str, in_taxon: str = "RO:0002162", never: str = "RO:0002161", only_taxon: str = "RO:0002160") -> DataFrame:
    """(``id``): classes that cannot be found in ``taxon``: below, or with a part that is below, a class that is only in a disjoint taxon or never in this one.

    Told by classification with a class of things in the taxon: what is unsatisfiable there is left out. Taxon restrictions are subclass axioms of
    ``in_taxon`` or ``only_taxon`` with a taxon, or annotations by ``never``.
    """
    import json

    from quillgraph.reason.el import BOTTOM, classify

    spark = axioms.sparkSession
    here = ["ObjectSomeValuesFrom", in_taxon, taxon]
    banned = axioms.filter("type = 'AnnotationAssertion'").filter((F.get_json_object("body", "$[1]") == never)).select(F.get_json_object("body", "$[2]").alias("c"), F.get_json_object("body", "$[3]").alias("t"))
    rule = lambda c, t: F.concat(F.lit('["DisjointClasses", '), F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2), F.lit(f', ["ObjectSomeValuesFrom", "{in_taxon}", '), F.to_json(F.array(t)).substr(F.lit(2), F.length(F.to_json(F.array(t))) - 2), F.lit("]]"))
    never_rules = banned.select(rule(F.col("c"), F.col("t")).alias("body"))
    only = axioms.select(F.regexp_replace("body", f'"{only_taxon}"', f'"{in_taxon}"').alias("body"))
    # things with one taxon are in no disjoint one: taxa of restrictions that are disjoint make their classes so
    disjoint = axioms.filter("type = 'DisjointClasses'").select(F.get_json_object("body", "$[1]").alias("a"), F.get_json_object("body", "$[2]").alias("b"))
    apart = disjoint.select(F.to_json(F.array(F.col("a"), F.col("b"))).alias("ab")).select(F.regexp_replace("ab", '^\\["(.*)","(.*)"\\]$', f'["DisjointClasses", ["ObjectSomeValuesFrom", "{in_taxon}", "$1"], ["ObjectSomeValuesFrom", "{in_taxon}", "$2"]]').alias("body"))
    classes = axioms.select(F.explode("signature").alias("id")).distinct()
    probe = classes.select(F.concat(F.lit('["EquivalentClasses", '), F.to_json(F.array(F.concat(F.lit("probe:"), "id"))).substr(F.lit(2), F.length(F.to_json(F.array(F.concat(F.lit("probe:"), "id")))) - 2), F.lit(', ["ObjectIntersectionOf", '), F.to_json(F.array("id")).substr(F.lit(2), F.length(F.to_json(F.array("id"))) - 2), F.lit(", " + json.dumps(here) + "]]")).alias("body"))
    c = classify(only.union(never_rules).union(apart).union(probe))
    return c.S.filter((F.col("d") == BOTTOM) & F.col("x").startswith("probe:")).select(F.substr("x", F.lit(7)).alias("id")).distinct()
