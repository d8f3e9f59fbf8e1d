"""Relation graphs: pruning, information content, node and edge tables, cliques."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure
from quillgraph.operators.components import connected_components
from quillgraph.session import Kept

SUBCLASS = "rdfs:subClassOf"
_EDGE = ("subject", "predicate", "object")


def redundant_graph(subsumptions: DataFrame, relations: DataFrame, classes: DataFrame) -> DataFrame:
    """All entailed edges: relations, strict subsumptions, and every satisfiable class below itself."""
    own = classes.select(F.col("id").alias("subject"), F.lit(SUBCLASS).alias("predicate"), F.col("id").alias("object"))
    strict = subsumptions.filter("subject != object").select("subject", F.lit(SUBCLASS).alias("predicate"), "object")
    return relations.select(*_EDGE).union(strict).union(own).distinct()


def full_graph(edges: DataFrame, transitive: list[str] = (), subproperties: DataFrame | None = None) -> DataFrame:
    """The redundant graph of asserted edges: relations are inherited by subclasses, widened to superclasses of their
    target and to superproperties, and composed where transitive; subsumption is transitive and reflexive."""
    subs = closure(edges.filter(F.col("predicate") == SUBCLASS)).select("subject", "object")
    classes = edges.select(F.col("subject").alias("id")).union(edges.select("object")).distinct()
    up = subs.union(classes.select(F.col("id").alias("subject"), F.col("id").alias("object"))).distinct()
    rel = edges.filter(F.col("predicate") != SUBCLASS).select(*_EDGE)

    def widened(r: DataFrame) -> DataFrame:
        below = up.select(F.col("object").alias("subject"), F.col("subject").alias("_s"))
        above = up.select(F.col("subject").alias("object"), F.col("object").alias("_o"))
        return r.join(below, "subject").join(above, "object").select(F.col("_s").alias("subject"), "predicate", F.col("_o").alias("object")).distinct()

    rel = widened(rel)
    if subproperties is not None:
        sup = closure(subproperties.select("subject", "object"), by=()).select(F.col("subject").alias("predicate"), F.col("object").alias("_p"))
        rel = rel.union(rel.join(sup, "predicate").select("subject", F.col("_p").alias("predicate"), "object")).distinct()
    if transitive:
        rel = rel.union(widened(closure(rel.filter(F.col("predicate").isin(*transitive))).select(*_EDGE))).distinct()
    return redundant_graph(subs, rel, classes)


def nonredundant_graph(redundant: DataFrame, transitive: list[str] = (), subproperties: DataFrame | None = None) -> DataFrame:
    """Edges that no other edge implies: not those to a more general object, those that a superclass has, shortcuts of a
    transitive property, those that a subproperty states, or a class below itself. Equivalent classes do not outdo each other."""
    g = redundant.select(*_EDGE).distinct()
    sub = g.filter((F.col("predicate") == SUBCLASS) & (F.col("subject") != F.col("object"))).select("subject", "object")
    back = sub.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
    strict = sub.join(back, ["subject", "object"], "left_anti")
    rel = g.filter(F.col("predicate") != SUBCLASS)
    keep = g.filter((F.col("predicate") != SUBCLASS) | (F.col("subject") != F.col("object")))
    witnesses = [
        rel.join(strict.select(F.col("subject").alias("object"), F.col("object").alias("_o")), "object").select("subject", "predicate", F.col("_o").alias("object")),
        rel.join(strict.select(F.col("object").alias("subject"), F.col("subject").alias("_s")), "subject").select(F.col("_s").alias("subject"), "predicate", "object"),
    ]
    for p in [SUBCLASS, *transitive]:
        pairs = strict if p == SUBCLASS else rel.filter((F.col("predicate") == p) & (F.col("subject") != F.col("object"))).select("subject", "object")
        two = pairs.join(pairs.select(F.col("subject").alias("object"), F.col("object").alias("_o")), "object").select("subject", F.lit(p).alias("predicate"), F.col("_o").alias("object"))
        witnesses.append(two.filter("subject != object"))
    if subproperties is not None:
        sup = closure(subproperties.select("subject", "object"), by=()).filter("subject != object")
        witnesses.append(rel.join(sup.select(F.col("subject").alias("predicate"), F.col("object").alias("_p")), "predicate").select("subject", F.col("_p").alias("predicate"), "object"))
    implied = witnesses[0]
    for w in witnesses[1:]:
        implied = implied.union(w)
    return keep.join(implied.distinct(), list(_EDGE), "left_anti")


def information_content(redundant: DataFrame) -> DataFrame:
    """(``term``, ``reference_count``, ``ic``): how many edges end at each term that is also a subject, and its content from 0 to 100."""
    terms = redundant.select(F.col("subject").alias("term")).distinct()
    counts = redundant.groupBy(F.col("object").alias("term")).agg(F.count("*").alias("reference_count")).join(terms, "term", "left_semi")
    total = terms.agg(F.count("*").alias("total"))  # one row
    ic = F.when(F.log("total") == 0, 0.0).otherwise(-F.log(F.col("reference_count") / F.col("total")) * 100 / F.log("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", "reference_count", ic.alias("ic"))


def structural_ic(edges: DataFrame, relations: list[str] = (SUBCLASS,)) -> DataFrame:
    """(``term``, ``descendants``, ``ic``) from the hierarchy alone: each descendant counts once, the term itself too."""
    outside = ("owl:Thing", "owl:Nothing")
    only = edges.filter(F.col("predicate").isin(*relations) & ~F.col("subject").isin(*outside) & ~F.col("object").isin(*outside)).select("subject", "object")
    pairs = closure(only, by=(), reflexive=True)
    counts = pairs.groupBy(F.col("object").alias("term")).agg(F.countDistinct("subject").alias("descendants"))
    total = counts.agg(F.count("*").alias("total"))  # one row
    ic = F.when(F.log("total") == 0, 0.0).otherwise(-F.log(F.col("descendants") / F.col("total")) * 100 / F.log("total"))
    return counts.crossJoin(F.broadcast(total)).select("term", "descendants", ic.alias("ic"))


def is_defined_by(terms: DataFrame, column: str = "id") -> DataFrame:
    """(``subject``, ``predicate``, ``object``): the ontology that a term's id names, up to its last underscore, in lower case."""
    base = F.regexp_extract(column, "^(.*)_[^_]*$", 1)
    return terms.filter(base != "").select(F.col(column).alias("subject"), F.lit("rdfs:isDefinedBy").alias("predicate"), F.lower(base).alias("object"))


def subproperty_closure(pairs: DataFrame) -> DataFrame:
    return closure(pairs.select("subject", "object"), by=()).filter("subject != object").select("subject", "object")


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves, by predicate."""
    return closure(edges).filter("subject = object").select("subject", "predicate").distinct()


def kgx_nodes(labels: DataFrame, categories: DataFrame) -> DataFrame:
    """(``id``, ``name``, ``category``): the smallest label, and all categories joined by a pipe; ``biolink:NamedThing`` without any."""
    name = labels.groupBy("id").agg(F.min("label").alias("name"))
    kinds = categories.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("category")), "|").alias("category"))
    return name.join(kinds, "id", "full_outer").select("id", "name", F.coalesce("category", F.lit("biolink:NamedThing")).alias("category"))


def kgx_edges(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with a stable ``id``, and the nodes completed by endpoints that were missing."""
    out = edges.select(F.sha1(F.concat_ws("\u0001", *_EDGE)).alias("id"), *_EDGE).distinct()
    ends = edges.select(F.col("subject").alias("id")).union(edges.select("object")).distinct()
    missing = ends.join(nodes, "id", "left_anti").select("id", F.lit(None).cast("string").alias("name"), F.lit("biolink:NamedThing").alias("category"))
    return out, nodes.unionByName(missing)


def specific_edges(candidates: DataFrame, broader: DataFrame) -> DataFrame:
    """Of the edges between two nodes those whose predicate has no more specific rival; ``broader`` has (``subject``, ``object``) of predicates."""
    rival = candidates.select("subject", "object", F.col("predicate").alias("_p"))
    above = broader.select(F.col("subject").alias("_p"), F.col("object").alias("predicate"))
    return candidates.join(rival.join(above, "_p").select(*_EDGE).distinct(), list(_EDGE), "left_anti")


def merge_equivalent_sets(pairs: DataFrame, edges: DataFrame, priority: list[str]) -> tuple[DataFrame, DataFrame]:
    """Cliques of equivalent ids, each with the leader whose prefix comes first; and ``edges`` between leaders."""
    parts = connected_components(pairs, "subject", "object")
    rank: Column = F.lit(len(priority))
    for i, p in reversed(list(enumerate(priority))):
        rank = F.when(F.col("node").startswith(f"{p}:"), F.lit(i)).otherwise(rank)
    leader = parts.withColumn("rank", rank).groupBy("component").agg(F.min_by("node", F.struct("rank", "node")).alias("leader"))
    to = parts.join(leader, "component").select("node", "leader")
    for c in ("subject", "object"):
        edges = edges.join(to.select(F.col("node").alias(c), F.col("leader").alias("_l")), c, "left").withColumn(c, F.coalesce("_l", c)).drop("_l")
    return to, edges.filter("subject != object").select(*_EDGE).distinct()


def collapse(edges: DataFrame, threshold: int = 2, precious: list[str] = (), root: str = "owl:Thing") -> DataFrame:
    """(``subject``, ``object``) subclass edges without the classes that have fewer than ``threshold`` named subclasses.

    A class goes if it is neither the root nor precious, has a named superclass, and at least one subclass; repeated until none goes. Gaps are
    bridged over the original edges.
    """
    base = edges.filter(F.col("predicate") == SUBCLASS).select("subject", "object").distinct()
    now = base
    gone: DataFrame | None = None
    kept = Kept(edges.sparkSession, "collapse")
    for i in range(200):
        counts = now.groupBy(F.col("object").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") < threshold)
        has_parent = now.filter(F.col("object") != root).select(F.col("subject").alias("id")).distinct()
        out = counts.join(has_parent, "id", "left_semi").filter((F.col("id") != root) & ~F.col("id").isin(*precious) if precious else F.col("id") != root).select("id")
        out = kept.keep(out, f"gone{i}")
        if out.isEmpty():
            return now
        gone = out if gone is None else gone.union(out)
        now = kept.keep(span_gaps(base, gone), f"now{i}")
    raise RuntimeError("collapse did not settle")


def span_gaps(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Subclass edges between kept classes: direct ones, and those over removed classes only. Loops are dropped."""
    inner = edges.join(gone.select(F.col("id").alias("object")), "object", "left_semi").select("subject", "object")
    through = closure(inner.join(gone.select(F.col("id").alias("subject")), "subject", "left_semi"), by=()).select("subject", "object")
    kept_s, kept_o = gone.select(F.col("id").alias("subject")), gone.select(F.col("id").alias("object"))
    into = inner.join(kept_s, "subject", "left_anti")
    reach = into.union(into.withColumnRenamed("object", "_m").join(through.withColumnRenamed("subject", "_m"), "_m").select("subject", "object")).distinct()
    bridged = reach.withColumnRenamed("object", "_m").join(edges.withColumnRenamed("subject", "_m"), "_m").select("subject", "object").join(kept_o, "object", "left_anti").select("subject", "object")
    direct = edges.join(kept_s, "subject", "left_anti").join(kept_o, "object", "left_anti").select("subject", "object")
    return direct.union(bridged).filter("subject != object").distinct()
