"""Operators on sets of axioms: (``axiom_id``, ``type``, ``body``, ``signature``), as ``sources.ofn`` makes them."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure
from quillgraph.reason.el import BOTTOM, TOP, classify
from quillgraph.session import Kept
from quillgraph.sources.ofn import SCHEMA, row

COLUMNS = ("axiom_id", "type", "body", "signature")
#: Groups of axiom types.
GROUPS = {
    "tbox": "SubClassOf EquivalentClasses DisjointClasses DisjointUnion".split(),
    "abox": "ClassAssertion ObjectPropertyAssertion NegativeObjectPropertyAssertion DataPropertyAssertion NegativeDataPropertyAssertion SameIndividual DifferentIndividuals".split(),
    "rbox": "SubObjectPropertyOf EquivalentObjectProperties DisjointObjectProperties InverseObjectProperties ObjectPropertyDomain ObjectPropertyRange FunctionalObjectProperty InverseFunctionalObjectProperty ReflexiveObjectProperty IrreflexiveObjectProperty SymmetricObjectProperty AsymmetricObjectProperty TransitiveObjectProperty SubDataPropertyOf EquivalentDataProperties DisjointDataProperties DataPropertyDomain DataPropertyRange FunctionalDataProperty".split(),
    "annotation": ["AnnotationAssertion", "SubAnnotationPropertyOf", "AnnotationPropertyDomain", "AnnotationPropertyRange"],
    "declaration": ["Declaration"],
    "subclass": ["SubClassOf"],
    "subproperty": ["SubObjectPropertyOf", "SubDataPropertyOf", "SubAnnotationPropertyOf"],
    "equivalent": ["EquivalentClasses", "EquivalentObjectProperties", "EquivalentDataProperties"],
    "disjoint": ["DisjointClasses", "DisjointUnion", "DisjointObjectProperties", "DisjointDataProperties"],
    "type": ["ClassAssertion"],
}
GROUPS["logical"] = GROUPS["tbox"] + GROUPS["abox"] + GROUPS["rbox"]


def merge(*sets: DataFrame) -> DataFrame:
    out = sets[0].select(*COLUMNS)
    for s in sets[1:]:
        out = out.unionByName(s.select(*COLUMNS))
    return out.dropDuplicates(["axiom_id"])


def unmerge(one: DataFrame, *others: DataFrame) -> DataFrame:
    for o in others:
        one = one.join(o.select("axiom_id"), "axiom_id", "left_anti")
    return one.select(*COLUMNS)


def diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(``change``, ``axiom_id``, ``type``, ``body``): what the right set added and removed."""
    added = right.join(left.select("axiom_id"), "axiom_id", "left_anti").select(F.lit("added").alias("change"), "axiom_id", "type", "body")
    return added.unionByName(left.join(right.select("axiom_id"), "axiom_id", "left_anti").select(F.lit("removed").alias("change"), "axiom_id", "type", "body"))


def measure(axioms: DataFrame) -> DataFrame:
    """(``metric``, ``value``): axioms by type, and the sums of logical and of all axioms."""
    by = axioms.groupBy(F.col("type").alias("metric")).agg(F.count("*").alias("value"))
    whole = axioms.agg(F.count_if(F.col("type").isin(GROUPS["logical"])).alias("logical_axioms"), F.count("*").alias("total_axioms"))
    return by.unionByName(whole.select(F.explode(F.create_map(F.lit("logical_axioms"), "logical_axioms", F.lit("total_axioms"), "total_axioms")).alias("metric", "value")))


def of_types(axioms: DataFrame, *groups: str) -> DataFrame:
    names = [t for g in groups for t in GROUPS.get(g, [g])]
    return axioms if "all" in groups else axioms.filter(F.col("type").isin(names))


def judged(axioms: DataFrame, objects: DataFrame, trim: bool = True) -> DataFrame:
    """Axioms whose signature is wholly in ``objects`` (``id``), or, without ``trim``, meets it."""
    terms = axioms.select("axiom_id", F.explode("signature").alias("id"))
    hit = terms.join(objects.select("id").distinct(), "id", "left_semi")
    if not trim:
        return axioms.join(hit.select("axiom_id").distinct(), "axiom_id", "left_semi").select(*COLUMNS)
    out = terms.join(objects.select("id").distinct(), "id", "left_anti").select("axiom_id").distinct()
    return axioms.join(out, "axiom_id", "left_anti").select(*COLUMNS)


def remove(axioms: DataFrame, objects: DataFrame, trim: bool = False) -> DataFrame:
    """Axioms that are not judged to be about ``objects``: by default none that mentions one stays."""
    return unmerge(axioms, judged(axioms, objects, trim))


def told_edges(axioms: DataFrame) -> DataFrame:
    """(``subject``, ``object``) of subclass axioms between named classes."""
    rows = axioms.filter("type = 'SubClassOf'").select(F.get_json_object("body", "$[1]").alias("subject"), F.get_json_object("body", "$[2]").alias("object"))
    return rows.filter(~F.col("subject").startswith("[") & ~F.col("object").startswith("["))


def select_objects(axioms: DataFrame, start: DataFrame, *selectors: str) -> DataFrame:
    """(``id``): the union of what each selector makes of ``start``: self, parents, ancestors, children, descendants, equivalents, complement."""
    edges = told_edges(axioms)
    start = start.select("id").distinct()
    parts = []
    for s in selectors:
        if s == "self":
            parts.append(start)
        elif s in ("parents", "ancestors"):
            e = edges if s == "parents" else closure(edges, by=()).select("subject", "object")
            parts.append(e.join(start.withColumnRenamed("id", "subject"), "subject", "left_semi").select(F.col("object").alias("id")))
        elif s in ("children", "descendants"):
            e = edges if s == "children" else closure(edges, by=()).select("subject", "object")
            parts.append(e.join(start.withColumnRenamed("id", "object"), "object", "left_semi").select(F.col("subject").alias("id")))
        elif s == "equivalents":
            rows = axioms.filter("type = 'EquivalentClasses'").select("axiom_id", F.explode("signature").alias("id"))
            mine = rows.join(start, "id", "left_semi").select("axiom_id")
            parts.append(rows.join(mine, "axiom_id", "left_semi").select("id").join(start, "id", "left_anti"))
        elif s == "complement":
            parts.append(axioms.select(F.explode("signature").alias("id")).distinct().join(start, "id", "left_anti"))
        else:
            raise ValueError(f"unknown selector {s!r}")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def _rewritten(axioms: DataFrame, change) -> DataFrame:
    """Axioms whose bodies ``change`` maps to lists of bodies; ids and signatures are made anew."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([row(new) for body in part["body"] for new in change(_plain(json.loads(body)))], columns=list(COLUMNS))

    return axioms.select("body").mapInPandas(run, SCHEMA).dropDuplicates(["axiom_id"])


def _plain(x: list) -> list:
    """A stored body as it was read: annotations first."""
    notes = [k for k in x if isinstance(k, list) and k[0] == "Annotations"]
    return [x[0], *(notes[0][1:] if notes else []), *[k for k in x[1:] if k not in notes]]


def rename(axioms: DataFrame, names: dict[str, str], prefixes: dict[str, str] | None = None) -> DataFrame:
    """All IRIs renamed at once, by whole name or by prefix."""

    def new(x):
        if isinstance(x, list):
            return [x[0], *map(new, x[1:])]
        if x in names:
            return names[x]
        for a, b in (prefixes or {}).items():
            if x.startswith(a):
                return b + x[len(a) :]
        return x

    return _rewritten(axioms, lambda body: [new(body)])


def relax(axioms: DataFrame) -> DataFrame:
    """The axioms, and for each class equivalent to a conjunction or restriction the subclass axioms that follow; those stated already are not repeated."""

    def leaves(x) -> list:
        if isinstance(x, list) and x[0] == "ObjectIntersectionOf":
            return [leaf for k in x[1:] for leaf in leaves(k)]
        if isinstance(x, list) and x[0] in ("ObjectMinCardinality", "ObjectExactCardinality") and str(x[1]).isdigit() and int(x[1]) > 0:
            return [["ObjectSomeValuesFrom", x[2], x[3] if len(x) > 3 else TOP]]
        return [x]

    def follow(body: list) -> list:
        args = [k for k in body[1:] if not (isinstance(k, list) and k[0] == "Annotation")]
        return [["SubClassOf", a, leaf] for a in args if isinstance(a, str) for b in args if b != a for leaf in leaves(b) if leaf != a]

    new = _rewritten(axioms.filter("type = 'EquivalentClasses'"), follow)
    return merge(axioms, new)


def reduce(axioms: DataFrame) -> DataFrame:
    """Without subclass axioms between named classes that the rest implies: another asserted superclass lies strictly below the object."""
    s = classify(axioms).subsumptions()
    strict = s.join(s.select(F.col("object").alias("subject"), F.col("subject").alias("object")), ["subject", "object"], "left_anti")
    told = told_edges(axioms)
    over = told.withColumnRenamed("object", "m").join(strict.withColumnRenamed("subject", "m"), "m").select("subject", "object").distinct()
    keyed = axioms.withColumns({c: F.when(F.col("type") == "SubClassOf", F.get_json_object("body", f"$[{i}]")) for c, i in (("_s", 1), ("_o", 2))})
    return keyed.join(over.select(F.col("subject").alias("_s"), F.col("object").alias("_o")), ["_s", "_o"], "left_anti").select(*COLUMNS)


def materialise(axioms: DataFrame) -> DataFrame:
    """The axioms and the entailed existential restrictions between named classes."""
    rel = classify(axioms).materialised()
    quoted = [F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "") for c in ("subject", "predicate", "object")]
    body = F.concat(F.lit('["SubClassOf", '), quoted[0], F.lit(', ["ObjectSomeValuesFrom", '), quoted[1], F.lit(", "), quoted[2], F.lit("]]"))
    names = F.array_sort(F.array_distinct(F.array("subject", "predicate", "object")))
    return merge(axioms, rel.select(F.sha2(body, 256).alias("axiom_id"), F.lit("SubClassOf").alias("type"), body.alias("body"), names.alias("signature")))


def repair(axioms: DataFrame, replaced_by: dict[str, str]) -> DataFrame:
    """References to obsolete terms follow their replacements, except in annotation axioms about them; equal axioms merge their annotations."""
    about = axioms.filter(F.col("type").isin(*GROUPS["annotation"], "Declaration"))
    return merge(about, rename(axioms.filter(~F.col("type").isin(*GROUPS["annotation"], "Declaration")), replaced_by))


# --- modules


def _bot(x, sig: set) -> bool:
    """Whether an expression is equivalent to nothing when all names outside ``sig`` are."""
    if isinstance(x, str):
        return x == BOTTOM or (x not in sig and x != TOP)
    op, *a = x
    if op == "ObjectIntersectionOf":
        return any(_bot(k, sig) for k in a)
    if op == "ObjectUnionOf":
        return all(_bot(k, sig) for k in a)
    if op == "ObjectComplementOf":
        return _top_bot(a[0], sig)
    if op in ("ObjectSomeValuesFrom", "ObjectHasValue", "ObjectHasSelf"):
        return (isinstance(a[0], str) and a[0] not in sig) or (op == "ObjectSomeValuesFrom" and _bot(a[1], sig))
    if op in ("ObjectMinCardinality", "ObjectExactCardinality"):
        return int(a[0]) > 0 and (a[1] not in sig or (len(a) > 2 and _bot(a[2], sig)))
    return False


def _top_bot(x, sig: set) -> bool:
    """Whether it is equivalent to everything under the same reading."""
    if isinstance(x, str):
        return x == TOP
    op, *a = x
    if op == "ObjectIntersectionOf":
        return all(_top_bot(k, sig) for k in a)
    if op == "ObjectUnionOf":
        return any(_top_bot(k, sig) for k in a)
    if op == "ObjectComplementOf":
        return _bot(a[0], sig)
    if op == "ObjectAllValuesFrom":
        return a[0] not in sig or _top_bot(a[1], sig)
    if op == "ObjectMaxCardinality":
        return a[1] not in sig or (len(a) > 2 and _bot(a[2], sig))
    return op == "ObjectMinCardinality" and int(a[0]) == 0


def bottom_local(axiom: list, sig: set) -> bool:
    """Whether an axiom says nothing about the names in ``sig``."""
    op, *a = [k for k in axiom if not (isinstance(k, list) and k[0] in ("Annotations", "Annotation"))]
    role = lambda r: all(x not in sig for x in ([r] if isinstance(r, str) else r[1:2] if r[0] == "ObjectInverseOf" else []))
    if op == "SubClassOf":
        return _bot(a[0], sig) or _top_bot(a[1], sig)
    if op == "EquivalentClasses":
        return all(_bot(k, sig) for k in a) or all(_top_bot(k, sig) for k in a)
    if op == "DisjointClasses":
        return sum(not _bot(k, sig) for k in a) <= 1
    if op == "DisjointUnion":
        return all(_bot(k, sig) for k in a)
    if op in ("ObjectPropertyDomain", "ObjectPropertyRange"):
        return role(a[0]) or _top_bot(a[1], sig)
    if op == "SubObjectPropertyOf":
        chain = a[0][1:] if isinstance(a[0], list) and a[0][0] == "ObjectPropertyChain" else [a[0]]
        return any(role(r) for r in chain)
    if op in ("EquivalentObjectProperties", "InverseObjectProperties"):
        return all(role(r) for r in a)
    if op in ("TransitiveObjectProperty", "FunctionalObjectProperty", "InverseFunctionalObjectProperty", "SymmetricObjectProperty", "AsymmetricObjectProperty", "IrreflexiveObjectProperty"):
        return role(a[0])
    if op == "DisjointObjectProperties":
        return sum(not role(r) for r in a) <= 1
    return op in ("SameIndividual", "DifferentIndividuals", "Declaration", *GROUPS["annotation"])


def top_local(axiom: list, sig: set) -> bool:
    """Whether an axiom says nothing about the names in ``sig`` when all other classes and roles hold of everything."""

    def top(x) -> bool:
        if isinstance(x, str):
            return x not in sig and x != BOTTOM
        op, *a = x
        if op == "ObjectIntersectionOf":
            return all(top(k) for k in a)
        if op == "ObjectUnionOf":
            return any(top(k) for k in a)
        if op == "ObjectComplementOf":
            return bottom(a[0])
        if op in ("ObjectSomeValuesFrom", "ObjectAllValuesFrom"):
            return top(a[1]) and (op == "ObjectAllValuesFrom" or free(a[0]))
        if op in ("ObjectHasValue", "ObjectHasSelf"):
            return free(a[0])
        return op == "ObjectMinCardinality" and (int(a[0]) == 0 or int(a[0]) == 1 and free(a[1]) and (len(a) < 3 or top(a[2])))

    def bottom(x) -> bool:
        if isinstance(x, str):
            return x == BOTTOM
        op, *a = x
        if op == "ObjectIntersectionOf":
            return any(bottom(k) for k in a)
        if op == "ObjectUnionOf":
            return all(bottom(k) for k in a)
        if op == "ObjectComplementOf":
            return top(a[0])
        if op == "ObjectSomeValuesFrom":
            return bottom(a[1])
        return op == "ObjectAllValuesFrom" and free(a[0]) and bottom(a[1])

    def free(r) -> bool:
        return (r if isinstance(r, str) else r[1]) not in sig

    op, *a = [k for k in axiom if not (isinstance(k, list) and k[0] in ("Annotations", "Annotation"))]
    if op == "SubClassOf":
        return bottom(a[0]) or top(a[1])
    if op == "EquivalentClasses":
        return all(bottom(k) for k in a) or all(top(k) for k in a)
    if op == "DisjointClasses":
        return sum(not bottom(k) for k in a) <= 1
    if op in ("ObjectPropertyDomain", "ObjectPropertyRange"):
        return top(a[1])
    if op == "SubObjectPropertyOf":
        return free(a[1])
    if op in ("EquivalentObjectProperties", "InverseObjectProperties"):
        return all(free(r) for r in a)
    if op in ("TransitiveObjectProperty", "ReflexiveObjectProperty", "SymmetricObjectProperty"):
        return free(a[0])
    if op == "ClassAssertion":
        return top(a[0])
    if op == "ObjectPropertyAssertion":
        return free(a[0])
    return op in ("Declaration", *GROUPS["annotation"])


def _module(axioms: DataFrame, seeds: DataFrame, local, everywhere: bool, kept: Kept, tag: str) -> DataFrame:
    """The logical axioms of ``axioms`` that a locality (``local``) keeps for ``seeds`` and for all names that come in with them.

    Each round meets only the axioms that mention a name of the signature so far, each with the names of its own that are in it; the first round,
    and with ``everywhere`` each one, also those that mention none.
    """
    logical = kept.keep(axioms.filter(~F.col("type").isin(*GROUPS["annotation"], "Declaration")), f"{tag}logical")
    sig = kept.keep(seeds.select("id").distinct(), f"{tag}sig0")
    terms = logical.select("axiom_id", F.explode("signature").alias("id"))
    inside, i = None, 0
    while True:  # ends, as each round adds an axiom
        i += 1
        known = terms.join(sig, "id", "left_semi").groupBy("axiom_id").agg(F.collect_set("id").alias("known"))
        rest = logical if inside is None else logical.join(inside.select("axiom_id"), "axiom_id", "left_anti")
        asked = rest.join(known, "axiom_id", "left" if i == 1 or everywhere else "inner").select("axiom_id", "body", "known")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                keep = [not local(json.loads(b), set(() if k is None else k)) for b, k in zip(part["body"], part["known"], strict=True)]
                yield part.loc[keep, ["axiom_id"]]

        found = kept.keep(logical.join(asked.mapInPandas(run, "axiom_id string"), "axiom_id", "left_semi").select(*COLUMNS), f"{tag}found{i}")
        if found.isEmpty():
            return axioms.select(*COLUMNS).limit(0) if inside is None else inside
        inside = kept.keep(found if inside is None else inside.unionByName(found), f"{tag}module{i}")
        sig = kept.keep(sig.union(found.select(F.explode("signature"))).distinct(), f"{tag}sig{i}")


def extract(axioms: DataFrame, seeds: DataFrame, method: str = "bot") -> DataFrame:
    """The locality module of ``seeds`` (``id``), with declarations and annotations of its names: ``bot`` (all that is said of them from above), ``top`` (from below)
    or ``star`` (the two in turn until neither drops an axiom: the smallest).
    """
    kept, method = Kept(axioms.sparkSession, "module"), method.lower()
    if method not in ("bot", "top", "star"):
        raise ValueError(method)
    now, size, turn = axioms, None, 0
    while True:
        kinds = ("bot", "top") if method == "star" else (method,)
        for kind in kinds:
            turn += 1
            now = _module(now, seeds, bottom_local if kind == "bot" else top_local, kind == "top", kept, f"{turn}-")
        n = now.count()
        if method != "star" or n == size:
            break
        size = n
    names = kept.keep(seeds.select("id").union(now.select(F.explode("signature"))).distinct(), "names")
    about = axioms.filter(F.col("type").isin("AnnotationAssertion", "Declaration"))
    subject = F.when(F.col("type") == "Declaration", F.get_json_object("body", "$[1][1]")).otherwise(F.get_json_object("body", "$[2]"))
    about = about.withColumn("_s", subject).join(names.withColumnRenamed("id", "_s"), "_s", "left_semi").select(*COLUMNS)
    return now.unionByName(about)


def extract_bottom(axioms: DataFrame, seeds: DataFrame) -> DataFrame:
    """The bottom-locality module of ``seeds`` (``id``): all that the axioms say of them from above, with declarations and annotations of its names."""
    return extract(axioms, seeds, "bot")


def extract_top(axioms: DataFrame, seeds: DataFrame) -> DataFrame:
    return extract(axioms, seeds, "top")


def extract_star(axioms: DataFrame, seeds: DataFrame) -> DataFrame:
    return extract(axioms, seeds, "star")


def mireot(axioms: DataFrame, lower: DataFrame, upper: DataFrame | None = None, branch: DataFrame | None = None) -> DataFrame:
    """The told hierarchy from ``lower`` (``id``) up to ``upper``, and all below ``branch``, as subclass axioms with their annotations."""
    edges = told_edges(axioms)
    up = closure(edges, by=(), reflexive=True).select("subject", "object")
    keep = up.join(lower.select(F.col("id").alias("subject")), "subject", "left_semi").select(F.col("object").alias("id")).distinct()
    if upper is not None:
        roots = upper.select(F.col("id").alias("object"))
        keep = keep.join(up.join(roots, "object", "left_semi").select(F.col("subject").alias("id")).distinct(), "id", "left_semi")
    if branch is not None:
        keep = keep.union(up.join(branch.select(F.col("id").alias("object")), "object", "left_semi").select(F.col("subject").alias("id"))).distinct()
    plain = [~F.get_json_object("body", f"$[{i}]").startswith("[") for i in (1, 2)]
    hierarchy = judged(axioms.filter(F.col("type") == "SubClassOf").filter(plain[0] & plain[1]), keep)
    subject = F.when(F.col("type") == "Declaration", F.get_json_object("body", "$[1][1]")).otherwise(F.get_json_object("body", "$[2]"))
    about = axioms.filter(F.col("type").isin("AnnotationAssertion", "Declaration")).withColumn("_s", subject)
    return hierarchy.unionByName(about.join(keep.withColumnRenamed("id", "_s"), "_s", "left_semi").select(*COLUMNS))
