"""What is done with a classification: taxonomies, inferred axioms, alignment, explanations, profiles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import axioms as ax
from quillgraph.operators.closure import closure
from quillgraph.operators.components import connected_components
from quillgraph.reason.el import BOTTOM, TOP, Classification, _Normaliser, classify


def taxonomy(c: Classification) -> tuple[DataFrame, DataFrame]:
    """Groups of equivalent classes (``id``, ``group``: its smallest class) and the direct edges (``subject``, ``object``) between groups.

    Classes without an equivalent are groups of their own; unsatisfiable ones are the group ``owl:Nothing``.
    """
    pairs = c.equivalent_pairs()
    bad = c.unsatisfiable()
    classes = c.S.filter(c._plain("x")).select(F.col("x").alias("id")).distinct()
    same = connected_components(pairs, "subject", "object").select(F.col("node").alias("id"), F.col("component").alias("group"))
    groups = classes.join(bad, "id", "left_anti").join(same, "id", "left").select("id", F.coalesce("group", "id").alias("group"))
    groups = c.kept.keep(groups.unionByName(bad.select("id", F.lit(BOTTOM).alias("group"))), "groups")
    lead = groups.select(F.col("id").alias("m"), F.col("group").alias("g"))
    edges = c.direct().join(lead.withColumnsRenamed({"m": "subject", "g": "s"}), "subject").join(lead.withColumnsRenamed({"m": "object", "g": "o"}), "object")
    return groups, edges.select(F.col("s").alias("subject"), F.col("o").alias("object")).distinct()


def property_assertions(c: Classification) -> DataFrame:
    """(``subject``, ``predicate``, ``object``): relations between individuals, entailed ones too."""
    # a successor that is subsumed by an individual is that individual
    same = c.S.filter(F.col("d").startswith("i:")).select(F.col("x").alias("y"), F.col("d").alias("o"))
    rows = c.R.filter(F.col("x").startswith("i:") & ~F.col("r").startswith("x:")).join(same, "y")
    return rows.select(F.substr("x", F.lit(3)).alias("subject"), F.col("r").alias("predicate"), F.substr("o", F.lit(3)).alias("object")).distinct()


def direct_types(c: Classification) -> DataFrame:
    """(``individual``, ``type``): the most specific named types."""
    types, s = c.types(), c.subsumptions()
    strict = s.join(s.select(F.col("object").alias("subject"), F.col("subject").alias("object")), ["subject", "object"], "left_anti")
    wider = types.join(strict.select(F.col("subject").alias("type"), F.col("object").alias("wide")), "type").select("individual", F.col("wide").alias("type")).distinct()
    return types.join(wider, ["individual", "type"], "left_anti")


def made(df: DataFrame, kind: str, *parts: str | Column, annotate: bool = False) -> DataFrame:
    """Axioms of one kind from columns of names, made in the JVM as ``sources.ofn`` writes them."""
    names = [F.col(p) if isinstance(p, str) else p for p in parts]
    quoted = [F.lit(json.dumps(kind)), *[F.regexp_replace(F.to_json(F.array(n)), r"^\[|\]$", "") for n in names]]
    if annotate:
        quoted.append(F.lit(json.dumps(["Annotations", ["Annotation", "oio:is_inferred", '"true"']])))
    body = F.concat(F.lit("["), F.concat_ws(", ", *quoted), F.lit("]"))
    return df.select(F.sha2(body, 256).alias("axiom_id"), F.lit(kind).alias("type"), body.alias("body"), F.array_sort(F.array_distinct(F.array(*names))).alias("signature"))


def inferred(
    axioms: DataFrame, generators: tuple[str, ...] = ("SubClass",), indirect: bool = False, owl_thing: bool = False, duplicates: bool = False, equivalents: str = "all", annotate: bool = False, unsatisfiable: bool = False, classified: Classification | None = None
) -> DataFrame:
    """The axioms that ``generators`` find: SubClass, EquivalentClass, ClassAssertion, PropertyAssertion. Not the given ones again, unless ``duplicates``.

    ``indirect``: all superclasses and types, not only the nearest. ``owl_thing``: also ``owl:Thing`` above classes that have no other. ``equivalents``: ``all``,
    ``none``, or ``asserted-only``, which raises if a pair is inferred that is not asserted. Unsatisfiable classes, and an inconsistent set, raise unless
    ``unsatisfiable`` asks to go on without them. ``classified`` is the axioms' classification, if there is one already.
    """
    known = {"SubClass", "EquivalentClass", "ClassAssertion", "PropertyAssertion"}
    if set(generators) - known or equivalents not in ("all", "none", "asserted-only"):
        raise ValueError(f"generators are {sorted(known)}, equivalents all, none or asserted-only")
    c = classified or classify(axioms)
    if not unsatisfiable:
        bad = c.unsatisfiable().limit(10).collect()
        if bad or not c.is_consistent():
            raise ValueError(f"unsatisfiable: {[r['id'] for r in bad]}" if bad else "the axioms are inconsistent")
    parts = []
    if "SubClass" in generators:
        pairs = c.subsumptions() if indirect else c.direct()
        parts.append(made(pairs, "SubClassOf", "subject", "object", annotate=annotate))
        if owl_thing:
            tops = c.S.filter(c._plain("x")).select(F.col("x").alias("subject")).distinct().join(pairs, "subject", "left_anti").join(c.unsatisfiable().withColumnRenamed("id", "subject"), "subject", "left_anti")
            parts.append(made(tops, "SubClassOf", "subject", F.lit(TOP), annotate=annotate))
    if "EquivalentClass" in generators and equivalents != "none":
        new = made(c.equivalent_pairs(), "EquivalentClasses", "subject", "object", annotate=annotate)
        if equivalents == "asserted-only":
            plain = new.join(axioms.select("axiom_id"), "axiom_id", "left_anti") if not annotate else made(c.equivalent_pairs(), "EquivalentClasses", "subject", "object").join(axioms.select("axiom_id"), "axiom_id", "left_anti")
            if not plain.isEmpty():
                raise ValueError("equivalences are inferred that are not asserted")
        else:
            parts.append(new)
    if "ClassAssertion" in generators:
        parts.append(made(c.types() if indirect else direct_types(c), "ClassAssertion", "type", "individual", annotate=annotate))
    if "PropertyAssertion" in generators:
        parts.append(made(property_assertions(c), "ObjectPropertyAssertion", "predicate", "subject", "object", annotate=annotate))
    out = parts[0] if parts else axioms.select(*ax.COLUMNS).limit(0)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out if duplicates else _without(out, axioms)


def _core(body: Column) -> Column:
    """An axiom's body without its annotations."""
    return F.regexp_replace(body, r', \["Annotations".*\]\]$', "]")


def _without(new: DataFrame, old: DataFrame) -> DataFrame:
    """New axioms that the old ones do not state, with whatever annotations."""
    stated = old.filter(F.col("type").isin("SubClassOf", "EquivalentClasses", "ClassAssertion", "ObjectPropertyAssertion")).select(_core(F.col("body")).alias("_core")).distinct()
    return new.withColumn("_core", _core(F.col("body"))).join(stated, "_core", "left_anti").drop("_core")


def reason(axioms: DataFrame, **options) -> DataFrame:
    """The axioms with what ``inferred`` finds."""
    return ax.merge(axioms, inferred(axioms, **options))


def unaligned(axioms: DataFrame, roots: DataFrame, detail: str = "root", prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(``id``): classes that no root (``id``) subsumes. ``detail``: ``all``, ``root`` (only those right below ``owl:Thing``) or ``base-root`` (without an unaligned
    superclass). ``prefixes`` keeps classes that begin with one. Deprecated classes are left out.
    """
    c = classify(axioms)
    s = c.subsumptions()
    dead = axioms.filter("type = 'AnnotationAssertion' and get_json_object(body, '$[1]') in ('owl:deprecated', 'http://www.w3.org/2002/07/owl#deprecated') and get_json_object(body, '$[3]') like '\"true\"%'")
    dead = dead.select(F.get_json_object("body", "$[2]").alias("id"))
    roots = roots.select("id").distinct()
    under = s.join(roots.withColumnRenamed("id", "object"), "object", "left_semi").select(F.col("subject").alias("id")).union(roots)
    out = c.S.filter(c._plain("x")).select(F.col("x").alias("id")).distinct().join(under, "id", "left_anti").join(dead, "id", "left_anti")
    if prefixes:
        keep = F.lit(False)
        for p in prefixes:
            keep = keep | F.col("id").startswith(p)
        out = out.filter(keep)
    out = c.kept.keep(out, "unaligned")
    if detail == "all":
        return out
    if detail == "root":
        return out.join(c.direct().select(F.col("subject").alias("id")), "id", "left_anti")
    if detail != "base-root":
        raise ValueError(detail)
    above = s.join(out.withColumnRenamed("id", "object"), "object", "left_semi").select(F.col("subject").alias("id"))
    return out.join(above, "id", "left_anti")


# --- explanations: over modules, which are small enough for the driver


def _below(bodies: list[str], low: str) -> set[str]:
    """All that subsumes ``low`` under a few axioms: the rules of ``reason.el`` over sets, without tables."""
    n = _Normaliser()
    for body in bodies:
        n.axiom(json.loads(body))
    n.atom(low)
    of: dict[str, list[tuple]] = {}
    for kind, *row in n.out:
        of.setdefault(kind, []).append(tuple(row))
    above: dict[str, set[str]] = {}

    def wider(r: str) -> set[str]:
        if r not in above:
            above[r], todo = {r}, [r]
            while todo:
                now = todo.pop()
                for x, y, _ in of.get("role", ()):
                    if x == now and y not in above[r]:
                        above[r].add(y)
                        todo.append(y)
        return above[r]

    sub, some_sup, some_sub, conj = ({}, {}, {}, {})
    for d, e, _ in of.get("sub", ()):
        sub.setdefault(d, set()).add(e)
    for d, r, y in of.get("some_sup", ()):
        kinds = sorted({c for s in wider(r) for q, c, _ in of.get("range", ()) if q == s})
        if kinds:  # a successor under a role with ranges is in them too
            sub.setdefault(new := f"{y} in {kinds}", set()).update([y, *kinds])
            y = new
        some_sup.setdefault(d, set()).add((r, y))
    for r, f, e in of.get("some_sub", ()):
        some_sub.setdefault(f, set()).add((r, e))
    for d, d2, e in of.get("conj", ()):
        conj.setdefault(d, set()).add((d2, e))
        conj.setdefault(d2, set()).add((d, e))
    reflexive = {s for r, *_ in of.get("reflexive", ()) for s in wider(r)}
    chains = of.get("chain", ())

    held: dict[str, set[str]] = {}
    out: dict[str, set[tuple[str, str]]] = {}
    into: dict[str, set[tuple[str, str]]] = {}
    todo: list[tuple] = []

    def class_(x: str, d: str) -> None:
        if d not in held.setdefault(x, set()):
            held[x].add(d)
            todo.append((x, d))

    def link(r: str, x: str, y: str) -> None:
        for s in wider(r):
            if (s, y) not in out.setdefault(x, set()):
                out[x].add((s, y))
                into.setdefault(y, set()).add((s, x))
                todo.append((s, x, y))

    def start(x: str) -> None:
        if x not in held:
            class_(x, x)
            class_(x, TOP)
            for r in reflexive:
                link(r, x, x)

    start(low)
    while todo:
        now = todo.pop()
        if len(now) == 2:
            x, d = now
            for e in sub.get(d, ()):
                class_(x, e)
            for d2, e in conj.get(d, ()):
                if d2 in held[x]:
                    class_(x, e)
            for r, y in some_sup.get(d, ()):
                start(y)
                link(r, x, y)
            for r, e in some_sub.get(d, ()):
                for s, z in list(into.get(x, ())):
                    if s == r:
                        class_(z, e)
            if d == BOTTOM:
                for _, z in list(into.get(x, ())):
                    class_(z, BOTTOM)
        else:
            r, x, y = now
            for f in list(held[y]):
                for q, e in some_sub.get(f, ()):
                    if q == r:
                        class_(x, e)
                if f == BOTTOM:
                    class_(x, BOTTOM)
            for r1, r2, r3 in chains:
                if r == r1:
                    for s, z in list(out.get(y, ())):
                        if s == r2:
                            link(r3, x, z)
                if r == r2:
                    for s, z in list(into.get(x, ())):
                        if s == r1:
                            link(r3, z, y)
    return held[low]


def _entailed(bodies: list[str], goal: tuple[str, str]) -> bool:
    low, high = (BOTTOM if x == "http://www.w3.org/2002/07/owl#Nothing" else x for x in goal)
    return bool({high, BOTTOM} & _below(bodies, low))


def explain(axioms: DataFrame, subject: str, object: str = BOTTOM, most: int = 1, largest: int = 2000) -> list[list[str]]:
    """Up to ``most`` justifications, each a least set of axioms (bodies) that entail that ``subject`` is below ``object`` (unsatisfiable, by default).

    Axioms are searched in the module of the two names, since it holds all justifications; it must not have more than ``largest`` axioms. Halving blocks
    of axioms that are not needed finds one; further ones come from leaving out, in turn, an axiom of each one found (a hitting-set tree).
    """
    spark = axioms.sparkSession
    names = [(n,) for n in (subject, object) if n not in (TOP, BOTTOM)]
    module = ax.extract_bottom(axioms, spark.createDataFrame(names, "id string")).filter(~F.col("type").isin(*ax.GROUPS["annotation"], "Declaration"))
    rows = module.select("body").distinct().limit(largest + 1).collect()
    if len(rows) > largest:
        raise ValueError(f"the module has more than {largest} axioms")
    every, goal = sorted(r["body"] for r in rows), (subject, object)

    def least(bodies: list[str]) -> list[str]:
        size = max(1, len(bodies) // 2)
        while True:
            at = 0
            while at < len(bodies):
                rest = bodies[:at] + bodies[at + size :]
                if _entailed(rest, goal):
                    bodies = rest
                else:
                    at += size
            if size == 1:
                return bodies
            size = max(1, min(size // 2, len(bodies) // 2))

    found: list[list[str]] = []
    todo, seen = [frozenset()], set()
    while todo and len(found) < most:
        left_out = todo.pop(0)
        if left_out in seen:
            continue
        seen.add(left_out)
        one = next((f for f in found if not left_out & set(f)), None)
        if one is None:
            rest = [b for b in every if b not in left_out]
            if not _entailed(rest, goal):
                continue
            one = least(rest)
            found.append(one)
        todo += [left_out | {b} for b in one]
    return found


def unsatisfiable_roots(axioms: DataFrame) -> DataFrame:
    """(``id``): unsatisfiable classes that do not owe it to another: none of their asserted superclasses and fillers is unsatisfiable."""
    bad = classify(axioms).unsatisfiable()
    rows = axioms.filter(F.col("type").isin("SubClassOf", "EquivalentClasses")).select("axiom_id", "body", F.explode("signature").alias("needs"))
    uses = rows.select(F.get_json_object("body", "$[1]").alias("id"), "needs").filter("id <> needs")
    owed = uses.join(bad.withColumnRenamed("id", "needs"), "needs", "left_semi").select("id").distinct()
    return bad.join(owed, "id", "left_anti")


# --- profiles

#: What each OWL 2 profile allows: class expressions below and above a subclass axiom, and axiom types.
_EL = "ObjectIntersectionOf ObjectSomeValuesFrom ObjectHasValue ObjectHasSelf ObjectOneOf DataSomeValuesFrom DataHasValue".split()
PROFILES = {
    "EL": {
        "sub": _EL,
        "sup": _EL,
        "axioms": "SubClassOf EquivalentClasses DisjointClasses SubObjectPropertyOf EquivalentObjectProperties ObjectPropertyDomain ObjectPropertyRange ReflexiveObjectProperty TransitiveObjectProperty SubDataPropertyOf EquivalentDataProperties DataPropertyDomain DataPropertyRange FunctionalDataProperty ClassAssertion ObjectPropertyAssertion NegativeObjectPropertyAssertion DataPropertyAssertion NegativeDataPropertyAssertion SameIndividual DifferentIndividuals HasKey DatatypeDefinition".split(),
        "inverse": False,
        "chain": True,
    },
    "QL": {
        "sub": ["ObjectSomeValuesFrom", "DataSomeValuesFrom"],
        "sup": "ObjectIntersectionOf ObjectComplementOf ObjectSomeValuesFrom DataSomeValuesFrom".split(),
        "axioms": "SubClassOf EquivalentClasses DisjointClasses SubObjectPropertyOf EquivalentObjectProperties DisjointObjectProperties InverseObjectProperties ObjectPropertyDomain ObjectPropertyRange ReflexiveObjectProperty IrreflexiveObjectProperty SymmetricObjectProperty AsymmetricObjectProperty SubDataPropertyOf EquivalentDataProperties DisjointDataProperties DataPropertyDomain DataPropertyRange ClassAssertion ObjectPropertyAssertion DataPropertyAssertion DifferentIndividuals DatatypeDefinition".split(),
        "inverse": True,
        "chain": False,
    },
    "RL": {
        "sub": "ObjectIntersectionOf ObjectUnionOf ObjectOneOf ObjectSomeValuesFrom ObjectHasValue DataSomeValuesFrom DataHasValue".split(),
        "sup": "ObjectIntersectionOf ObjectComplementOf ObjectAllValuesFrom ObjectHasValue ObjectMaxCardinality DataAllValuesFrom DataHasValue DataMaxCardinality".split(),
        "axioms": "SubClassOf EquivalentClasses DisjointClasses SubObjectPropertyOf EquivalentObjectProperties DisjointObjectProperties InverseObjectProperties ObjectPropertyDomain ObjectPropertyRange FunctionalObjectProperty InverseFunctionalObjectProperty IrreflexiveObjectProperty SymmetricObjectProperty AsymmetricObjectProperty TransitiveObjectProperty SubDataPropertyOf EquivalentDataProperties DisjointDataProperties DataPropertyDomain DataPropertyRange FunctionalDataProperty HasKey ClassAssertion ObjectPropertyAssertion NegativeObjectPropertyAssertion DataPropertyAssertion NegativeDataPropertyAssertion SameIndividual DifferentIndividuals DatatypeDefinition".split(),
        "inverse": True,
        "chain": True,
    },
}
_ALWAYS = ["Declaration", *ax.GROUPS["annotation"]]


def _faults(axiom: list, profile: str) -> Iterator[str]:
    p = PROFILES[profile]
    op, *args = [k for k in axiom if not (isinstance(k, list) and k[0] == "Annotations")]
    if op in _ALWAYS:
        return
    if op not in p["axioms"]:
        yield f"{op} axiom"
        return

    def role(r) -> Iterator[str]:
        if isinstance(r, list) and r[0] == "ObjectInverseOf" and not p["inverse"]:
            yield "ObjectInverseOf"
        if isinstance(r, list) and r[0] == "ObjectPropertyChain":
            if not p["chain"]:
                yield "ObjectPropertyChain"
            for x in r[1:]:
                yield from role(x)

    def ce(x, side: str) -> Iterator[str]:
        if isinstance(x, str):
            if profile == "RL" and x in (TOP, "http://www.w3.org/2002/07/owl#Thing"):
                yield f"{TOP} as {side}class"
            return
        kind, *a = x
        if kind not in p[side]:
            yield f"{kind} as {side}class"
            return
        if kind in ("ObjectIntersectionOf", "ObjectUnionOf"):
            for k in a:
                yield from ce(k, side)
        elif kind == "ObjectOneOf":
            if profile == "EL" and len(a) != 1:
                yield "ObjectOneOf of several individuals"
        elif kind == "ObjectComplementOf":
            yield from ce(a[0], "sub")
        elif kind == "ObjectSomeValuesFrom":
            yield from role(a[0])
            if profile == "QL" and side == "sub":
                if a[1] not in (TOP, "http://www.w3.org/2002/07/owl#Thing"):
                    yield "a filler in a subclass"
            elif profile == "QL" and isinstance(a[1], list):
                yield "a filler that is no class"
            elif not (profile == "RL" and a[1] in (TOP, "http://www.w3.org/2002/07/owl#Thing")):
                yield from ce(a[1], side)
        elif kind == "ObjectAllValuesFrom":
            yield from role(a[0])
            yield from ce(a[1], side)
        elif kind in ("ObjectMaxCardinality", "DataMaxCardinality"):
            if int(a[0]) > 1:
                yield f"{kind} above one"
            if kind == "ObjectMaxCardinality" and len(a) > 2 and a[2] not in (TOP, "http://www.w3.org/2002/07/owl#Thing"):
                yield from ce(a[2], "sub")
        elif kind in ("ObjectHasValue", "ObjectHasSelf"):
            yield from role(a[0])

    if op == "SubClassOf":
        yield from ce(args[0], "sub")
        yield from ce(args[1], "sup")
    elif op == "EquivalentClasses":
        for x in args:
            yield from ce(x, "sub")
            yield from ce(x, "sup")
    elif op == "DisjointClasses":
        for x in args:
            yield from ce(x, "sub")
    elif op in ("ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain"):
        yield from role(args[0])
        yield from ce(args[1], "sup")
    elif op == "ClassAssertion":
        yield from ce(args[0], "sup")
    else:
        for x in args:
            yield from role(x)


def profile_violations(axioms: DataFrame, profile: str = "EL") -> DataFrame:
    """(``axiom_id``, ``type``, ``violation``): what keeps each axiom out of the OWL 2 profile EL, QL or RL; of ``DL``, uses of non-simple roles and punned properties.

    A role is not simple if it is transitive, implied by a chain, or above such a role.
    """
    if profile == "DL":
        return _dl_violations(axioms)
    if profile not in PROFILES:
        raise ValueError(profile)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, t, v) for i, t, b in zip(part["axiom_id"], part["type"], part["body"], strict=True) for v in dict.fromkeys(_faults(json.loads(b), profile))]
            yield pd.DataFrame(rows, columns=["axiom_id", "type", "violation"])

    return axioms.select("axiom_id", "type", "body").mapInPandas(run, "axiom_id string, type string, violation string")


#: Where OWL 2 DL wants simple roles.
_SIMPLE_AXIOMS = "FunctionalObjectProperty InverseFunctionalObjectProperty IrreflexiveObjectProperty AsymmetricObjectProperty DisjointObjectProperties".split()
_SIMPLE_EXPRESSIONS = "ObjectMinCardinality ObjectMaxCardinality ObjectExactCardinality ObjectHasSelf".split()


def _roles(x, simple_only: bool) -> Iterator[str]:
    """Named roles of an axiom in places that want simple ones."""
    if isinstance(x, list):
        at = {"ObjectHasSelf": 1}.get(x[0], 2)
        if x[0] in _SIMPLE_EXPRESSIONS or x[0] in _SIMPLE_AXIOMS and simple_only:
            for r in [x[at]] if x[0] in _SIMPLE_EXPRESSIONS else x[1:]:
                yield r if isinstance(r, str) else r[1]
        for k in x[1:]:
            yield from _roles(k, False)


def _dl_violations(axioms: DataFrame) -> DataFrame:
    b = lambda path: F.get_json_object("body", path)
    up = axioms.filter("type = 'SubObjectPropertyOf'").select(b("$[1]").alias("subject"), b("$[2]").alias("object"))
    named = up.filter("subject not like '[%'")
    start = axioms.filter("type = 'TransitiveObjectProperty'").select(b("$[1]").alias("r")).union(up.filter("subject like '[%'").select("object"))
    above = closure(named, by=()).join(start.withColumnRenamed("r", "subject"), "subject", "left_semi").select(F.col("object").alias("r"))
    complex_roles = start.union(above).distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, t, r) for i, t, x in zip(part["axiom_id"], part["type"], part["body"], strict=True) for r in dict.fromkeys(_roles(json.loads(x), True))]
            yield pd.DataFrame(rows, columns=["axiom_id", "type", "r"])

    used = axioms.select("axiom_id", "type", "body").mapInPandas(run, "axiom_id string, type string, r string")
    simple = used.join(complex_roles, "r", "left_semi").select("axiom_id", "type", F.concat(F.lit("non-simple role "), "r").alias("violation"))
    kinds = axioms.filter("type = 'Declaration'").select("axiom_id", "type", b("$[1][0]").alias("kind"), b("$[1][1]").alias("id"))
    for one, two in (("ObjectProperty", "DataProperty"), ("ObjectProperty", "AnnotationProperty"), ("DataProperty", "AnnotationProperty"), ("Class", "Datatype")):
        twice = kinds.filter(F.col("kind") == one).join(kinds.filter(F.col("kind") == two).select("id"), "id", "left_semi")
        simple = simple.union(twice.select("axiom_id", "type", F.concat(F.lit(f"{one} and {two}: "), "id")))
    return simple.distinct()
