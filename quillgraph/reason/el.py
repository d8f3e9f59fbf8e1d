"""EL classification: axioms to normal forms, a fixpoint over them, and what can be read off it.

Every axiom is normalised on its own: a complex expression's name is a hash of it, so tasks agree on names without talking. Expressions
outside EL (values, unions to the right, complements, ...) stand for themselves: equal ones are equal, and a class and its complement are disjoint.

``S`` (x, d) says that x is subsumed by d; ``R`` (r, x, y) that x has an r-successor in y. A round joins only what the
last round found with the rules and with all that is known. EL is Horn, so the order does not matter, and no round repeats another's work.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure
from quillgraph.session import Kept

TOP, BOTTOM = "owl:Thing", "owl:Nothing"
FORMS = "kind string, a string, b string, c string"
MAX_ROUNDS = 500
_THING = {TOP, "http://www.w3.org/2002/07/owl#Thing"}
_NOTHING = {BOTTOM, "http://www.w3.org/2002/07/owl#Nothing"}


def _named(x) -> str:
    return "x:" + hashlib.sha256(json.dumps(x, ensure_ascii=False).encode()).hexdigest()[:24]


class _Normaliser:
    def __init__(self):
        self.out: set[tuple] = set()

    def emit(self, kind: str, a: str, b: str | None = None, c: str | None = None) -> None:
        self.out.add((kind, a, b, c))

    def atom(self, x: str) -> str:
        x = TOP if x in _THING else BOTTOM if x in _NOTHING else x
        self.emit("concept", x)
        return x

    def nominal(self, i: str) -> str:
        n = f"i:{i}"
        self.emit("concept", n)
        self.emit("individual", n)
        return n

    def expression(self, x, left: bool, right: bool) -> str:
        """The name of an expression, with what holds if it stands below (``left``) or above (``right``) something."""
        if isinstance(x, str):
            return self.atom(x)
        op, *args = x
        if op == "ObjectHasValue":
            return self.some(x, args[0], self.nominal(args[1]), left, right)
        if op == "ObjectSomeValuesFrom" and isinstance(args[0], str):
            return self.some(x, args[0], self.expression(args[1], left, right), left, right)
        if op == "ObjectOneOf" and len(args) == 1:
            return self.nominal(args[0])
        n = _named(x)
        self.emit("concept", n)
        if op == "ObjectIntersectionOf":
            parts = [self.expression(p, left, right) for p in args]
            if right:
                for p in parts:
                    self.emit("sub", n, p)
            if left:
                so_far = parts[0]
                for k, p in enumerate(parts[1:], 2):
                    whole = n if k == len(parts) else _named(["and", *args[:k]])
                    self.emit("concept", whole)
                    self.emit("conj", so_far, p, whole)
                    so_far = whole
                if len(parts) == 1:
                    self.emit("sub", so_far, n)
        elif op in ("ObjectUnionOf", "ObjectOneOf"):
            for p in args:
                part = self.nominal(p) if op == "ObjectOneOf" else self.expression(p, left, False)
                if left:
                    self.emit("sub", part, n)
        elif op == "ObjectComplementOf":
            self.emit("conj", n, self.expression(args[0], True, False), BOTTOM)
        elif op == "ObjectHasSelf" and isinstance(args[0], str) and right:
            self.emit("some_sup", n, args[0], n)
        return n

    def some(self, x, role: str, filler: str, left: bool, right: bool) -> str:
        n = _named(["some", role, filler])
        self.emit("concept", n)
        if right:
            self.emit("some_sup", n, role, filler)
        if left:
            self.emit("some_sub", role, filler, n)
        return n

    def below(self, c, d) -> None:
        self.emit("sub", self.expression(c, True, False), self.expression(d, False, True))

    def disjoint(self, names: list[str]) -> None:
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                self.emit("conj", a, b, BOTTOM)

    def axiom(self, x: list) -> None:
        op, *args = [k for k in x if not (isinstance(k, list) and k[0] == "Annotations")]
        if op in ("SubClassOf",):
            self.below(*args)
        elif op == "EquivalentClasses":
            for a, b in zip(args, [*args[1:], args[0]], strict=True):
                self.below(a, b)
        elif op == "DisjointClasses":
            self.disjoint([self.expression(a, True, False) for a in args])
        elif op == "DisjointUnion":
            self.below(args[0], ["ObjectUnionOf", *sorted(args[1:], key=json.dumps)])
            self.below(["ObjectUnionOf", *sorted(args[1:], key=json.dumps)], args[0])
            self.disjoint([self.expression(a, True, False) for a in args[1:]])
        elif op == "ObjectPropertyDomain" and isinstance(args[0], str):
            self.below(["ObjectSomeValuesFrom", args[0], TOP], args[1])
        elif op == "ObjectPropertyRange" and isinstance(args[0], str):
            self.emit("range", args[0], self.expression(args[1], False, True))
        elif op == "SubObjectPropertyOf" and isinstance(args[1], str):
            if isinstance(args[0], str):
                self.emit("role", args[0], args[1])
            elif args[0][0] == "ObjectPropertyChain" and all(isinstance(r, str) for r in args[0][1:]):
                so_far = args[0][1]
                for k, r in enumerate(args[0][2:], 3):
                    whole = args[1] if k == len(args[0]) else _named(["chain", *args[0][1:k]])
                    self.emit("chain", so_far, r, whole)
                    so_far = whole
        elif op == "EquivalentObjectProperties" and all(isinstance(r, str) for r in args):
            for a, b in zip(args, [*args[1:], args[0]], strict=True):
                self.emit("role", a, b)
        elif op == "TransitiveObjectProperty" and isinstance(args[0], str):
            self.emit("chain", args[0], args[0], args[0])
        elif op == "ReflexiveObjectProperty" and isinstance(args[0], str):
            self.emit("reflexive", args[0])
        elif op == "ClassAssertion":
            self.emit("sub", self.nominal(args[1]), self.expression(args[0], False, True))
        elif op == "ObjectPropertyAssertion" and isinstance(args[0], str):
            self.emit("some_sup", self.nominal(args[1]), args[0], self.nominal(args[2]))
        elif op == "SameIndividual":
            names = [self.nominal(i) for i in args]
            for a, b in zip(names, [*names[1:], names[0]], strict=True):
                self.emit("sub", a, b)
        elif op == "DifferentIndividuals":
            self.disjoint([self.nominal(i) for i in args])
        elif op == "Declaration":
            if args[0][0] == "Class":
                self.atom(args[0][1])
            elif args[0][0] == "NamedIndividual":
                self.nominal(args[0][1])


def normalise(axioms: DataFrame) -> DataFrame:
    """The normal forms (``kind``, ``a``, ``b``, ``c``) of ``axioms`` (``body``)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            n = _Normaliser()
            for body in part["body"]:
                n.axiom(json.loads(body))
            yield pd.DataFrame(sorted(n.out, key=str), columns=["kind", "a", "b", "c"])

    return axioms.select("body").mapInPandas(run, FORMS).distinct()


class Classification:
    """``S`` (x, d) and ``R`` (r, x, y), saturated."""

    def __init__(self, forms: DataFrame):
        self.kept = Kept(forms.sparkSession, "el")
        self.forms = self.kept.keep(forms, "forms")
        self._saturate()

    def _of(self, kind: str, *names: str) -> DataFrame:
        return self.forms.filter(F.col("kind") == kind).select(*[F.col(c).alias(n) for c, n in zip("abc", names, strict=False)])

    def _saturate(self) -> None:
        keep = self.kept.keep
        sub = self._of("sub", "d", "e")
        conj = self._of("conj", "d", "d2", "e")
        conj = keep(conj.union(conj.select(F.col("d2").alias("d"), F.col("d").alias("d2"), "e")).distinct(), "conj")
        some_sup, some_sub = self._of("some_sup", "d", "r", "y"), self._of("some_sub", "r", "f", "e")
        chain = self._of("chain", "r1", "r2", "r3")
        roles = self.forms.filter("kind in ('role', 'chain', 'reflexive', 'range')").select("kind", "a", "b", "c")
        names = roles.select(F.col("a").alias("r")).union(roles.filter("kind = 'role' or kind = 'chain'").select("b")).union(roles.filter("kind = 'chain'").select("c")).union(some_sup.select("r")).union(some_sub.select("r")).distinct()
        up = closure(self._of("role", "subject", "object"), by=()).select(F.col("subject").alias("r"), F.col("object").alias("s"))
        up = keep(up.union(names.select("r", F.col("r").alias("s"))).distinct(), "roles")

        # a successor under a role with ranges is in them too: it gets a name of its own
        ranges = up.join(self._of("range", "s", "c"), "s").select("r", "c").distinct().groupBy("r").agg(F.sort_array(F.collect_set("c")).alias("cs"))
        ranged = some_sup.join(ranges, "r").withColumn("n", F.concat(F.lit("x:"), F.substr(F.sha2(F.concat_ws("\u0001", F.lit("range"), "y", F.array_join("cs", "\u0001")), 256), F.lit(1), F.lit(24))))
        some_sup = some_sup.join(ranges, "r", "left_anti").select("d", "r", "y").union(ranged.select("d", "r", F.col("n").alias("y")))
        some_sup = keep(some_sup.distinct(), "some_sup")
        sub = keep(sub.union(ranged.select(F.col("n").alias("d"), F.col("y").alias("e"))).union(ranged.select(F.col("n").alias("d"), F.explode("cs").alias("e"))).distinct(), "sub")

        x = self._of("concept", "x").union(some_sup.select("y")).union(sub.select("d")).union(self.forms.sparkSession.createDataFrame([(TOP,)], "x string")).distinct()
        s_new = keep(x.select("x", F.col("x").alias("d")).union(x.select("x", F.lit(TOP).alias("d"))).distinct(), "s0")
        reflexive = self._of("reflexive", "r").join(up, "r").select(F.col("s").alias("r")).distinct()
        r_new = keep(reflexive.crossJoin(x).select("r", "x", F.col("x").alias("y")), "r0")  # few roles are reflexive
        s_all, r_all = s_new, r_new
        for i in range(1, MAX_ROUNDS + 1):
            y = s_all.select(F.col("x").alias("y"), F.col("d").alias("f"))
            y_new = s_new.select(F.col("x").alias("y"), F.col("d").alias("f"))
            bottom, bottom_new = y.filter(F.col("f") == BOTTOM).select("y"), y_new.filter(F.col("f") == BOTTOM).select("y")
            s_found = [
                s_new.join(sub, "d").select("x", F.col("e").alias("d")),
                s_new.join(conj, "d").join(s_all.select("x", F.col("d").alias("d2")), ["x", "d2"]).select("x", F.col("e").alias("d")),
                r_new.join(some_sub, "r").join(y, ["y", "f"]).select("x", F.col("e").alias("d")),
                y_new.join(some_sub, "f").join(r_all, ["r", "y"]).select("x", F.col("e").alias("d")),
                r_new.join(bottom, "y").select("x", F.lit(BOTTOM).alias("d")),
                r_all.join(bottom_new, "y").select("x", F.lit(BOTTOM).alias("d")),
            ]
            one = r_new.select(F.col("r").alias("r1"), "x", F.col("y").alias("m"))
            two = r_new.select(F.col("r").alias("r2"), F.col("x").alias("m"), "y")
            all_one = r_all.select(F.col("r").alias("r1"), "x", F.col("y").alias("m"))
            all_two = r_all.select(F.col("r").alias("r2"), F.col("x").alias("m"), "y")
            r_found = [
                s_new.join(some_sup, "d").select("r", "x", "y"),
                one.join(chain, "r1").join(all_two, ["r2", "m"]).select(F.col("r3").alias("r"), "x", "y"),
                two.join(chain, "r2").join(all_one, ["r1", "m"]).select(F.col("r3").alias("r"), "x", "y"),
            ]
            r_wide = reduce(DataFrame.union, r_found).join(up, "r").select(F.col("s").alias("r"), "x", "y").distinct()
            s_next = keep(reduce(DataFrame.union, s_found).distinct().join(s_all, ["x", "d"], "left_anti"), f"s{i}")
            r_next = keep(r_wide.join(r_all, ["r", "x", "y"], "left_anti"), f"r{i}")
            if s_next.isEmpty() and r_next.isEmpty():
                self.S, self.R = s_all, r_all
                return
            s_new, r_new = s_next, r_next
            s_all, r_all = s_all.union(s_new), r_all.union(r_new)
            if i % 8 == 0:
                s_all, r_all = keep(s_all, f"sall{i}"), keep(r_all, f"rall{i}")
        raise RuntimeError(f"no fixpoint in {MAX_ROUNDS} rounds")

    # --- what it says
    def is_consistent(self) -> bool:
        bad = self.S.filter(F.col("d") == BOTTOM)
        return bad.filter((F.col("x") == TOP) | F.col("x").startswith("i:")).isEmpty()

    def _plain(self, c: str):
        return ~F.col(c).startswith("x:") & ~F.col(c).startswith("i:") & ~F.col(c).isin(TOP, BOTTOM)

    def unsatisfiable(self) -> DataFrame:
        return self.S.filter((F.col("d") == BOTTOM) & self._plain("x")).select(F.col("x").alias("id")).distinct()

    def subsumptions(self) -> DataFrame:
        """(``subject``, ``object``): strict ones between named, satisfiable classes."""
        bad = self.unsatisfiable().select(F.col("id").alias("x"))
        s = self.S.filter(self._plain("x") & self._plain("d") & (F.col("x") != F.col("d"))).join(bad, "x", "left_anti")
        return s.select(F.col("x").alias("subject"), F.col("d").alias("object")).distinct()

    def equivalent_pairs(self) -> DataFrame:
        s = self.subsumptions()
        return s.join(s.select(F.col("object").alias("subject"), F.col("subject").alias("object")), ["subject", "object"]).filter("subject < object")

    def direct(self) -> DataFrame:
        """Subsumptions with no class strictly between; classes that are equivalent do not stand between."""
        s = self.kept.keep(self.subsumptions(), "subsumptions")
        back = s.select(F.col("object").alias("subject"), F.col("subject").alias("object"))
        strict = self.kept.keep(s.join(back, ["subject", "object"], "left_anti"), "strict")
        two = strict.withColumnRenamed("object", "m").join(strict.withColumnRenamed("subject", "m"), "m").select("subject", "object")
        return strict.join(two.distinct(), ["subject", "object"], "left_anti")

    def materialised(self) -> DataFrame:
        """(``subject``, ``predicate``, ``object``): relations between different named classes."""
        below = self.S.select(F.col("x").alias("y"), F.col("d").alias("o"))
        rows = self.R.filter(self._plain("x") & ~F.col("r").startswith("x:")).join(below, "y").filter(self._plain("o"))
        bad = self.unsatisfiable().select(F.col("id").alias("x"))
        return rows.join(bad, "x", "left_anti").select(F.col("x").alias("subject"), F.col("r").alias("predicate"), F.col("o").alias("object")).distinct()

    def types(self) -> DataFrame:
        """(``individual``, ``type``)."""
        s = self.S.filter(F.col("x").startswith("i:") & self._plain("d"))
        return s.select(F.substr("x", F.lit(3)).alias("individual"), F.col("d").alias("type")).distinct()


def classify(axioms: DataFrame) -> Classification:
    return Classification(normalise(axioms))


def dl_query(axioms: DataFrame, expression, kind: str = "descendants") -> DataFrame:
    """Named classes (or individuals) below, above or equal to a class expression given as nested lists."""
    body = json.dumps(["EquivalentClasses", "query:class", expression])
    spark = axioms.sparkSession
    c = classify(axioms.select("body").union(spark.createDataFrame([(body,)], "body string")))
    s = c.subsumptions()
    below = s.filter("object = 'query:class'").select(F.col("subject").alias("id"))
    above = s.filter("subject = 'query:class'").select(F.col("object").alias("id"))
    if kind == "descendants":
        return below.join(above, "id", "left_anti")
    if kind == "ancestors":
        return above.join(below, "id", "left_anti")
    if kind == "equivalents":
        return above.join(below, "id", "left_semi")
    if kind in ("children", "parents"):
        d = c.direct()
        return d.filter("object = 'query:class'").select(F.col("subject").alias("id")) if kind == "children" else d.filter("subject = 'query:class'").select(F.col("object").alias("id"))
    if kind == "instances":
        return c.types().filter("type = 'query:class'").select(F.col("individual").alias("id"))
    raise ValueError(kind)
