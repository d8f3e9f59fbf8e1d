"""SPARQL algebra to DataFrame plans over ``quads(g, s, p, o)``.

A term is one string: ``<iri>``, ``_:label``, ``"lexical"^^datatype`` or ``"lexical"@lang``; an unbound variable is null, so that joins on
variables are plain equi-joins, which Catalyst orders, pushes filters through and broadcasts. Only a variable that may be unbound on a
side, as told from the pattern, is joined by SPARQL's compatibility.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.closure import closure
from quillgraph.session import Kept
from quillgraph.sparql.parser import Parser, Query, iri, literal

Plan = tuple[DataFrame, set[str], set[str]]  # rows, variables, those that may be unbound


def quads_of(statements: DataFrame) -> DataFrame:
    """``statements`` as quads in the default graph."""

    def node(c: str) -> Column:
        return F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    lit = F.when(F.coalesce("language", F.lit("")) != "", F.concat(F.lit('"'), F.col("value"), F.lit('"@'), F.lower("language"))).otherwise(F.concat(F.lit('"'), F.col("value"), F.lit('"^^'), F.coalesce("datatype", F.lit("xsd:string"))))
    return statements.select(F.lit("").alias("g"), node("subject").alias("s"), node("predicate").alias("p"), F.when(F.col("object").isNotNull(), node("object")).otherwise(lit).alias("o"))


def lexical(t: Column) -> Column:
    """What STR gives: an IRI without brackets, a literal without type and language."""
    return F.when(t.startswith("<"), F.substr(t, F.lit(2), F.length(t) - 2)).when(t.startswith('"'), F.regexp_extract(t, '(?s)^"(.*)"(?:\\^\\^|@)[^"]*$', 1)).otherwise(t)


def datatype(t: Column) -> Column:
    return F.when(t.rlike('(?s)^".*"@[^"]*$'), "rdf:langString").otherwise(F.regexp_extract(t, '(?s)"\\^\\^([^"]*)$', 1))


_NUMERIC = ("xsd:integer", "xsd:decimal", "xsd:double", "xsd:float", "xsd:int", "xsd:long", "xsd:nonNegativeInteger")


def _has_closure(p) -> bool:
    return isinstance(p, tuple) and (p[0] in ("star", "plus") or p[0] in ("seq", "alt", "inv", "opt") and any(_has_closure(x) for x in p[1:]))


class Engine:
    def __init__(self, quads: DataFrame, prefixes: dict[str, str] | None = None):
        self.quads, self.prefixes, self.spark = quads, prefixes or {}, quads.sparkSession
        self._default = quads.select("s", "p", "o").distinct() if "g" in quads.columns else quads
        self._closures: dict = {}

    # --- entry points
    def query(self, text: str) -> DataFrame:
        """SELECT: a column for each variable, as lexical forms. ASK: one row ``ask``. CONSTRUCT and DESCRIBE: ``s``, ``p``, ``o`` terms."""
        q = Parser(text, self.prefixes).query()
        if q.form == "select":
            df, names = self.select(q)
            return df.select(*[lexical(F.col(f"`{n}`")).alias(n) for n in names])
        if q.form == "ask":
            return self.group(q.where)[0].limit(1).agg((F.count("*") > 0).alias("ask"))
        if q.form == "construct":
            return self.template(q.template, self.group(q.where)[0])
        terms = [t[1] for t in q.describe if t[0] == "term"]
        found = self._default.filter(F.col("s").isin(terms)) if terms else None
        for t in q.describe:
            if t[0] == "var":
                ids = self.group(q.where)[0].select(F.col(t[1]).alias("s")).distinct()
                rows = self._default.join(ids, "s", "left_semi")
                found = rows if found is None else found.union(rows)
        return found.distinct()

    def solutions(self, text: str) -> DataFrame:
        """A SELECT's rows as terms: IRIs in brackets, literals with their type or language."""
        q = Parser(text, self.prefixes).query()
        if q.form != "select":
            raise ValueError("only SELECT has solutions")
        df, names = self.select(q)
        return df.select(*[F.col(f"`{n}`") for n in names])

    def explain(self, text: str, mode: str = "formatted") -> str:
        """The physical plan of a query."""
        df = self.query(text)
        return self.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)

    def update(self, text: str) -> DataFrame:
        """The quads after all updates, in order."""
        now = self.quads
        for u in Parser(text, self.prefixes).updates():
            e = Engine(now, self.prefixes)
            rows = e.group(u.where)[0]
            graph = F.lit("").alias("g")
            if u.delete:
                now = now.join(e.template(u.delete, rows), ["s", "p", "o"], "left_anti").select("g", "s", "p", "o")
            if u.insert:
                now = now.unionByName(e.template(u.insert, rows).select(graph, "s", "p", "o")).distinct()
        return now

    def template(self, triples: list, rows: DataFrame) -> DataFrame:
        def column(t: tuple, i: int) -> Column:
            if t[0] == "var":
                if t[1] in rows.columns:
                    return F.col(t[1])
                # a blank node of the template: a new one for each solution
                return F.concat(F.lit(f"_:{t[1]}x"), F.sha1(F.concat_ws("\u0001", *[F.coalesce(F.col(c), F.lit("")) for c in sorted(rows.columns)])) if rows.columns else F.lit("0"))
            return F.lit(t[1])

        arms = [rows.select(column(s, 0).alias("s"), column(p if p[0] == "var" else ("term", p[1]), 1).alias("p"), column(o, 2).alias("o")) for kind, s, p, o in triples if kind == "triple"]
        return reduce(DataFrame.union, arms).filter(F.col("s").isNotNull() & F.col("p").isNotNull() & F.col("o").isNotNull() & ~F.col("s").startswith('"') & F.col("p").startswith("<")).distinct()

    # --- SELECT
    def select(self, q: Query) -> tuple[DataFrame, list[str]]:
        df, names, _ = self.group(q.where)
        aggregated = bool(q.group_by) or any(self._has_aggregate(e) for e, _ in q.select)
        if aggregated:
            keys = []
            for e, name in q.group_by:
                name = name or f"_g{len(keys)}"
                if e != ("var", name):
                    df = df.withColumn(name, self.as_term(self.expr(e, df)))
                keys.append(name)
            wanted = [(e, n) for e, n in q.select if not (e[0] == "var" and e[1] == n and n in keys)]
            having = [self._named(h, {n: e for e, n in wanted}) for h in q.having]
            hidden = [(h, f"_h{i}") for i, h in enumerate(having)]
            aggs = [self.as_term(self.expr(e, df)).alias(n) for e, n in wanted] + [self.truth(self.expr(h, df)).alias(n) for h, n in hidden]
            aggs = aggs or [F.count("*").alias("_n")]
            df = df.groupBy(*keys).agg(*aggs)
            for _, n in hidden:
                df = df.filter(F.col(n))
            out = [n for _, n in q.select]
        else:
            for e, n in q.select:
                if e != ("var", n):
                    df = df.withColumn(n, self.as_term(self.expr(e, df)))
            for _, n in q.select:
                if n not in df.columns:
                    df = df.withColumn(n, F.lit(None).cast("string"))
            out = [n for _, n in q.select] or sorted(n for n in names if not n.startswith("_"))
        order = []
        for e, descending in q.order_by:
            value = self.expr(e, df)
            t = self.as_term(value)
            rank = F.when(t.isNull(), 0).when(t.startswith("_:"), 1).when(t.startswith("<"), 2).otherwise(3)
            parts = [rank, lexical(t).try_cast("double"), lexical(t), t]
            order += [p.desc() if descending else p.asc() for p in parts]
        if q.distinct:
            if order:
                df = df.select(*out, *[x for x in df.columns if x not in out]) if set(df.columns) == set(out) else df.dropDuplicates(out) if all(e[0] == "var" and e[1] in out for e, _ in q.order_by) else df.select(*out).distinct()
                order = order if all(e[0] == "var" and e[1] in out for e, _ in q.order_by) else [F.col(c) for c in out]
                df = df.dropDuplicates(out)
            else:
                df = df.select(*out).distinct()
        if order:
            df = df.orderBy(*order, *[F.col(c) for c in out])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*out), out

    def _has_aggregate(self, e) -> bool:
        return isinstance(e, tuple) and (e[0] == "agg" or any(self._has_aggregate(x) if isinstance(x, tuple) else isinstance(x, list) and any(self._has_aggregate(y) for y in x) for x in e[1:]))

    def _named(self, e, names: dict):
        """HAVING may speak of a projected aggregate by its name."""
        if isinstance(e, tuple):
            if e[0] == "var" and e[1] in names:
                return names[e[1]]
            return tuple(self._named(x, names) if isinstance(x, tuple | list) else x for x in e)
        if isinstance(e, list):
            return [self._named(x, names) for x in e]
        return e

    # --- patterns
    def group(self, g: tuple, rows: DataFrame | None = None) -> Plan:
        plan: Plan = (self.spark.range(1).select(), set(), set())
        filters, started = [], False
        triples: list = []

        def flush() -> None:
            nonlocal plan, triples, started
            # the most selective patterns first, closures without a known end last; each joined to what it shares a variable with
            todo = sorted(triples, key=lambda t: (sum(x[0] == "var" for x in (t[1], t[3])) + 2 * (t[2][0] == "var") + (t[2] == ("iri", iri("rdf:type"))) + 3 * (_has_closure(t[2]) and t[1][0] == t[3][0] == "var")))
            while todo:
                pick = next((t for t in todo if not started or plan[1] & {x[1] for x in t[1:] if x[0] == "var"}), todo[0])
                todo.remove(pick)
                plan = self.join(plan, self.triple(pick, plan)) if started else self.triple(pick)
                started = True
            triples = []

        for e in g[1]:
            if e[0] == "triple":
                triples.append(e)
                continue
            if e[0] == "filter":
                filters.append(e[1])
                continue
            flush()
            if e[0] == "optional":
                plan = self.left(plan, e[1])
            elif e[0] == "minus":
                plan = self.minus(plan, self.group(e[1]))
            elif e[0] == "bind":
                df, names, maybe = plan
                plan = (df.withColumn(e[2], self.as_term(self.expr(e[1], df))), names | {e[2]}, maybe | {e[2]})
            else:
                if e[0] == "union":
                    new = self.union([self.group(a) for a in e[1]])
                elif e[0] == "values":
                    new = self.values(e)
                elif e[0] == "graph":
                    new = self.graph(e)
                else:
                    df, out = self.select(e[1])
                    new = (df, set(out), set(out))
                plan = self.join(plan, new) if started else new
            started = True
        flush()
        for f in filters:
            plan = self.filter(plan, f)
        return plan

    def triple(self, t: tuple, plan: Plan | None = None) -> Plan:
        """A pattern's rows; a path with closures starts from an end that is known: a term, or a variable that ``plan`` binds in every row."""
        _, s, p, o = t
        if p[0] == "var":
            df = self._default
            cols = [("s", s), ("p", p), ("o", o)]
        else:
            cols = [("s", s), ("o", o)]
            known = [(c, x) for c, x in cols if x[0] == "term"] + [(c, x) for c, x in cols if plan and x[0] == "var" and x[1] in plan[1] - plan[2]]
            if known and _has_closure(p):
                end, x = known[0]
                if x[0] == "term":
                    seeds = self.spark.createDataFrame([(x[1],)], "n string")
                else:
                    values = plan[0].select(F.col(x[1]).alias("n")).distinct()
                    nodes = [values.join(self._default.select(F.col(c).alias("n")), "n", "left_semi") for c in ("s", "o")]
                    seeds = nodes[0].union(nodes[1]).distinct()
                df = self.path_from(p, seeds, end)
            else:
                df = self.path(p)
        names: dict[str, str] = {}
        for c, x in cols:
            if x[0] == "term":
                df = df.filter(F.col(c) == x[1])
            elif x[1] in names:
                df = df.filter(F.col(c) == F.col(names[x[1]]))
            else:
                names[x[1]] = c
        return df.select(*[F.col(c).alias(n) for n, c in names.items()]), set(names), set()

    def path_from(self, p: tuple, seeds: DataFrame, end: str) -> DataFrame:
        """(s, o) of a path whose ``end`` is one of ``seeds`` (``n``): as ``path``, but closures grow from the seeds alone."""
        other = "o" if end == "s" else "s"
        if p[0] == "inv":
            return self.path_from(p[1], seeds, other).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if p[0] == "alt":
            return self.path_from(p[1], seeds, end).union(self.path_from(p[2], seeds, end))
        if p[0] == "seq":
            one, two = (p[1], p[2]) if end == "s" else (p[2], p[1])
            near = self.path_from(one, seeds, end).withColumnRenamed(other, "_m")
            far = self.path_from(two, near.select(F.col("_m").alias("n")).distinct(), end).withColumnRenamed(end, "_m")
            return near.join(far, "_m").select("s", "o")
        if p[0] not in ("star", "plus", "opt"):
            return self.path(p).join(seeds.withColumnRenamed("n", end), end, "left_semi").select("s", "o")
        own = seeds.select(F.col("n").alias("s"), F.col("n").alias("o"))
        if p[0] == "opt":
            return self.path_from(p[1], seeds, end).union(own).distinct()
        found = self._reach(p, seeds, end)
        return (found.union(own) if p[0] == "star" else found).distinct()

    def _reach(self, p: tuple, seeds: DataFrame, end: str) -> DataFrame:
        """(s, o): seeds and what one or more steps of ``p``'s inner path lead to. A round takes one more step from what the last one found."""
        other = "o" if end == "s" else "s"
        kept = Kept(self.spark, "reach")
        fresh = kept.keep(seeds.select(F.col("n").alias("_seed"), F.col("n").alias("_at")), "r0")
        seen, i = None, 0
        while True:
            i += 1
            step = self.path_from(p[1], fresh.select(F.col("_at").alias("n")).distinct(), end).select(F.col(end).alias("_at"), F.col(other).alias("_to")).distinct()
            grown = fresh.join(step, "_at").select("_seed", F.col("_to").alias("_at")).distinct()
            if seen is not None:
                grown = grown.join(seen, ["_seed", "_at"], "left_anti")
            fresh = kept.keep(grown, f"r{i}")
            if fresh.isEmpty():
                break
            seen = kept.keep(fresh if seen is None else seen.union(fresh), f"seen{i}")
            kept.drop(f"seen{i - 1}")
        pairs = fresh if seen is None else seen
        return pairs.select(F.col("_seed").alias(end), F.col("_at").alias(other)).select("s", "o")

    def path(self, p: tuple) -> DataFrame:
        """(s, o) of a path. Only closures are sets; the rest keeps duplicates."""
        kind = p[0]
        if kind == "iri":
            return self._default.filter(F.col("p") == p[1]).select("s", "o")
        if kind == "inv":
            return self.path(p[1]).select(F.col("o").alias("s"), F.col("s").alias("o"))
        if kind == "seq":
            a, b = self.path(p[1]).withColumnRenamed("o", "_m"), self.path(p[2]).withColumnRenamed("s", "_m")
            return a.join(b, "_m").select("s", "o")
        if kind == "alt":
            return self.path(p[1]).union(self.path(p[2]))
        if kind == "not":
            forward, back = [i for i, inv in p[1] if not inv], [i for i, inv in p[1] if inv]
            out = self._default.filter(~F.col("p").isin(forward)).select("s", "o") if forward or not back else None
            if back:
                other = self._default.filter(~F.col("p").isin(back)).select(F.col("o").alias("s"), F.col("s").alias("o"))
                out = other if out is None else out.union(other)
            return out
        if p not in self._closures:
            base = self.path(p[1]).distinct()
            pairs = base if kind == "opt" else closure(base.select(F.col("s").alias("subject"), F.col("o").alias("object")), by=()).select(F.col("subject").alias("s"), F.col("object").alias("o"))
            if kind in ("star", "opt"):
                nodes = self._default.select(F.col("s").alias("n")).union(self._default.select("o")).distinct()
                pairs = pairs.union(nodes.select(F.col("n").alias("s"), F.col("n").alias("o"))).distinct()
            self._closures[p] = pairs
        return self._closures[p]

    def graph(self, e: tuple) -> Plan:
        named = self.quads.filter("g != ''")
        if e[1][0] == "term":
            return Engine(named.filter(F.col("g") == e[1][1]), self.prefixes).group(e[2])
        # a variable: each triple carries its graph
        plans = []
        for t in e[2][1]:
            if t[0] != "triple" or t[2][0] not in ("iri", "var"):
                raise NotImplementedError("GRAPH with a variable takes plain triple patterns")
            df, names = named, {}
            if t[2][0] == "iri":
                df = df.filter(F.col("p") == t[2][1])
            for c, x in (("s", t[1]), ("p", t[2]), ("o", t[3])):
                if x[0] == "term":
                    df = df.filter(F.col(c) == x[1])
                elif x[0] == "var":
                    names[x[1]] = c
            plans.append((df.select(F.col("g").alias(e[1][1]), *[F.col(c).alias(n) for n, c in names.items()]), {e[1][1], *names}, set()))
        return reduce(self.join, plans)

    def values(self, e: tuple) -> Plan:
        schema = ", ".join(f"`{n}` string" for n in e[1])
        maybe = {n for i, n in enumerate(e[1]) if any(r[i] is None for r in e[2])}
        return F.broadcast(self.spark.createDataFrame(e[2], schema)), set(e[1]), maybe  # as many rows as the query's text has

    def union(self, arms: list[Plan]) -> Plan:
        names = set().union(*(a[1] for a in arms))
        maybe = set().union(*(a[2] for a in arms)) | {n for n in names if any(n not in a[1] for a in arms)}
        return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [a[0] for a in arms]), names, maybe

    def _joined(self, a: Plan, b: Plan, how: str, extra=None) -> DataFrame:
        """Rows of ``a`` with compatible rows of ``b``; the columns of ``b`` that both have come as ``name__r``."""
        shared = sorted(a[1] & b[1])
        right = b[0].select(*[F.col(c).alias(f"{c}__r") if c in shared else F.col(c) for c in sorted(b[1])]) if b[1] else b[0]
        on = None
        for c in shared:
            x, y = F.col(c), F.col(f"{c}__r")
            same = x == y
            if c in a[2]:
                same = same | x.isNull()
            if c in b[2]:
                same = same | y.isNull()
            on = same if on is None else on & same
        if extra is not None:
            on = extra if on is None else on & extra
        if on is None:
            return a[0].crossJoin(right) if how == "inner" else a[0].join(right, F.lit(True), how)
        return a[0].join(right, on, how)

    def join(self, a: Plan, b: Plan) -> Plan:
        shared = a[1] & b[1]
        if not shared & (a[2] | b[2]) and shared:
            return a[0].join(b[0], sorted(shared)), a[1] | b[1], a[2] | b[2]
        # a variable that may be unbound is joined apart where both sides have it, by equality, and where one has not
        loose = sorted(shared & (a[2] | b[2]))
        arms = []
        for bound in itertools.product((True, False), repeat=len(loose)):
            x, y, residue = a[0], b[0], None
            for c, both in zip(loose, bound, strict=True):
                if both:
                    x, y = x.filter(F.col(c).isNotNull()), y.filter(F.col(c).isNotNull())
                else:
                    apart = F.col(c).isNull() | F.col(f"{c}__r").isNull()
                    residue = apart if residue is None else residue & apart
            same = sorted(shared - {c for c, both in zip(loose, bound, strict=True) if not both})
            open_ = [c for c, both in zip(loose, bound, strict=True) if not both]
            right = y.select(*[F.col(c).alias(f"{c}__r") if c in open_ else F.col(c) for c in sorted(b[1])])
            df = x.join(right, same) if same else x.crossJoin(right)
            df = df if residue is None else df.filter(residue)
            arms.append(df.select(*[F.coalesce(F.col(c), F.col(f"{c}__r")).alias(c) if c in open_ else F.col(c) for c in sorted(a[1] | b[1])]))
        return reduce(DataFrame.union, arms), a[1] | b[1], (a[2] | b[2]) - (shared - (a[2] & b[2]))

    def _merged(self, df: DataFrame, a: Plan, b: Plan) -> DataFrame:
        shared = a[1] & b[1]
        return df.select(*[F.coalesce(F.col(c), F.col(f"{c}__r")).alias(c) if c in shared else F.col(c) for c in sorted(a[1] | b[1])])

    def left(self, a: Plan, g: tuple) -> Plan:
        """OPTIONAL: its filters see both sides, so they belong to the join's condition."""
        inner = ("group", [e for e in g[1] if e[0] != "filter" or self._exists(e[1])])
        b = self.group(inner)
        extra = None
        for e in g[1]:
            if e[0] == "filter" and not self._exists(e[1]):
                cond = self.truth(self.expr(e[1], None))
                extra = cond if extra is None else extra & cond
        df = self._joined(a, b, "left", extra)
        return self._merged(df, a, b), a[1] | b[1], a[2] | (b[1] - a[1])

    def minus(self, a: Plan, b: Plan) -> Plan:
        if not a[1] & b[1]:
            return a
        return self._joined(a, (b[0].select(*sorted(a[1] & b[1])).distinct(), a[1] & b[1], b[2]), "left_anti"), a[1], a[2]

    def _exists(self, e) -> bool:
        return isinstance(e, tuple) and (e[0] == "exists" or (e[0] in ("not", "and", "or") and any(self._exists(x) for x in e[1:])))

    def filter(self, plan: Plan, e: tuple) -> Plan:
        if e[0] == "and" and self._exists(e):
            return self.filter(self.filter(plan, e[1]), e[2])
        if e[0] == "exists" or e == ("not", e[1]) and e[1][0] == "exists":
            g, how = (e[1], "left_semi") if e[0] == "exists" else (e[1][1], "left_anti")
            outer = [f for f in g[1] if f[0] == "filter" and not self._exists(f[1])]
            b = self.group(("group", [f for f in g[1] if f not in outer]))
            extra = reduce(lambda x, y: x & y, [self.truth(self.expr(f[1], None)) for f in outer]) if outer else None
            return self._joined(plan, b, how, extra), plan[1], plan[2]
        if self._exists(e):
            raise NotImplementedError("EXISTS under a disjunction")
        return plan[0].filter(F.coalesce(self.truth(self.expr(e, plan[0])), F.lit(False))), plan[1], plan[2]

    # --- expressions: ("term" | "str" | "num" | "bool", column)
    def as_term(self, v: tuple[str, Column]) -> Column:
        kind, c = v
        if kind == "term":
            return c
        if kind == "bool":
            return F.concat(F.lit('"'), c.cast("string"), F.lit('"^^xsd:boolean'))
        if kind == "int":
            return F.concat(F.lit('"'), c.cast("string"), F.lit('"^^xsd:integer'))
        if kind == "num":
            whole = c == F.floor(c)
            return F.concat(F.lit('"'), F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")), F.lit('"^^xsd:decimal'))
        return F.concat(F.lit('"'), c, F.lit('"^^xsd:string'))

    def text(self, v: tuple[str, Column]) -> Column:
        return lexical(v[1]) if v[0] == "term" else v[1].cast("string")

    def number(self, v: tuple[str, Column]) -> Column:
        if v[0] in ("num", "int"):
            return v[1].cast("double")
        t = self.as_term(v)
        return F.when(datatype(t).isin(*_NUMERIC), lexical(t).try_cast("double"))

    def truth(self, v: tuple[str, Column]) -> Column:
        if v[0] == "bool":
            return v[1]
        if v[0] in ("num", "int"):
            return v[1] != 0
        if v[0] == "str":
            return v[1] != ""
        t = v[1]
        return F.when(datatype(t) == "xsd:boolean", lexical(t).isin("true", "1")).when(datatype(t).isin(*_NUMERIC), lexical(t).try_cast("double") != 0).otherwise(lexical(t) != "")

    def equal(self, a, b) -> Column:
        if a[0] == "bool" or b[0] == "bool":
            return self.truth(a) == self.truth(b)
        x, y = self.as_term(a), self.as_term(b)
        return (x == y) | F.coalesce(self.number(a) == self.number(b), F.lit(False))

    def expr(self, e: tuple, df) -> tuple[str, Column]:
        kind = e[0]
        if kind == "var":
            known = df is None or e[1] in df.columns
            return "term", F.col(f"`{e[1]}`") if known else F.lit(None).cast("string")
        if kind == "term":
            return "term", F.lit(e[1])
        if kind in ("and", "or"):
            a, b = self.truth(self.expr(e[1], df)), self.truth(self.expr(e[2], df))
            return "bool", a & b if kind == "and" else a | b
        if kind == "not":
            return "bool", ~self.truth(self.expr(e[1], df))
        if kind == "cmp":
            a, b = self.expr(e[2], df), self.expr(e[3], df)
            if e[1] in ("=", "!="):
                same = self.equal(a, b)
                return "bool", same if e[1] == "=" else ~same
            n, m, x, y = self.number(a), self.number(b), self.text(a), self.text(b)
            by = {"<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[e[1]]
            return "bool", F.when(n.isNotNull() & m.isNotNull(), by(n, m)).otherwise(by(x, y))
        if kind == "in":
            a = self.expr(e[1], df)
            return "bool", reduce(lambda x, y: x | y, [self.equal(a, self.expr(x, df)) for x in e[2]], F.lit(False))
        if kind == "num":
            a, b = self.number(self.expr(e[2], df)), self.number(self.expr(e[3], df))
            return "num", {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[1]]
        if kind == "agg":
            return self.aggregate(e, df)
        return self.call(e[1], [self.expr(a, df) for a in e[2]], df)

    def aggregate(self, e: tuple, df) -> tuple[str, Column]:
        _, name, arg, distinct, sep = e
        if name == "COUNT":
            if arg is None:
                return "int", F.count_distinct(F.struct(*df.columns)) if distinct else F.count("*")
            t = self.as_term(self.expr(arg, df))
            return "int", F.count_distinct(t) if distinct else F.count(t)
        v = self.expr(arg, df)
        if name == "GROUP_CONCAT":
            t = self.text(v)
            items = F.collect_set(t) if distinct else F.collect_list(t)
            return "str", F.array_join(F.sort_array(items), sep)
        if name in ("SUM", "AVG"):
            n = self.number(v)
            return "num", (F.sum_distinct(n) if distinct else F.sum(n)) if name == "SUM" else F.avg(n)
        t = self.as_term(v)
        if name == "SAMPLE":
            return "term", F.any_value(t, True)
        key = F.struct(lexical(t).try_cast("double").alias("n"), lexical(t).alias("l"), t.alias("t"))
        best = (F.min if name == "MIN" else F.max)(F.when(t.isNotNull(), key))
        return "term", best["t"]

    def call(self, name: str, a: list, df) -> tuple[str, Column]:
        t = [self.as_term(x) for x in a]
        s = [self.text(x) for x in a]
        if name == "BOUND":
            return "bool", t[0].isNotNull()
        if name in ("ISIRI", "ISURI"):
            return "bool", t[0].startswith("<")
        if name == "ISBLANK":
            return "bool", t[0].startswith("_:")
        if name == "ISLITERAL":
            return "bool", t[0].startswith('"')
        if name == "ISNUMERIC":
            return "bool", self.number(a[0]).isNotNull()
        if name == "STR":
            return "str", s[0]
        if name == "LANG":
            return "str", F.regexp_extract(t[0], '(?s)"@([^"]*)$', 1)
        if name == "DATATYPE":
            return "term", F.when(t[0].startswith('"'), F.concat(F.lit("<"), datatype(t[0]), F.lit(">")))
        if name == "LANGMATCHES":
            return "bool", F.when(s[1] == "*", s[0] != "").otherwise((F.lower(s[0]) == F.lower(s[1])) | F.lower(s[0]).startswith(F.concat(F.lower(s[1]), F.lit("-"))))
        if name == "REGEX":
            pattern = F.concat(F.lit("(?"), s[2], F.lit(")"), s[1]) if len(s) > 2 else s[1]
            return "bool", F.rlike(s[0], pattern)
        if name == "REPLACE":
            pattern = F.concat(F.lit("(?"), s[3], F.lit(")"), s[1]) if len(s) > 3 else s[1]
            return "str", F.regexp_replace(s[0], pattern, s[2])
        if name in ("IRI", "URI"):
            return "term", F.concat(F.lit("<"), s[0], F.lit(">"))
        if name == "STRDT":
            return "term", F.concat(F.lit('"'), s[0], F.lit('"^^'), s[1])
        if name == "STRLANG":
            return "term", F.concat(F.lit('"'), s[0], F.lit('"@'), F.lower(s[1]))
        if name == "IF":
            return "term", F.when(self.truth(a[0]), t[1]).otherwise(t[2])
        if name == "COALESCE":
            return "term", F.coalesce(*t)
        if name == "SAMETERM":
            return "bool", t[0] == t[1]
        if name.startswith("CAST:"):
            return "term", F.concat(F.lit('"'), s[0], F.lit('"^^' + name[6:-1]))
        strings = {
            "CONCAT": lambda: F.concat(*s) if s else F.lit(""),
            "UCASE": lambda: F.upper(s[0]),
            "LCASE": lambda: F.lower(s[0]),
            "SUBSTR": lambda: F.substr(s[0], self.number(a[1]).cast("int"), *([self.number(a[2]).cast("int")] if len(a) > 2 else [])),
            "STRBEFORE": lambda: F.when((F.instr(s[0], s[1]) > 0), F.substr(s[0], F.lit(1), F.instr(s[0], s[1]) - 1)).otherwise(""),
            "STRAFTER": lambda: F.when((F.instr(s[0], s[1]) > 0), F.substr(s[0], F.instr(s[0], s[1]) + F.length(s[1]))).otherwise(""),
            "ENCODE_FOR_URI": lambda: F.replace(F.url_encode(s[0]), F.lit("+"), F.lit("%20")),
            "MD5": lambda: F.md5(s[0].cast("binary")),
            "SHA1": lambda: F.sha1(s[0].cast("binary")),
            "SHA256": lambda: F.sha2(s[0].cast("binary"), 256),
            "SHA512": lambda: F.sha2(s[0].cast("binary"), 512),
            "STRUUID": F.uuid,
        }
        if name in strings:
            return "str", strings[name]()
        tests = {"STRSTARTS": lambda: s[0].startswith(s[1]), "STRENDS": lambda: s[0].endswith(s[1]), "CONTAINS": lambda: s[0].contains(s[1])}
        if name in tests:
            return "bool", tests[name]()
        n = lambda i: self.number(a[i])
        when = lambda f: f(F.try_to_timestamp(s[0])).cast("double")
        numbers = {
            "STRLEN": lambda: F.length(s[0]),
            "ABS": lambda: F.abs(n(0)),
            "CEIL": lambda: F.ceil(n(0)),
            "FLOOR": lambda: F.floor(n(0)),
            "ROUND": lambda: F.round(n(0)),
            "RAND": F.rand,
            "YEAR": lambda: when(F.year),
            "MONTH": lambda: when(F.month),
            "DAY": lambda: when(F.day),
            "HOURS": lambda: when(F.hour),
            "MINUTES": lambda: when(F.minute),
            "SECONDS": lambda: when(F.second),
        }
        if name in numbers:
            return "num", numbers[name]()
        if name == "UUID":
            return "term", F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
        if name == "NOW":
            return "term", F.concat(F.lit('"'), F.current_timestamp().cast("string"), F.lit('"^^xsd:dateTime'))
        raise NotImplementedError(f"function {name}")


def sparql(spark: SparkSession, quads: DataFrame, text: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    return Engine(quads, prefixes).query(text)


__all__ = ["Engine", "literal", "quads_of", "sparql"]
