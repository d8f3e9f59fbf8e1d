"""``Ontology`` and ``MappingSet``: the operators as methods; every method returns a new object over lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import axioms as ax
from quillgraph.operators import mappings, qc
from quillgraph.plans.views import Views
from quillgraph.reason import services
from quillgraph.reason.el import Classification, classify, dl_query
from quillgraph.sources import ofn, owx, rdf, tables
from quillgraph.sources.manchester import expression as manchester
from quillgraph.sparql.compile import Engine, quads_of


@dataclass(frozen=True)
class Ontology:
    """Axioms, or statements, or both; what a method does not need may be missing."""

    axioms: DataFrame | None = None
    statements: DataFrame | None = None
    prefixes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str, fmt: str | None = None) -> Ontology:
        """``fmt``: ofn, owx, nt, nq, rdfxml, ttl, obo or json (OBO graph); by the file's ending where it is not given."""
        fmt = fmt or {"ofn": "ofn", "nt": "nt", "nq": "nt", "owl": "rdfxml", "rdf": "rdfxml", "xml": "rdfxml", "ttl": "ttl", "obo": "obo", "json": "json", "owx": "owx"}.get(path.removesuffix(".gz").rsplit(".", 1)[-1], "")
        if fmt == "ofn":
            return cls(axioms=ofn.read_ofn(spark, path))
        if fmt == "owx":
            return cls(axioms=owx.read_owx(spark, path))
        if fmt == "obo":
            return cls(statements=tables.obo_statements(tables.read_obo(spark, path)))
        if fmt == "json":
            return cls(statements=tables.obograph_statements(*tables.read_obograph(spark, path)))
        readers = {"nt": rdf.read_ntriples, "nq": rdf.read_ntriples, "rdfxml": rdf.read_rdfxml, "ttl": rdf.read_turtle}
        if fmt not in readers:
            raise ValueError(f"unknown format of {path!r}")
        return cls(statements=rdf.statements_of(readers[fmt](spark, path)))

    def merge(self, *others: Ontology) -> Ontology:
        return replace(self, axioms=ax.merge(self.axioms, *[o.axioms for o in others]))

    def unmerge(self, *others: Ontology) -> Ontology:
        return replace(self, axioms=ax.unmerge(self.axioms, *[o.axioms for o in others]))

    def remove(self, objects: DataFrame, *selectors: str, trim: bool = False) -> Ontology:
        chosen = ax.select_objects(self.axioms, objects, *selectors) if selectors else objects
        return replace(self, axioms=ax.remove(self.axioms, chosen, trim))

    def filter(self, objects: DataFrame, *selectors: str, trim: bool = True) -> Ontology:
        chosen = ax.select_objects(self.axioms, objects, *selectors) if selectors else objects
        return replace(self, axioms=ax.judged(self.axioms, chosen, trim))

    def extract(self, seeds: DataFrame, method: str = "bot") -> Ontology:
        return replace(self, axioms={"bot": ax.extract_bottom, "top": ax.extract_top, "star": ax.extract_star, "mireot": ax.mireot}[method.lower()](self.axioms, seeds))

    def rename(self, names: dict[str, str], prefixes: dict[str, str] | None = None) -> Ontology:
        return replace(self, axioms=ax.rename(self.axioms, names, prefixes))

    def relax(self) -> Ontology:
        return replace(self, axioms=ax.relax(self.axioms))

    def reduce(self) -> Ontology:
        return replace(self, axioms=ax.reduce(self.axioms))

    def materialize(self) -> Ontology:
        return replace(self, axioms=ax.materialise(self.axioms))

    def repair(self, replaced_by: dict[str, str]) -> Ontology:
        return replace(self, axioms=ax.repair(self.axioms, replaced_by))

    def diff(self, other: Ontology) -> DataFrame:
        return ax.diff(self.axioms, other.axioms)

    def measure(self) -> DataFrame:
        return ax.measure(self.axioms)

    def reason(self, reasoner: str = "elk") -> Classification:
        """EL only: other profiles' reasoners are refused, never replaced."""
        if reasoner.lower() not in ("elk", "whelk", "emr", "structural"):
            raise NotImplementedError(f"no {reasoner} here: EL classification only")
        return classify(self.axioms)

    def infer(self, **options) -> Ontology:
        """With the axioms that ``services.inferred`` finds."""
        return replace(self, axioms=services.reason(self.axioms, **options))

    def explain(self, subject: str, object: str = "owl:Nothing", most: int = 1) -> list[list[str]]:
        return services.explain(self.axioms, subject, object, most)

    def profile_violations(self, profile: str = "EL") -> DataFrame:
        return services.profile_violations(self.axioms, profile)

    def dl_query(self, expression, kind: str = "descendants", names: dict[str, str] | None = None) -> DataFrame:
        """``expression``: nested lists, or Manchester syntax, in which ``names`` maps labels to entities."""
        return dl_query(self.axioms, manchester(expression, names) if isinstance(expression, str) else expression, kind)

    def views(self, entailed: DataFrame | None = None, strict: bool = True) -> Views:
        return Views(self.statements, entailed, strict)

    def query(self, text: str, inferred: bool = False) -> DataFrame:
        """``inferred`` also matches subclasses, types and relations that the axioms entail."""
        statements = self.statements
        if inferred:
            c = classify(self.axioms)
            null, parts = F.lit(None).cast("string"), [(c.subsumptions(), "subject", F.lit("rdfs:subClassOf"), "object"), (c.types(), "individual", F.lit("rdf:type"), "type"), (services.property_assertions(c), "subject", F.col("predicate"), "object")]
            for df, s, p, o in parts:
                statements = statements.union(df.select(F.col(s).alias("stanza"), F.col(s).alias("subject"), p.alias("predicate"), F.col(o).alias("object"), null, null, null))
        return Engine(quads_of(statements), self.prefixes).query(text)

    def report(self, profile: dict[str, str] | None = None) -> DataFrame:
        return qc.report(self.statements, profile)

    def verify(self, rules: dict[str, qc.Rule] | None = None) -> dict[str, bool]:
        return qc.verify(self.statements, rules or qc.CHECKS)


@dataclass(frozen=True)
class MappingSet:
    rows: DataFrame
    metadata: dict = field(default_factory=dict)

    @classmethod
    def read(cls, spark: SparkSession, path: str, sep: str = "\t") -> MappingSet:
        return cls(*tables.read_sssom(spark, path, sep))

    def __getattr__(self, name: str):
        """Every operator of ``operators.mappings`` that maps a set to a set, as a method."""
        if name in ("select", "dedupe", "remove", "invert", "cardinality", "partition", "split_key", "reconcile_prefixes", "apply_rules", "ordered", "propagate"):
            return lambda *a, **k: MappingSet(getattr(mappings, name)(self.rows, *[x.rows if isinstance(x, MappingSet) else x for x in a], **k), self.metadata)
        if name in ("clique_summary", "crosstab", "validate", "condense", "diff"):
            return lambda *a, **k: getattr(mappings, name)(self.rows, *[x.rows if isinstance(x, MappingSet) else x for x in a], **k)
        raise AttributeError(name)
