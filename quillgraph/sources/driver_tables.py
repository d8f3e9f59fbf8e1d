"""The driver's tables as ontology-shaped data. The SQL is of the part that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.session import Kept


Row = tuple[str, str, str | None, str | None, str | None]


def _rows(source: str, *columns: Row, where: str = "true") -> tuple[str, str, tuple[Row, ...]]:
    """(subject, predicate, object, value, datatype) of each row of ``source``."""
    return source, where, columns


_STRING, _BOOLEAN = "'xsd:string'", "'xsd:boolean'"
_ONE = "(SELECT 1 AS one)"


def _id(prefix: str, column: str) -> str:
    return f"concat('{prefix}:', CAST({column} AS VARCHAR(20)))"


SPEC = (
    [
        _rows("region", (_id("region", "r_regionkey"), "rdf:type", "'owl:Class'", None, None), (_id("region", "r_regionkey"), "rdfs:label", None, "r_name", _STRING)),
        _rows("nation", (_id("nation", "n_nationkey"), "rdf:type", "'owl:Class'", None, None), (_id("nation", "n_nationkey"), "rdfs:label", None, "n_name", _STRING), (_id("nation", "n_nationkey"), "rdfs:subClassOf", _id("region", "n_regionkey"), None, None), (_id("nation", "n_nationkey"), "skos:hasExactMatch", _id("n", "n_nationkey"), None, None)),
        _rows(
            "customer",
            (_id("customer", "c_custkey"), "rdf:type", "'owl:Class'", None, None),
            (_id("customer", "c_custkey"), "rdfs:label", None, "c_name", _STRING),
            (_id("customer", "c_custkey"), "rdfs:subClassOf", _id("nation", "c_nationkey"), None, None),
            (_id("customer", "c_custkey"), "oio:hasExactSynonym", None, "c_mktsegment", _STRING),
            (_id("customer", "c_custkey"), "oio:hasDbXref", None, _id("crm", "c_custkey"), _STRING),
            (_id("_:ax", "c_custkey"), "owl:annotatedSource", _id("customer", "c_custkey"), None, None),
            (_id("_:ax", "c_custkey"), "owl:annotatedProperty", "'rdfs:label'", None, None),
            (_id("_:ax", "c_custkey"), "owl:annotatedTarget", None, "c_name", _STRING),
            (_id("_:ax", "c_custkey"), "oio:hasDbXref", None, "c_mktsegment", _STRING),
        ),
        _rows("customer", (_id("customer", "c_custkey"), "owl:deprecated", None, "'true'", _BOOLEAN), where="c_acctbal < 0"),
        _rows("customer", (_id("customer", "c_custkey"), "rdfs:label", None, "concat(c_name, ' ')", _STRING), where="c_mktsegment = 'BUILDING'"),
        _rows(
            "supplier",
            (_id("supplier", "s_suppkey"), "rdf:type", "'owl:NamedIndividual'", None, None),
            (_id("supplier", "s_suppkey"), "rdf:type", _id("nation", "s_nationkey"), None, None),
            (_id("orcid", "s_suppkey"), "rdfs:label", None, "s_name", _STRING),
            (_id("supplier", "s_suppkey"), "rdfs:subClassOf", _id("_:r", "s_suppkey"), None, None),
            (_id("_:r", "s_suppkey"), "rdf:type", "'owl:Restriction'", None, None),
            (_id("_:r", "s_suppkey"), "owl:onProperty", "'rel:located_in'", None, None),
            (_id("_:r", "s_suppkey"), "owl:someValuesFrom", _id("nation", "s_nationkey"), None, None),
            (_id("supplier", "s_suppkey"), "dcterms:creator", None, "s_name", _STRING),
            (_id("supplier", "s_suppkey"), "oio:hasDbXref", _id("x", "s_suppkey"), None, None),
        ),
        _rows(
            "part",
            (_id("part", "p_partkey"), "rdf:type", "'owl:Class'", None, None),
            (_id("part", "p_partkey"), "rdfs:label", None, "p_name", _STRING),
            (_id("part", "p_partkey"), "IAO:0000115", None, "p_type", _STRING),
            (_id("part", "p_partkey"), "rdfs:subClassOf", "replace(concat('brand:', p_brand), ' ', '_')", None, None),
            (_id("part", "p_partkey"), "owl:equivalentClass", _id("_:e", "p_partkey"), None, None),
            (_id("_:e", "p_partkey"), "owl:intersectionOf", _id("_:l1", "p_partkey"), None, None),
            (_id("_:l1", "p_partkey"), "rdf:type", "'rdf:List'", None, None),
            (_id("_:l1", "p_partkey"), "rdf:first", "replace(concat('brand:', p_brand), ' ', '_')", None, None),
            (_id("_:l1", "p_partkey"), "rdf:rest", _id("_:l2", "p_partkey"), None, None),
            (_id("_:l2", "p_partkey"), "rdf:first", _id("size", "p_size"), None, None),
            (_id("_:l2", "p_partkey"), "rdf:rest", "'rdf:nil'", None, None),
        ),
        _rows(
            _ONE,
            ("'rel:located_in'", "rdf:type", "'owl:ObjectProperty'", None, None),
            ("'rel:located_in'", "rdf:type", "'owl:TransitiveProperty'", None, None),
            ("'rel:located_in'", "rdfs:subPropertyOf", "'rel:related_to'", None, None),
            ("'rel:located_in'", "rdfs:domain", "'owl:Thing'", None, None),
            ("'rel:located_in'", "rdfs:range", "'region:0'", None, None),
            ("'rel:located_in'", "owl:inverseOf", "'rel:location_of'", None, None),
            ("'rel:related_to'", "rdf:type", "'owl:SymmetricProperty'", None, None),
            ("'rel:related_to'", "rdf:type", "'owl:ReflexiveProperty'", None, None),
            ("'rel:before'", "rdf:type", "'owl:AsymmetricProperty'", None, None),
            ("'rel:before'", "rdf:type", "'owl:IrreflexiveProperty'", None, None),
            ("'IAO:0000115'", "rdf:type", "'owl:AnnotationProperty'", None, None),
            ("'rdfs:label'", "rdf:type", "'owl:AnnotationProperty'", None, None),
            ("'http://example.org/tables'", "rdf:type", "'owl:Ontology'", None, None),
        ),
    ]
)


_ODD = _id("odd", "n_nationkey")

#: Statements that break a rule, or that no other row of ``SPEC`` has, for the views and the quality rules.
ODD = [
    _rows(
        "nation",
        (_ODD, "rdf:type", "'owl:Class'", None, None),
        (_ODD, "rdfs:label", None, "concat('odd ', n_name)", _STRING),
        (_ODD, "rdfs:subClassOf", _id("nation", "n_nationkey"), None, None),
        (_ODD, "rdfs:subClassOf", _id("region", "n_regionkey"), None, None),
        (_ODD, "rdfs:subClassOf", _id("_:og", "n_nationkey"), None, None),
        (_id("_:og", "n_nationkey"), "rdf:type", "'owl:Restriction'", None, None),
        (_id("_:og", "n_nationkey"), "owl:onProperty", "'rel:gone'", None, None),
        (_id("_:og", "n_nationkey"), "owl:someValuesFrom", _id("nation", "n_nationkey"), None, None),
        (_ODD, "rel:gone", _id("nation", "n_nationkey"), None, None),
        (_ODD, "owl:equivalentClass", _id("nation", "n_nationkey"), None, None),
        (_ODD, "owl:equivalentClass", _id("_:on", "n_nationkey"), None, None),
        (_id("_:on", "n_nationkey"), "rdf:type", "'owl:Restriction'", None, None),
        (_id("_:on", "n_nationkey"), "owl:onProperty", "'rel:located_in'", None, None),
        (_id("_:on", "n_nationkey"), "owl:someValuesFrom", _id("region", "n_regionkey"), None, None),
        (_ODD, "owl:equivalentClass", _id("_:oi", "n_nationkey"), None, None),
        (_id("_:oi", "n_nationkey"), "owl:intersectionOf", _id("_:ol", "n_nationkey"), None, None),
        (_id("_:ol", "n_nationkey"), "rdf:first", _ODD, None, None),
        (_id("_:ol", "n_nationkey"), "rdf:rest", _id("_:om", "n_nationkey"), None, None),
        (_id("_:om", "n_nationkey"), "rdf:first", _id("region", "n_regionkey"), None, None),
        (_id("_:om", "n_nationkey"), "rdf:rest", "'rdf:nil'", None, None),
        (_ODD, "owl:equivalentClass", _id("_:oj", "n_nationkey"), None, None),
        (_id("_:oj", "n_nationkey"), "owl:intersectionOf", _id("_:om", "n_nationkey"), None, None),
        (_ODD, "owl:disjointWith", _id("region", "n_regionkey"), None, None),
        (_id("_:oc", "n_nationkey"), "owl:complementOf", _ODD, None, None),
        (_id("_:oa", "n_nationkey"), "owl:onProperty", "'rel:odd'", None, None),
        (_id("_:oa", "n_nationkey"), "owl:allValuesFrom", _ODD, None, None),
        (_id("_:ov", "n_nationkey"), "owl:onProperty", "'rel:odd'", None, None),
        (_id("_:ov", "n_nationkey"), "owl:hasValue", _id("oddi", "n_nationkey"), None, None),
        (_id("_:os", "n_nationkey"), "owl:onProperty", "'rel:odd'", None, None),
        (_id("_:os", "n_nationkey"), "owl:hasSelf", None, "'true'", _BOOLEAN),
        (_id("oddi", "n_nationkey"), "owl:sameAs", _id("oddj", "n_nationkey"), None, None),
        (_ODD, "IAO:0000115", None, "lower(n_name)", _STRING),
        (_ODD, "IAO:0000115", None, "concat('The ', n_name)", _STRING),
        (_ODD, "oio:hasExactSynonym", None, "n_name", _STRING),
        (_ODD, "oio:hasBroadSynonym", None, "n_name", _STRING),
        (_ODD, "oio:hasNarrowSynonym", None, "lower(n_name)", _STRING),
        (_ODD, "oio:hasRelatedSynonym", None, "concat(n_name, '-like')", _STRING),
        (_ODD, "skos:hasBroadMatch", _id("region", "n_regionkey"), None, None),
        (_ODD, "skos:hasNarrowMatch", _id("n", "n_nationkey"), None, None),
        (_ODD, "skos:hasRelatedMatch", _id("nation", "n_nationkey"), None, None),
        (_ODD, "oio:inSubset", "'odd:subset'", None, None),
        (_ODD, "oio:inSubset", None, "n_name", _STRING),
        (_id("_:oy", "n_nationkey"), "rdf:type", "'owl:Axiom'", None, None),
        (_id("_:oy", "n_nationkey"), "owl:annotatedSource", _ODD, None, None),
        (_id("_:oy", "n_nationkey"), "owl:annotatedProperty", "'oio:hasExactSynonym'", None, None),
        (_id("_:oy", "n_nationkey"), "owl:annotatedTarget", None, "n_name", _STRING),
        (_id("_:oy", "n_nationkey"), "oio:hasSynonymType", "'odd:type'", None, None),
        (_ODD, "oio:consider", _id("region", "n_regionkey"), None, None),
        (_ODD, "dc:creator", None, "n_name", _STRING),
        (_ODD, "dcterms:contributor", _id("orcid", "n_nationkey"), None, None),
        (_ODD, "dcterms:date", None, "'2024-1-1'", "'xsd:date'"),
        (_ODD, "dcterms:issued", None, "'2024-01-01'", "'xsd:date'"),
        (_ODD, "rdfs:seeAlso", None, "n_name", _STRING),
        (_ODD, "RO:0002161", _id("nation", "n_nationkey"), None, None),
        (_ODD, "RO:0002162", "'NCBITaxon:9606'", None, None),
        (_ODD, "IAO:0000233", None, "'issue 1'", _STRING),
        (_id("http://purl.org/obo/X", "n_nationkey"), "rdf:type", "'owl:Class'", None, None),
    ),
    _rows("nation", (_ODD, "owl:deprecated", None, "'true'", _STRING), (_ODD, "rdfs:label", None, "concat(n_name, chr(9), 'x')", _STRING), where="n_nationkey < 9"),
    _rows("nation", (_ODD, "rdfs:label", None, "concat('obsolete ', n_name)", _STRING), (_ODD, "rdfs:label", None, "concat('see https://x/', n_name)", _STRING), (_ODD, "IAO:0100001", _id("nation", "n_nationkey"), None, None), (_ODD, "IAO:0100001", _id("n", "n_nationkey"), None, None), where="n_nationkey > 16"),
    _rows("nation", (_ODD, "owl:deprecated", None, "'true'", _BOOLEAN), where="n_nationkey > 20"),
    _rows(
        _ONE,
        ("'rel:gone'", "rdf:type", "'owl:ObjectProperty'", None, None),
        ("'rel:gone'", "owl:deprecated", None, "'true'", _BOOLEAN),
        ("'rel:odd'", "rdf:type", "'owl:Property'", None, None),
        ("'rel:odd'", "rdfs:subPropertyOf", "'rel:gone'", None, None),
        ("'rdf:type'", "rdfs:label", None, "'is a'", _STRING),
        ("'http://example.org/tables'", "owl:imports", "'http://example.org/other'", None, None),
        ("'http://example.org/tables'", "pav:status", None, "'draft'", _STRING),
    ),
]
#: Two classes below one another, and two relations that lead back.
LOOP = [_rows("nation", (_ODD, "rdfs:subClassOf", _id("loop", "n_nationkey"), None, None), (_id("loop", "n_nationkey"), "rdfs:subClassOf", _ODD, None, None), where="n_nationkey < 5")]


_NULL = "CAST(NULL AS VARCHAR(200))"
_TABLES = ("region", "nation", "customer", "supplier", "part")


def _fields(row: Row) -> list[str]:
    subject, predicate, *rest = row
    return [subject, subject, f"'{predicate}'", *[x or _NULL for x in rest], _NULL]


_NAMES = ("stanza", "subject", "predicate", "object", "value", "datatype", "language")

def _sql(spec: list) -> str:
    """For DuckDB: one arm for each kind of row."""
    return " UNION ALL ".join("SELECT " + ", ".join(f"{x} AS {n}" for x, n in zip(_fields(row), _NAMES, strict=True)) + f" FROM {source} WHERE {where}" for source, where, rows in spec for row in rows)


_SPECS = {"": SPEC, "odd": SPEC + ODD, "loop": SPEC + ODD + LOOP}
STATEMENTS, ODD_STATEMENTS, LOOP_STATEMENTS = (_sql(x) for x in _SPECS.values())

_loaded: dict[tuple, DataFrame] = {}


def _stamp(spark: SparkSession, tables: dict[str, DataFrame]) -> tuple:
    """What changes when a file does: its place, length and time."""
    path, conf, out = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration(), []
    for df in tables.values():
        for name in df.inputFiles():
            at = path(name)
            status = at.getFileSystem(conf).getFileStatus(at)
            out.append((name, status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))


def statements(spark: SparkSession, sf_dir: str, more: str = "") -> DataFrame:
    """region, nation, customer, supplier and part as ``statements``: one scan of each, kept as a table for as long as the session and the files stay the same.

    ``more``: ``odd`` adds statements that break rules, ``loop`` cycles as well.
    """
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES}
    key = (spark.sparkContext.applicationId, sf_dir, more, _stamp(spark, tables))
    if key not in _loaded:
        out = None
        for source, where, rows in _SPECS[more]:
            base = tables[source] if source in tables else spark.range(1)
            structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {x}" for n, x in zip(_NAMES, _fields(row), strict=True)) + ")" for row in rows)
            part = base.filter(where).selectExpr(f"inline(array({structs}))")
            part = part.selectExpr(*[f"CAST({n} AS STRING) AS {n}" for n in _NAMES])
            out = part if out is None else out.unionByName(part)
        _loaded[key] = Kept(spark, "statements").keep(out, "all")
    return _loaded[key]
