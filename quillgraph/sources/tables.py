"""Delimited tables, mapping sets with a metadata header, OBO stanzas and OBO graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings of an absent cell.
ABSENT = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None")


def read_table(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Quoted fields, doubled quotes and line ends inside quotes; all columns strings."""
    return spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', multiLine=True)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Rows sorted on all columns."""
    df.orderBy(*df.columns).write.csv(path, sep=sep, header=True, quote='"', escape='"')


def _scalar(text: str):
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def parse_header(lines: list[str]) -> dict:
    """The YAML of a mapping set's header, of the kind that it has: keys, lists, and one level of nested keys."""
    out: dict = {}
    key = None
    for line in (x.rstrip()[1:] for x in lines):
        body = line.strip()
        if not body:
            continue
        if body.startswith("- ") and key:
            out[key] = [*out[key], _scalar(body[2:])] if isinstance(out[key], list) else [_scalar(body[2:])]
        elif line.startswith(("  ", "\t")) and key and ":" in body and not (line.startswith(" ") and not line.startswith("  ")):
            k, v = body.split(":", 1)
            out[key] = (out[key] if isinstance(out[key], dict) else {}) | {_scalar(k): _scalar(v)}
        else:
            key, v = body.split(":", 1)
            key = key.strip()
            out[key] = _scalar(v) if v.strip() else {}
    return out


def read_sssom(spark: SparkSession, path: str, sep: str = "\t") -> tuple[DataFrame, dict]:
    """A mapping set's rows, absent cells null, and its metadata; the header is what stands before the first line without ``#``."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("at"))
    first = lines.filter("value not like '#%' and trim(value) <> ''").agg(F.min("at")).first()[0]
    head = [r[0] for r in lines.filter(F.col("value").startswith("#") & (F.lit(True) if first is None else F.col("at") < first)).orderBy("at").collect()]
    rows = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"', comment="#")
    return rows.select(*[F.when(~F.col(f"`{c}`").isin(*ABSENT), F.col(f"`{c}`")).alias(c) for c in rows.columns]), parse_header(head)


def cells(column: str):
    """A multivalued cell as an array: split at pipes that no backslash escapes."""
    return F.transform(F.split(column, r"(?<!\\)\|"), lambda x: F.replace(x, F.lit("\\|"), F.lit("|")))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(``stanza``, ``id``, ``tag``, ``value``) of all tag lines; one task reads a file's stanzas, which are then rows."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n", "\n").alias("v"))
    stanza = text.select(F.explode(F.split("v", "\\n\\s*\\n+")).alias("v")).filter("trim(v) <> ''")
    kind = F.regexp_extract("v", r"^\s*\[(\w+)\]", 1)
    lines = stanza.select(F.when(kind == "", "Header").otherwise(kind).alias("stanza"), F.regexp_extract("v", r"(?m)^id:\s*(\S+)", 1).alias("id"), F.explode(F.split("v", "\\n")).alias("line"))
    lines = lines.filter(F.col("line").rlike("^[A-Za-z_-]+:"))
    value = F.trim(F.regexp_replace(F.regexp_extract("line", r"^[A-Za-z_-]+:\s*(.*)$", 1), r"(?<!\\)\s+!\s.*$", ""))
    return lines.select("stanza", "id", F.regexp_extract("line", r"^([A-Za-z_-]+):", 1).alias("tag"), value.alias("value"))


def _restriction(subject: Column, node: Column, role: Column, filler: Column) -> Column:
    """The four statements of a subclass of ``role some filler``, exploded as structs of s, p, o."""
    rows = ((subject, F.lit("rdfs:subClassOf"), node), (node, F.lit("rdf:type"), F.lit("owl:Restriction")), (node, F.lit("owl:onProperty"), role), (node, F.lit("owl:someValuesFrom"), filler))
    return F.explode(F.array(*[F.struct(s.alias("s"), p.alias("p"), o.alias("o")) for s, p, o in rows]))


def obo_statements(tags: DataFrame) -> DataFrame:
    """OBO tags as ``statements``: names, definitions, synonyms by scope, cross-references, parents, relations, obsoletion, types."""
    quoted = F.regexp_extract("value", r'^"((?:[^"\\]|\\.)*)"', 1)
    scope = F.regexp_extract("value", r'^"(?:[^"\\]|\\.)*"\s+(EXACT|BROAD|NARROW|RELATED)', 1)
    t = F.col("tag")
    predicate = (
        F.when(t == "name", "rdfs:label").when(t == "def", "IAO:0000115").when(t == "xref", "oio:hasDbXref").when(t == "is_a", "rdfs:subClassOf").when(t == "replaced_by", "IAO:0100001").when(t == "subset", "oio:inSubset")
        .when(t == "is_obsolete", "owl:deprecated").when(t == "synonym", F.concat(F.lit("oio:has"), F.initcap(F.when(scope == "", "RELATED").otherwise(scope)), F.lit("Synonym")))
    )
    is_object = t.isin("is_a", "replaced_by", "subset")
    value = F.when(t.isin("def", "synonym"), quoted).otherwise(F.col("value"))
    rows = tags.filter("id <> ''").withColumn("predicate", predicate).filter("predicate is not null")
    null = F.lit(None).cast("string")
    main = rows.select(F.col("id").alias("stanza"), F.col("id").alias("subject"), "predicate", F.when(is_object, F.col("value")).alias("object"), F.when(~is_object, value).alias("value"), F.when(~is_object, F.when(t == "is_obsolete", "xsd:boolean").otherwise("xsd:string")).alias("datatype"), null.alias("language"))
    kind = F.when(F.col("stanza") == "Term", "owl:Class").when(F.col("stanza") == "Typedef", "owl:ObjectProperty").otherwise("owl:NamedIndividual")
    types = tags.filter("tag = 'id'").select(F.col("id").alias("stanza"), F.col("id").alias("subject"), F.lit("rdf:type").alias("predicate"), kind.alias("object"), null, null, null)
    rel = F.split("value", r"\s+")
    some = tags.filter("tag = 'relationship' and id <> ''").select("id", rel[0].alias("r"), rel[1].alias("o"))
    node = F.concat(F.lit("_:"), F.substr(F.sha1(F.concat_ws("\u0001", "id", "r", "o")), F.lit(1), F.lit(16)))
    some = some.withColumn("n", node).select("id", _restriction(F.col("id"), F.col("n"), F.col("r"), F.col("o")).alias("t"))
    return main.union(types).union(some.select("id", "t.s", "t.p", "t.o", null, null, null))


def read_obograph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (``id``, ``label``, ``type``, ``definition``) and edges (``subject``, ``predicate``, ``object``) of OBO graph documents."""
    schema = "graphs array<struct<id: string, nodes: array<struct<id: string, lbl: string, type: string, meta: struct<definition: struct<val: string>, deprecated: boolean>>>, edges: array<struct<sub: string, pred: string, obj: string>>>>"
    graphs = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("graphs").alias("g"))
    nodes = graphs.select(F.explode("g.nodes").alias("n")).select("n.id", F.col("n.lbl").alias("label"), "n.type", F.col("n.meta.definition.val").alias("definition"), F.coalesce("n.meta.deprecated", F.lit(False)).alias("deprecated"))
    edges = graphs.select(F.explode("g.edges").alias("e")).select(F.col("e.sub").alias("subject"), F.when(F.col("e.pred") == "is_a", "rdfs:subClassOf").otherwise(F.col("e.pred")).alias("predicate"), F.col("e.obj").alias("object"))
    return nodes, edges


def obograph_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An OBO graph as ``statements``: types, labels, definitions, deprecation; edges between classes by ``rdfs:subClassOf`` and, for other predicates, restrictions."""
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, s: Column, p: Column, o: Column | None, v: Column | None = None, kind: str = "xsd:string") -> DataFrame:
        return df.select(s.alias("stanza"), s.alias("subject"), p.alias("predicate"), (null if o is None else o).alias("object"), (null if v is None else v).alias("value"), (null if v is None else F.lit(kind)).alias("datatype"), null.alias("language"))

    kind = F.when(F.col("type") == "CLASS", "owl:Class").when(F.col("type") == "PROPERTY", "owl:ObjectProperty").when(F.col("type") == "INDIVIDUAL", "owl:NamedIndividual")
    out = rows(nodes.filter(kind.isNotNull()), F.col("id"), F.lit("rdf:type"), kind)
    out = out.union(rows(nodes.filter("label is not null"), F.col("id"), F.lit("rdfs:label"), None, F.col("label")))
    out = out.union(rows(nodes.filter("definition is not null"), F.col("id"), F.lit("IAO:0000115"), None, F.col("definition")))
    out = out.union(rows(nodes.filter("deprecated"), F.col("id"), F.lit("owl:deprecated"), None, F.lit("true"), "xsd:boolean"))
    plain = ["rdfs:subClassOf", "rdfs:subPropertyOf", "rdf:type", "type", "subPropertyOf"]
    own = F.when(F.col("predicate") == "type", "rdf:type").when(F.col("predicate") == "subPropertyOf", "rdfs:subPropertyOf").otherwise(F.col("predicate"))
    out = out.union(rows(edges.filter(F.col("predicate").isin(plain)), F.col("subject"), own, F.col("object")))
    node = F.concat(F.lit("_:"), F.substr(F.sha1(F.concat_ws("\u0001", "subject", "predicate", "object")), F.lit(1), F.lit(16)))
    some = edges.filter(~F.col("predicate").isin(plain)).withColumn("n", node).select("subject", _restriction(F.col("subject"), F.col("n"), F.col("predicate"), F.col("object")).alias("t"))
    return out.union(some.select("subject", "t.s", "t.p", "t.o", null, null, null))


def read_context(spark: SparkSession, path: str) -> dict[str, str]:
    """The prefixes of a JSON-LD context: entries whose value is an IRI, or an object with one."""
    import json

    text = spark.read.text(path, wholetext=True).first()[0]
    out = {}
    for k, v in json.loads(text).get("@context", {}).items():
        v = v.get("@id") if isinstance(v, dict) else v
        if isinstance(v, str) and not k.startswith("@"):
            out[k] = v
    return out


def export(statements: DataFrame, columns: list[str], sep: str = "|") -> DataFrame:
    """One row for each subject: the values of each predicate in ``columns``, sorted and joined; absent ones empty."""
    rows = statements.filter(F.col("predicate").isin(*columns)).select("subject", "predicate", F.coalesce("object", "value").alias("v"))
    wide = rows.groupBy("subject").pivot("predicate", columns).agg(F.array_join(F.sort_array(F.collect_set("v")), sep))
    return wide.select(F.col("subject").alias("id"), *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns])


def template(table: DataFrame, headers: dict[str, str]) -> DataFrame:
    """Statements from a table: ``headers`` says for each column what it holds.

    ``ID`` is the subject, ``LABEL`` its label, ``TYPE`` its type, ``A p`` a string annotation, ``AI p`` an IRI annotation, ``SC %`` a superclass (``SC p some %``
    an existential one); ``SPLIT=x`` splits cells. Empty cells say nothing.
    """
    ident = next(c for c, h in headers.items() if h == "ID")
    null = F.lit(None).cast("string")
    out = None
    for c, h in headers.items():
        if h == "ID":
            continue
        h, _, split = h.partition(" SPLIT=")
        cell = F.explode(F.split(c, r"\Q" + split + r"\E")) if split else F.col(c)
        rows = table.select(F.col(ident).alias("id"), cell.alias("x")).select("id", F.trim("x").alias("x")).filter("id <> '' and x <> ''")
        kind, _, rest = h.partition(" ")
        obj, val, pred = null, null, F.lit(rest)
        if h == "LABEL":
            pred, val = F.lit("rdfs:label"), F.col("x")
        elif h == "TYPE":
            pred, obj = F.lit("rdf:type"), F.col("x")
        elif kind in ("A", "AT", "AL"):
            val = F.col("x")
        elif kind == "AI":
            obj = F.col("x")
        elif kind == "SC" and rest == "%":
            pred, obj = F.lit("rdfs:subClassOf"), F.col("x")
        elif kind == "SC" and " some " in rest:
            role, filler = rest.split(" some ", 1)
            node = F.concat(F.lit("_:"), F.substr(F.sha1(F.concat_ws("\u0001", "id", F.lit(role), "x")), F.lit(1), F.lit(16)))
            target = F.replace(F.lit(filler), F.lit("%"), F.col("x"))
            rows = rows.select(_restriction(F.col("id"), node, F.lit(role), target).alias("t")).select(F.col("t.s").alias("id"), F.col("t.p").alias("_p"), F.col("t.o").alias("x"))
            pred, obj = F.col("_p"), F.col("x")
        else:
            raise ValueError(f"unknown template {h!r}")
        part = rows.select(F.col("id").alias("stanza"), F.col("id").alias("subject"), pred.alias("predicate"), obj.alias("object"), val.alias("value"), F.when(val.isNotNull(), "xsd:string").alias("datatype"), null.alias("language"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
