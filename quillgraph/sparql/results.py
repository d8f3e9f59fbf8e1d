"""Results of queries as documents: lines, in order, for ``df.write.text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.session import Kept
from quillgraph.sparql.compile import datatype, lexical

#: Formats by name and by the ending of a file.
FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "srj": "json", "xml": "xml", "srx": "xml"}
_XSD = "http://www.w3.org/2001/XMLSchema#"


def format_of(path: str, fmt: str | None = None) -> str:
    name = (fmt or path.rsplit(".", 1)[-1]).lower()
    if name not in FORMATS:
        raise ValueError(f"no result format {name!r}")
    return FORMATS[name]


def _full(iri: Column) -> Column:
    return F.when(iri.startswith("xsd:"), F.concat(F.lit(_XSD), F.substr(iri, F.lit(5)))).otherwise(iri)


def _language(t: Column) -> Column:
    return F.regexp_extract(t, '(?s)"@([A-Za-z0-9-]+)$', 1)


def _json(name: str, t: Column) -> Column:
    """A variable's binding, or null where it has none."""
    kind, lang = datatype(t), _language(t)
    text = F.to_json(F.struct(lexical(t).alias("value")))
    body = F.substr(text, F.lit(2), F.length(text) - 2)
    extra = F.when(lang != "", F.concat(F.lit(',"xml:lang":"'), lang, F.lit('"'))).when((kind != "") & (kind != "xsd:string") & (kind != _XSD + "string") & t.startswith('"'), F.concat(F.lit(',"datatype":"'), _full(kind), F.lit('"'))).otherwise("")
    what = F.when(t.startswith("<"), "uri").when(t.startswith("_:"), "bnode").otherwise("literal")
    return F.when(t.isNotNull(), F.concat(F.lit(f'"{name}":{{"type":"'), what, F.lit('",'), body, extra, F.lit("}")))


def _escaped(t: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _xml(name: str, t: Column) -> Column:
    kind, lang, text = datatype(t), _language(t), _escaped(lexical(t))
    literal = F.concat(F.lit("<literal"), F.when(lang != "", F.concat(F.lit(' xml:lang="'), lang, F.lit('"'))).when((kind != "") & (kind != "xsd:string") & (kind != _XSD + "string"), F.concat(F.lit(' datatype="'), _full(kind), F.lit('"'))).otherwise(""), F.lit(">"), text, F.lit("</literal>"))
    term = F.when(t.startswith("<"), F.concat(F.lit("<uri>"), text, F.lit("</uri>"))).when(t.startswith("_:"), F.concat(F.lit("<bnode>"), F.substr(t, F.lit(3)), F.lit("</bnode>"))).otherwise(literal)
    return F.when(t.isNotNull(), F.concat(F.lit(f'<binding name="{name}">'), term, F.lit("</binding>")))


def _cell(t: Column) -> Column:
    """CSV: quoted where it holds a quote, a comma or a line end."""
    text = F.coalesce(lexical(t), F.lit(""))
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def document(solutions: DataFrame, fmt: str) -> DataFrame:
    """The lines (``value``) of a result document, in order; ``solutions`` are rows of terms, in the order that they have. No row is collected."""
    fmt, names = format_of("", fmt), solutions.columns
    spark, cols = solutions.sparkSession, [F.col(f"`{n}`") for n in names]
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        head, tail = [sep.join(names if fmt == "csv" else [f"?{n}" for n in names])], []
        row = F.concat_ws(sep, *[_cell(c) if fmt == "csv" else F.coalesce(F.regexp_replace(F.regexp_replace(c, "\t", "\\\\t"), "\n", "\\\\n"), F.lit("")) for c in cols])
    elif fmt == "json":
        head, tail = ['{"head":{"vars":[' + ",".join(f'"{n}"' for n in names) + ']},"results":{"bindings":['], ["]}}"]
        row = F.concat(F.lit("{"), F.concat_ws(",", *[_json(n, c) for n, c in zip(names, cols, strict=True)]), F.lit("}"))
    else:
        head = ['<?xml version="1.0"?>', '<sparql xmlns="http://www.w3.org/2005/sparql-results#">', "<head>" + "".join(f'<variable name="{n}"/>' for n in names) + "</head>", "<results>"]
        tail = ["</results>", "</sparql>"]
        row = F.concat(F.lit("<result>"), F.concat_ws("", *[_xml(n, c) for n, c in zip(names, cols, strict=True)]), F.lit("</result>"))
    rows = Kept(spark, "results").keep(solutions.select(row.alias("value"), F.monotonically_increasing_id().alias("at")), "rows")
    if fmt == "json":
        first = rows.agg(F.min("at")).first()[0]
        rows = rows.select(F.when(F.col("at") == F.lit(first), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"), "at")
    edge = spark.createDataFrame([(v, i - len(head)) for i, v in enumerate(head)] + [(v, (1 << 62) + i) for i, v in enumerate(tail)], "value string, at long")
    return rows.unionByName(edge).orderBy("at").select("value")


def write(solutions: DataFrame, path: str, fmt: str | None = None) -> None:
    """The document's lines, in the order of the part files at ``path``."""
    document(solutions, format_of(path, fmt)).write.text(path)


def reasserted(statements: DataFrame) -> DataFrame:
    """The statements, and those that annotated axioms speak of and nobody states, as after an update that removed them."""
    from quillgraph.plans.views import COLUMNS, Views

    said = Views(statements)["owl_reified_axiom"].select(F.col("subject").alias("stanza"), *COLUMNS[1:])
    key = [F.coalesce(F.col(c), F.lit("")).alias(f"_{c}") for c in COLUMNS[1:]]
    have = statements.select(*key).distinct()
    missing = said.select(*COLUMNS, *key).join(have, [f"_{c}" for c in COLUMNS[1:]], "left_anti").select(*COLUMNS)
    return statements.select(*COLUMNS).unionByName(missing.distinct())


def lists_typed(statements: DataFrame) -> DataFrame:
    """The statements, with the type of every list cell."""
    from quillgraph.plans.views import COLUMNS

    cells = statements.filter("predicate in ('rdf:first', 'rdf:rest')").select("subject").distinct()
    cells = cells.join(statements.filter("predicate = 'rdf:type' and object = 'rdf:List'").select("subject"), "subject", "left_anti")
    null = F.lit(None).cast("string")
    return statements.select(*COLUMNS).union(cells.select("subject", "subject", F.lit("rdf:type"), F.lit("rdf:List"), null, null, null))
