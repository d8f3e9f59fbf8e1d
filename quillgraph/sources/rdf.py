"""RDF: N-Triples and N-Quads (lines, so splittable), RDF/XML and Turtle (one task reads a file)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.curies import PREFIXES, shortened

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^>]*>|_:\S+)?\s*\.\s*(?:#.*)?$'
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
XSD = "http://www.w3.org/2001/XMLSchema#"
QUADS = "g string, s string, p string, o string"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """``quads(g, s, p, o)`` of N-Triples or N-Quads; terms as written, plain literals typed as strings. Other lines are an error when read."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not trim(value) like '#%'")
    part = lambda i: F.regexp_extract("value", _LINE, i)
    bad = F.raise_error(F.concat(F.lit("not a triple: "), F.col("value")))
    o = F.when(part(3).rlike('"$'), F.concat(part(3), F.lit(f"^^<{XSD}string>"))).otherwise(part(3))
    o = F.regexp_replace(o, r'"\^\^<([^>]*)>$', '"^^$1')
    return lines.select(part(4).alias("g"), F.when(part(1) == "", bad.cast("string")).otherwise(part(1)).alias("s"), part(2).alias("p"), o.alias("o"))


def write_ntriples(quads: DataFrame, path: str) -> None:
    """Sorted, distinct lines; a named graph is written as a fourth term."""
    o = F.regexp_replace("o", r'"\^\^([^"<>]+)$', '"^^<$1>')
    g = F.when(F.coalesce("g", F.lit("")) == "", "").otherwise(F.concat(F.lit(" "), F.col("g"))) if "g" in quads.columns else F.lit("")
    quads.select(F.concat("s", F.lit(" "), "p", F.lit(" "), o, g, F.lit(" .")).alias("value")).distinct().sort("value").write.text(path)


def statements_of(quads: DataFrame, prefixes: dict[str, str] = PREFIXES) -> DataFrame:
    """``statements`` with CURIEs by longest prefix."""

    def short(c: Column) -> Column:
        return F.when(c.startswith("<"), shortened(F.substr(c, F.lit(2), F.length(c) - 2), prefixes)).otherwise(c)

    o = F.col("o")
    lit = o.startswith('"')
    kind = F.regexp_extract(o, r'"\^\^([^"]*)$', 1)
    return quads.select(
        short(F.col("s")).alias("stanza"),
        short(F.col("s")).alias("subject"),
        short(F.col("p")).alias("predicate"),
        F.when(~lit, short(o)).alias("object"),
        F.when(lit, F.regexp_extract(o, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^[^"]*)?$', 1)).alias("value"),
        F.when(lit & (kind != ""), shortened(kind, prefixes)).alias("datatype"),
        F.nullif(F.regexp_extract(o, r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("language"),
    )


def _per_file(spark: SparkSession, path: str, parse, schema: str, columns: list[str]) -> DataFrame:
    """Each file's rows. Blank nodes belong to their file: their labels begin with a hash of its path."""
    files = spark.read.text(path, wholetext=True).select("value", F.substr(F.sha1(F.col("_metadata.file_path")), F.lit(1), F.lit(12)).alias("scope"), F.col("_metadata.file_path").alias("at"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([r for text, scope, at in zip(part["value"], part["scope"], part["at"], strict=True) for r in parse(text, f"f{scope}", at)], columns=columns)

    return files.mapInPandas(run, schema)


def resolved(base: str, x: str) -> str:
    """An IRI reference against a base, by the rules of generic URI syntax."""
    if re.match(r"^[A-Za-z][\w+.-]*:", x):
        return x
    m = re.match(r"^([A-Za-z][\w+.-]*:)(//[^/?#]*)?([^?#]*)(\?[^#]*)?", base)
    if not m:
        return base + x
    scheme, host, at, query = m[1], m[2] or "", m[3], m[4] or ""
    if x.startswith("//"):
        return scheme + x
    if not x or x[0] == "#":
        return scheme + host + at + query + x
    if x[0] == "?":
        return scheme + host + at + x
    tail = re.match(r"^([^?#]*)(.*)$", x, re.S)
    if tail[1].startswith("/"):
        whole = tail[1]
    elif host and not at:
        whole = "/" + tail[1]
    else:
        whole = at[: at.rfind("/") + 1] + tail[1]
    out: list[str] = []
    steps = whole.split("/")
    for k, step in enumerate(steps):
        if step in (".", ".."):
            if step == ".." and len(out) > 1:
                out.pop()
            if k == len(steps) - 1:
                out.append("")
        else:
            out.append(step)
    return scheme + host + "/".join(out) + tail[2]


def parse_rdfxml(text: str, scope: str = "", at: str = "") -> list[tuple[str, str, str, str]]:
    """Quads of a document. ``scope`` begins the labels of its blank nodes, ``at`` is the base where the document has none."""
    out: list[tuple[str, str, str, str]] = []
    count = 0

    def fresh() -> str:
        nonlocal count
        count += 1
        return f"_:{scope}genid{count}"

    def name(tag: str) -> str:
        return tag[1:].replace("}", "") if tag.startswith("{") else tag

    def literal(x: str, lang: str | None, kind: str | None) -> str:
        return f'"{x}"^^{kind}' if kind else f'"{x}"@{lang}' if lang else f'"{x}"^^{XSD}string'

    def node(e: ET.Element, base: str, lang: str | None) -> str:
        base, lang = e.get(XML + "base", base), e.get(XML + "lang", lang)
        a = lambda k: e.get(f"{{{RDF}}}{k}")
        s = f"<{resolved(base, a('about'))}>" if a("about") is not None else f"<{resolved(base, '#' + a('ID'))}>" if a("ID") else f"_:{scope}{a('nodeID')}" if a("nodeID") else fresh()
        if name(e.tag) != RDF + "Description":
            out.append(("", s, f"<{RDF}type>", f"<{name(e.tag)}>"))
        for k, v in e.attrib.items():
            if not k.startswith((f"{{{RDF}}}", XML)):
                out.append(("", s, f"<{name(k)}>", literal(v, lang, None)))
        for p in e:
            prop(s, p, base, lang)
        return s

    def prop(s: str, p: ET.Element, base: str, lang: str | None) -> None:
        lang = p.get(XML + "lang", lang)
        a = lambda k: p.get(f"{{{RDF}}}{k}")
        pred = f"<{name(p.tag)}>"
        if a("resource") is not None:
            o = f"<{resolved(base, a('resource'))}>"
        elif a("nodeID"):
            o = f"_:{scope}{a('nodeID')}"
        elif a("parseType") == "Collection":
            cells = [node(k, base, lang) for k in p]
            o = f"<{RDF}nil>"
            for c in reversed(cells):
                cell = fresh()
                out.extend([("", cell, f"<{RDF}first>", c), ("", cell, f"<{RDF}rest>", o)])
                o = cell
        elif a("parseType") == "Resource":
            o = fresh()
            for k in p:
                prop(o, k, base, lang)
        elif a("parseType") == "Literal":
            o = literal("".join(ET.tostring(k, encoding="unicode") for k in p) or (p.text or ""), None, RDF + "XMLLiteral")
        elif len(p):
            o = node(p[0], base, lang)
        else:
            o = literal(p.text or "", lang, a("datatype"))
        out.append(("", s, pred, o))

    root = ET.fromstring(text)
    base = root.get(XML + "base", at)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e, base, root.get(XML + "lang"))
    return out


def read_rdfxml(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_rdfxml, QUADS, ["g", "s", "p", "o"])


_TURTLE = re.compile(
    r'''"""(?:[^"\\]|\\.|"(?!""))*"""|'''
    r"""'''(?:[^'\\]|\\.|'(?!''))*'''|"""
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|"""
    r"""(?P<directive>(?:@prefix|\bprefix)\s+(?P<name>[\w.-]*):\s*<(?P<iri>[^>]*)>\s*\.?|(?:@base|\bbase)\s*<(?P<base>[^>]*)>\s*\.?)|"""
    r"""<(?P<ref>[^<>"{}|^`\\\x00-\x20]*)>|(?P<comment>\#[^\n]*)""",
    re.S | re.I,
)


def parse_turtle(text: str, scope: str = "", at: str = "") -> list[tuple[str, str, str, str]]:
    """Turtle, by the SPARQL reader, whose triple blocks share its grammar. Bases and prefixes hold from where they stand; ``scope`` and ``at`` as for RDF/XML."""
    from quillgraph.sparql.parser import Parser

    prefixes: dict[str, str] = {}
    base = at

    def read(m: re.Match) -> str:
        nonlocal base
        if m["directive"]:
            if m["base"] is not None:
                base = resolved(base, m["base"])
            else:
                prefixes[m["name"]] = resolved(base, m["iri"])
            return " "
        if m["comment"]:
            return " "
        return m[0] if m["ref"] is None else f"<{resolved(base, m['ref'])}>"

    p = Parser("{" + _TURTLE.sub(read, text) + "}", prefixes)
    term = lambda t: t[1] if t[0] in ("term", "iri") else f"_:{scope}{t[1]}"
    typed = lambda o: re.sub(r'"\^\^xsd:(\w+)$', lambda m: f'"^^{XSD}{m[1]}', o)
    return [("", term(s), term(q).replace("<rdf:", f"<{RDF}") if "rdf" not in prefixes else term(q), typed(term(o))) for _, s, q, o in p.group()[1]]


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    return _per_file(spark, path, parse_turtle, QUADS, ["g", "s", "p", "o"])
