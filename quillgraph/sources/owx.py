"""OWL/XML to axioms; one task reads a file."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.ofn import SCHEMA, row
from quillgraph.sources.rdf import resolved

_OWL = "{http://www.w3.org/2002/07/owl#}"
_XML = "{http://www.w3.org/XML/1998/namespace}"
#: Elements that name an entity, and those that only wrap what an annotation is about.
_ENTITIES = frozenset("Class ObjectProperty DataProperty AnnotationProperty NamedIndividual Datatype AnonymousIndividual".split())
_NOT_AXIOMS = frozenset(["Prefix", "Import", "Annotation"])


def parse(text: str, at: str = "", expand: bool = True) -> list[tuple[str, str, str, list[str]]]:
    """The axioms of a document. Without ``expand`` CURIEs stay as they are written."""
    root = ET.fromstring(text)
    base = root.get(_XML + "base", at)
    prefixes = {e.get("name", ""): e.get("IRI", "") for e in root if e.tag == _OWL + "Prefix"}

    def name(e: ET.Element) -> str:
        if e.get("abbreviatedIRI") is not None:
            return short(e.get("abbreviatedIRI"))
        if e.get("nodeID") is not None:
            return f"_:{e.get('nodeID')}"
        return resolved(base, e.get("IRI", ""))

    def short(curie: str) -> str:
        p, local = curie.split(":", 1)
        return prefixes[p] + local if expand and p in prefixes else curie

    def node(e: ET.Element):
        tag = e.tag.removeprefix(_OWL)
        if tag in _ENTITIES:
            return name(e)
        if tag == "IRI":
            return resolved(base, (e.text or "").strip())
        if tag == "AbbreviatedIRI":
            return short((e.text or "").strip())
        if tag == "Literal":
            body = '"' + (e.text or "").replace("\\", "\\\\").replace('"', '\\"') + '"'
            lang, kind = e.get(_XML + "lang"), e.get("datatypeIRI")
            return body + (f"@{lang}" if lang else f"^^<{kind}>" if kind and not kind.endswith(("#string", "#PlainLiteral")) else "")
        kids = [node(k) for k in e]
        if "cardinality" in e.attrib:
            kids.insert(0, e.get("cardinality"))
        if tag == "Declaration":
            kids = [[e[len(e) - 1].tag.removeprefix(_OWL), kids[-1]]]
        return [tag, *kids]

    return [row(node(e)) for e in root if e.tag.startswith(_OWL) and e.tag.removeprefix(_OWL) not in _NOT_AXIOMS]


def read_owx(spark: SparkSession, path: str, expand: bool = True) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("at"), "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([r for at, text in zip(part["at"], part["value"], strict=True) for r in parse(text, at, expand)], columns=["axiom_id", "type", "body", "signature"])

    return files.mapInPandas(run, SCHEMA)
