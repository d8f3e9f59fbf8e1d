"""OWL functional syntax to a table of axioms.

An axiom is (``axiom_id``, ``type``, ``body``, ``signature``): ``body`` is JSON of nested lists, such as
``["SubClassOf", ":A", ["ObjectSomeValuesFrom", ":r", ":B"]]``, with set-valued operands sorted, so that equal axioms have equal ids;
annotations come last as ``["Annotations", ...]``. IRIs are as written after prefix expansion, or CURIEs where no prefix is declared.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<iri><[^>]*>)|(?P<str>"(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[^\s()"=]+))?)|(?P<paren>[()=])|(?P<name>[^\s()"<>=]+)', re.S)
#: Constructs whose operands are sets.
UNORDERED = frozenset("ObjectIntersectionOf ObjectUnionOf ObjectOneOf DataIntersectionOf DataUnionOf DataOneOf EquivalentClasses DisjointClasses EquivalentObjectProperties DisjointObjectProperties EquivalentDataProperties DisjointDataProperties SameIndividual DifferentIndividuals InverseObjectProperties".split())
KEYWORDS = re.compile(r"^[A-Z][A-Za-z]+$")
SCHEMA = "axiom_id string, type string, body string, signature array<string>"


def tokens(text: str) -> list[str]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxError(f"unexpected {text[at : at + 20]!r}")
        at = m.end()
        if m.lastgroup:
            out.append(m[0])
    return out


def _node(toks: list[str], i: int, prefixes: dict[str, str]):
    t = toks[i]
    if i + 1 < len(toks) and toks[i + 1] == "(" and KEYWORDS.match(t):
        kids, i = [], i + 2
        while toks[i] != ")":
            kid, i = _node(toks, i, prefixes)
            kids.append(kid)
        return [t, *kids], i + 1
    if t.startswith("<"):
        return t[1:-1], i + 1
    if t.startswith('"') or ":" not in t:
        return t, i + 1
    prefix, local = t.split(":", 1)
    return prefixes[prefix] + local if prefix in prefixes else t, i + 1


def canonical(x):
    """Set-valued operands sorted and distinct, below the annotations of an axiom."""
    if not isinstance(x, list):
        return x
    kids = [canonical(k) for k in x[1:]]
    if x[0] in UNORDERED:
        notes = [k for k in kids if isinstance(k, list) and k[0] == "Annotation"]
        rest = {json.dumps(k, ensure_ascii=False): k for k in kids if k not in notes}
        kids = notes + [rest[k] for k in sorted(rest)]
    return [x[0], *kids]


def signature(x) -> set[str]:
    if isinstance(x, str):
        return set() if x.startswith('"') or x.isdigit() else {x}
    if x[0] in ("Annotation", "Annotations"):
        return set()
    return set().union(*(signature(k) for k in x[1:])) if len(x) > 1 else set()


def row(axiom: list) -> tuple[str, str, str, list[str]]:
    axiom = canonical(axiom)
    notes = sorted((k for k in axiom[1:] if isinstance(k, list) and k[0] == "Annotation"), key=json.dumps)
    core = [axiom[0], *[k for k in axiom[1:] if k not in notes]]
    body = json.dumps([*core, ["Annotations", *notes]] if notes else core, ensure_ascii=False)
    return hashlib.sha256(body.encode()).hexdigest(), axiom[0], body, sorted(signature(core))


def parse(text: str, expand: bool = False) -> list[tuple[str, str, str, list[str]]]:
    """The axioms of a document. ``expand`` writes IRIs in full."""
    toks, prefixes, out, i = tokens(text), {}, [], 0
    while i < len(toks):
        if toks[i] == "Prefix":
            name, iri = toks[i + 2], toks[i + 4]
            if name.endswith(":") and expand:
                prefixes[name[:-1]] = iri[1:-1]
            i += 6
        elif toks[i] == "Ontology":
            i += 2
            while toks[i].startswith("<"):
                i += 1
            while toks[i] != ")":
                node, i = _node(toks, i, prefixes)
                if isinstance(node, list) and node[0] not in ("Annotation", "Import"):
                    out.append(row(node))
            i += 1
        else:
            raise SyntaxError(f"unexpected {toks[i]!r}")
    return out


def read_ofn(spark: SparkSession, path: str, expand: bool = False) -> DataFrame:
    """The axioms of all files at ``path``, with ``source``; one task reads a file."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(*r, s) for s, text in zip(part["source"], part["value"], strict=True) for r in parse(text, expand)]
            yield pd.DataFrame(rows, columns=["axiom_id", "type", "body", "signature", "source"])

    return files.mapInPandas(run, SCHEMA + ", source string")


def axioms(spark: SparkSession, text: str) -> DataFrame:
    """The axioms of a document given as text."""
    return spark.createDataFrame(parse(text), SCHEMA)
