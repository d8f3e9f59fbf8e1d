"""Design patterns: a pattern and a table of fillers make axioms, a set for each row.

A pattern is a mapping: ``classes`` and ``relations`` name entities, ``vars`` and ``list_vars`` name columns of entities, ``data_vars`` columns of text.
``name``, ``def``, ``comment`` and ``annotations`` are printf texts; ``equivalentTo``, ``subClassOf``, ``disjointWith`` and ``GCI`` are printf texts in
Manchester syntax. ``substitutions`` make further values from matches of regular expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from quillgraph.sources.manchester import expression
from quillgraph.sources.ofn import SCHEMA, row

#: Text fields and the annotation properties that they state; logical fields and their axioms.
TEXTS = {"name": "rdfs:label", "def": "IAO:0000115", "comment": "rdfs:comment", "namespace": "oio:hasOBONamespace", "exact_synonym": "oio:hasExactSynonym", "narrow_synonym": "oio:hasNarrowSynonym", "broad_synonym": "oio:hasBroadSynonym", "related_synonym": "oio:hasRelatedSynonym", "xref": "oio:hasDbXref"}
LOGIC = {"equivalentTo": "EquivalentClasses", "subClassOf": "SubClassOf", "disjointWith": "DisjointClasses", "GCI": "SubClassOf"}
_CLAUSE = {"equivalentTo": "equivalentTo", "subClassOf": "subClassOf", "disjointWith": "disjointWith", "GCI": "GCI"}


def _literal(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _fields(pattern: dict) -> Iterator[tuple[str, dict]]:
    for key in LOGIC:
        if key in pattern:
            yield key, pattern[key]
    for x in pattern.get("logical_axioms", ()):
        yield _CLAUSE[x["axiom_type"]], x


def filled(pattern: dict, cells: dict[str, str | None], labels: dict[str, str]) -> list[list]:
    """The axioms that one row makes. A text or axiom with an empty filler is left out."""
    names = {**pattern.get("classes", {}), **pattern.get("relations", {}), **pattern.get("objectProperties", {}), **pattern.get("dataProperties", {})}
    many = set(pattern.get("list_vars", {})) | set(pattern.get("data_list_vars", {}))
    values = {k: [v.strip() for v in (cells.get(k) or "").split("|" if k in many else "\x00") if v.strip()] for k in {**pattern.get("vars", {}), **pattern.get("list_vars", {}), **pattern.get("data_vars", {}), **pattern.get("data_list_vars", {})}}
    for s in pattern.get("substitutions", ()):
        values[s["out"]] = [re.sub(s["match"], re.sub(r"\\(\d)", r"\\g<\1>", s["sub"]), v) for v in values.get(s["in"], [])]
    data = {*pattern.get("data_vars", {}), *pattern.get("data_list_vars", {}), *[s["out"] for s in pattern.get("substitutions", ())]}

    def text(field: dict, read) -> list[str]:
        if "multi_clause" in field:
            parts = [t for clause in field["multi_clause"]["clauses"] for t in text(clause, read)]
            return [field["multi_clause"].get("sep", " ").join(parts)] if parts else []
        args = [values.get(v, []) for v in field.get("vars", ())]
        if any(not a for a in args):
            return []
        return [field["text"] % tuple(read(v, a) for v, a in zip(field.get("vars", ()), args, strict=True))]

    logical = lambda v, a: " and ".join(f"<{x}>" if "://" in x else x for x in a)
    shown = lambda v, a: ", ".join(x if v in data else labels.get(x, x) for x in a)
    subject = cells["defined_class"]
    out: list[list] = [["Declaration", ["Class", subject]]]
    for key, field in _fields(pattern):
        for t in text(field, logical):
            if key == "GCI":
                left, right = re.split(r"\s+SubClassOf:?\s+", t, maxsplit=1)
                out.append(["SubClassOf", expression(left, names), expression(right, names)])
            else:
                out.append([LOGIC[key], subject, expression(t, names)])
    notes = [(TEXTS[k], pattern[k]) for k in TEXTS if k in pattern] + [(names.get(a["annotationProperty"], pattern.get("annotationProperties", {}).get(a["annotationProperty"], a["annotationProperty"])), a) for a in pattern.get("annotations", ())]
    for prop, field in notes:
        for f in field if isinstance(field, list) else [field]:
            if "value" in f:
                out += [["AnnotationAssertion", prop, subject, _literal(v)] for v in values.get(f["value"], [])]
            else:
                out += [["AnnotationAssertion", prop, subject, _literal(t)] for t in text(f, shown)]
    return out


def generate(table: DataFrame, pattern: dict, labels: dict[str, str] | None = None) -> DataFrame:
    """The axioms of all rows of ``table`` (``defined_class`` and a column for each variable; list cells are joined by pipes). Rows without a defined class make none."""
    known, names = labels or {}, table.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [row(a) for r in part.to_dict("records") if r["defined_class"] for a in filled(pattern, {k: v if isinstance(v, str) else None for k, v in r.items()}, known)]
            yield pd.DataFrame(rows, columns=["axiom_id", "type", "body", "signature"])

    return table.select(*[f"`{c}`" for c in names]).mapInPandas(run, SCHEMA).dropDuplicates(["axiom_id"])


def terms(pattern: dict) -> list[str]:
    """The entities that a pattern itself names."""
    return sorted({v for k in ("classes", "relations", "objectProperties", "dataProperties", "annotationProperties") for v in pattern.get(k, {}).values()})
