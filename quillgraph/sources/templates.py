"""Tables to axioms by a row of template strings, as editors of ontologies write them.

A column's template says what its cells make: ``ID``, ``LABEL``, ``TYPE``; ``A p``, ``AT p^^type``, ``AL p@lang``, ``AI p`` annotations; ``SC %``, ``EC %``, ``DC %`` super-, equivalent
and disjoint classes, ``%`` standing for the cell in a Manchester expression, and ``C %`` one of them by the column of ``CLASS_TYPE``; ``SP %``, ``EP %``, ``DP %``, ``IP %`` the same for properties and
their inverses; ``DOMAIN``, ``RANGE``, ``CHARACTERISTIC`` of properties; ``TI %`` types, ``SI %``, ``DI %`` same and different individuals, ``I p`` what an individual is related to; ``>A p`` and its kin
annotate the axiom of the column before. ``SPLIT=x`` splits cells. Empty cells say nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources.manchester import expression
from quillgraph.sources.ofn import SCHEMA, row

#: What the types of rows declare, the axioms of templates, and those of property characteristics.
KINDS = {"owl:Class": "Class", "class": "Class", "owl:ObjectProperty": "ObjectProperty", "object property": "ObjectProperty", "owl:DatatypeProperty": "DataProperty", "data property": "DataProperty", "owl:AnnotationProperty": "AnnotationProperty", "annotation property": "AnnotationProperty", "owl:NamedIndividual": "NamedIndividual", "named individual": "NamedIndividual", "owl:Datatype": "Datatype", "datatype": "Datatype"}
CLASSES = {"SC": "SubClassOf", "EC": "EquivalentClasses", "DC": "DisjointClasses"}
CLASS_TYPES = {"subclass": "SC", "equivalent": "EC", "disjoint": "DC"}
PROPERTIES = {"SP": "Sub{}PropertyOf", "EP": "Equivalent{}Properties", "DP": "Disjoint{}Properties", "IP": "InverseObjectProperties"}
CHARACTERISTICS = {"functional": "Functional{}Property", "inverse functional": "InverseFunctionalObjectProperty", "transitive": "TransitiveObjectProperty", "symmetric": "SymmetricObjectProperty", "asymmetric": "AsymmetricObjectProperty", "reflexive": "ReflexiveObjectProperty", "irreflexive": "IrreflexiveObjectProperty"}
#: Labels of a table's own rows that are looked up, at most.
LABELS = 100_000


def _text(x: str) -> str:
    return '"' + x.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _annotation(kind: str, rest: str, x: str, names: dict[str, str]) -> tuple[str, str]:
    """The property and the value of an annotation template."""
    if kind == "AT":
        prop, _, t = rest.partition("^^")
        return names.get(prop, prop), f"{_text(x)}^^{t}"
    if kind == "AL":
        prop, _, lang = rest.partition("@")
        return names.get(prop, prop), f"{_text(x)}@{lang}"
    return names.get(rest, rest), names.get(x, x) if kind == "AI" else _text(x)


def _split(header: str) -> tuple[str, str, str]:
    h, _, sep = header.partition("SPLIT=")
    kind, _, rest = h.strip().partition(" ")
    return kind, rest.strip(), sep


def filled(headers: dict[str, str], cells: dict[str, str | None], names: dict[str, str]) -> list[list]:
    """The axioms of one row."""
    ident = next(c for c, h in headers.items() if h == "ID")
    me = (cells.get(ident) or "").strip()
    if not me:
        return []
    of = {c: _split(h) for c, h in headers.items()}
    said = lambda c: [v.strip() for v in ((cells.get(c) or "").split(of[c][2]) if of[c][2] else [cells.get(c) or ""]) if v.strip()]
    kinds = [KINDS.get(v) for c in of if of[c][0] == "TYPE" for v in said(c)] or ["Class"]
    declared = next((k for k in kinds if k), "NamedIndividual")
    flavour = "Data" if declared == "DataProperty" else "Annotation" if declared == "AnnotationProperty" else "Object"
    class_type = next((CLASS_TYPES[v.lower()] for c in of if of[c][0] == "CLASS_TYPE" for v in said(c)), "SC")
    entity = lambda x: names.get(x, x)
    out, last = [["Declaration", [declared, me]]], []
    for c, (kind, rest, _) in of.items():
        values = said(c)
        if kind.startswith(">"):
            for v in values:
                prop, value = _annotation(kind.lstrip(">"), rest, v, names)
                for a in last:
                    a.insert(1, ["Annotation", prop, value])
            continue
        if kind in ("ID", "CLASS_TYPE", ""):
            continue
        fill = lambda v: rest.replace("%", f"'{v}'" if v in names else v)  # noqa: B023, E731
        last = []
        for v in values:
            if kind == "LABEL":
                last.append(["AnnotationAssertion", "rdfs:label", me, _text(v)])
            elif kind == "TYPE":
                if v not in KINDS:
                    last.append(["ClassAssertion", entity(v), me])
            elif kind in ("A", "AT", "AL", "AI"):
                prop, value = _annotation(kind, rest, v, names)
                last.append(["AnnotationAssertion", prop, me, value])
            elif kind in CLASSES or kind == "C":
                last.append([CLASSES[class_type if kind == "C" else kind], me, expression(fill(v), names)])
            elif kind in PROPERTIES:
                last.append([PROPERTIES[kind].format(flavour), me, entity(v)])
            elif kind in ("DOMAIN", "RANGE"):
                datatype = kind == "RANGE" and flavour == "Data"
                last.append([f"{flavour}Property{kind.capitalize()}", me, entity(v) if datatype else expression(f"'{v}'" if v in names else v, names)])
            elif kind == "CHARACTERISTIC":
                last.append([CHARACTERISTICS[v.lower()].format(flavour), me])
            elif kind == "TI":
                last.append(["ClassAssertion", expression(fill(v), names), me])
            elif kind in ("SI", "DI"):
                last.append(["SameIndividual" if kind == "SI" else "DifferentIndividuals", me, entity(v)])
            elif kind == "I":
                literal = re.match(r'^".*"(@\S+|\^\^\S+)?$', v)
                last.append(["DataPropertyAssertion" if literal else "ObjectPropertyAssertion", entity(rest), me, v if literal else entity(v)])
            else:
                raise ValueError(f"unknown template {kind!r}")
        out += last
    return out


def axioms(table: DataFrame, headers: dict[str, str], names: dict[str, str] | None = None) -> DataFrame:
    """The axioms of all rows of ``table``. ``names`` maps labels to entities; the table's own labels are known too, if they are at most ``LABELS``."""
    known = dict(names or {})
    ident, label = (next((c for c, h in headers.items() if h == x), None) for x in ("ID", "LABEL"))
    if label:
        rows = table.filter(F.col(label).isNotNull() & F.col(ident).isNotNull()).select(label, ident).distinct().limit(LABELS + 1).collect()
        if len(rows) > LABELS:
            raise ValueError(f"more than {LABELS} labels")
        known = {r[0].strip(): r[1].strip() for r in rows} | known

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [row(a) for r in part.to_dict("records") for a in filled(headers, {k: v if isinstance(v, str) else None for k, v in r.items()}, known)]
            yield pd.DataFrame(made, columns=["axiom_id", "type", "body", "signature"])

    return table.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in headers]).mapInPandas(run, SCHEMA).dropDuplicates(["axiom_id"])
