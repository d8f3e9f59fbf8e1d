"""Compact identifiers: IRIs by the prefix whose base is longest, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "dcterms": "http://purl.org/dc/terms/",
    "dc": "http://purl.org/dc/elements/1.1/",
    "oio": "http://www.geneontology.org/formats/oboInOwl#",
    "IAO": "http://purl.obolibrary.org/obo/IAO_",
    "RO": "http://purl.obolibrary.org/obo/RO_",
    "BFO": "http://purl.obolibrary.org/obo/BFO_",
    "obo": "http://purl.obolibrary.org/obo/",
}


def shortened(iri: Column, prefixes: dict[str, str] = PREFIXES, strict: bool = True) -> Column:
    """The IRI as ``prefix:rest``; without a fitting base ``<iri>`` if ``strict``, else unchanged."""
    out = F.concat(F.lit("<"), iri, F.lit(">")) if strict else iri
    for prefix, base in sorted(prefixes.items(), key=lambda kv: (len(kv[1]), kv[0])):
        out = F.when(iri.startswith(base), F.concat(F.lit(f"{prefix}:"), F.substr(iri, F.lit(len(base) + 1)))).otherwise(out)
    return out


def expanded(curie: Column, prefixes: dict[str, str] = PREFIXES) -> Column:
    """The IRI of a CURIE; of ``<iri>`` the IRI; anything else unchanged."""
    base = F.element_at(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv]), F.substring_index(curie, ":", 1))
    local = F.substr(curie, F.instr(curie, ":") + 1)
    return F.when(curie.rlike("^<.*>$"), F.substr(curie, F.lit(2), F.length(curie) - 2)).when(base.isNotNull() & (F.instr(curie, ":") > 0), F.concat(base, local)).otherwise(curie)
