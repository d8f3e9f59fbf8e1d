"""SPARQL compiled to DataFrame plans."""
