"""Ontology, knowledge-graph and mapping-set analytics on PySpark DataFrames."""
