"""Classification of EL ontologies by a semi-naive fixpoint."""
