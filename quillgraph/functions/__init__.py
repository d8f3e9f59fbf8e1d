"""Sub-package of quillgraph."""
