"""loomgraph: DataFrame-first analytics over annotated text, interaction networks and document corpora."""

__version__ = "0.1.0"
