"""A read-only Cypher subset over graphs of frames: text -> tokens -> tree -> DataFrame."""

from lattice.cypher.compile import CypherError, positional, run

__all__ = ["CypherError", "positional", "run"]
