"""A subset of Cypher compiled to DataFrame plans."""

from .compile import Graph, run
from .guard import is_destructive
from .parser import parse

__all__ = ["Graph", "is_destructive", "parse", "run"]
