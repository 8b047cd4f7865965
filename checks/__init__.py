"""The library run on the given test tables, each query beside SQL written independently of it."""

from checks import graph_checks, load_checks, primitive_checks, question_checks
from checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "graph_checks", "load_checks", "primitive_checks", "question_checks"]
