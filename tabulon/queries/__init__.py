"""Runnable queries, one or more per operator, with the equal SQL where there is one."""

from tabulon.queries.registry import ORACLES, QUERIES, load_all

__all__ = ["ORACLES", "QUERIES", "load_all"]
