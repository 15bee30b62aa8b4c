"""Registered queries of the relational operators and their SQL equivalents."""

from tessera.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
