"""Relational operators: thin declarative functions from DataFrames to DataFrames."""

from tessera.operators.relational import (
    cell_join,
    derived,
    global_agg,
    project,
    scalar_lookup,
    sort_by,
    theta_join,
    vs_global_agg,
    where,
)

__all__ = ["cell_join", "derived", "global_agg", "project", "scalar_lookup", "sort_by", "theta_join", "vs_global_agg", "where"]
