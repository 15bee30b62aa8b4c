"""Column-level building blocks: comparison predicates and aggregate expressions."""

from tessera.functions.aggregates import aggregate_column
from tessera.functions.predicates import all_of, any_of, check_types, compare, compare_columns

__all__ = ["aggregate_column", "all_of", "any_of", "check_types", "compare", "compare_columns"]
