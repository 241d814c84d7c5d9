"""All registered queries of the analytics operators, and the DuckDB SQL with the same rows."""

from statloom.plans import further, modelling, series, statistics, vectors  # noqa: F401  registers
from statloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
