"""The catalog's queries a second time, as DuckDB SQL over the given tables. Used for checking only."""

from oracles.sql import ORACLES

__all__ = ["ORACLES"]
