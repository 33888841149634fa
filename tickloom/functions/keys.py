"""Joins in which null keys meet null keys, as groups do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left joined with the other columns of right (none of them in left but the keys); no keys: right has one row at most."""
    right = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return left.join(right if keys else F.broadcast(right), same, how).drop(*[f"_key_{k}" for k in keys])
