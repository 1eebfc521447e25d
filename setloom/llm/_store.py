"""Intermediate tables of this package: those of :mod:`setloom.shared`, with earlier shuffle files let go."""

from __future__ import annotations

from pyspark.sql import DataFrame

from setloom import shared
from setloom.shared import release, shared_dir  # noqa: F401  used by the operators


def stash(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    out = shared.stash(df, name, compression)
    # the shuffle files that led here are not read again; Spark deletes them when the driver collects its garbage
    df.sparkSession._jvm.System.gc()
    return out
