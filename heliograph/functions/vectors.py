"""Vectors as arrays: normalisation, 8-bit quantisation, integer dot products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: (x / F.greatest(norm, F.lit(1e-12))).cast("float"))


def quantize_i8(v: Column) -> Column:
    """round(127 x) in single precision, half away from zero, held to -127..127."""
    return F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x * F.lit(127).cast("float")))).cast("tinyint"))


def legacy_i8(v: Column) -> Column:
    """Old stored vectors: round(127 x) without bounds; what doesn't fit a byte is null."""
    return F.transform(v, lambda x: F.round(x * F.lit(127).cast("float")).try_cast("tinyint"))


def from_bytes(raw: Column) -> Column:
    """Little-endian 32-bit floats as an array; a length that isn't a multiple of four is an error. Null stays null."""

    @F.pandas_udf("array<float>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    checked = F.when(F.octet_length(raw) % 4 == 0, raw).when(raw.isNotNull(), F.raise_error(F.lit("not a whole number of 32-bit floats")).cast("binary"))
    return run(checked)


def to_bytes(v: Column) -> Column:
    """An array of floats as little-endian 32-bit floats."""

    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(v)


def dot_i8(a: Column, b: Column) -> Column:
    """Exact integer dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
