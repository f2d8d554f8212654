"""Row identity and result-set fingerprints.

Rows are equal when their cells are equal by position: null equals null, an integral
number equals the same number of any numeric type, text never equals a number, binary
never equals text, booleans are 0 and 1, dates and timestamps are their text. NaN
counts as null.

A key is two 64-bit hashes of the typed cells: fixed width, computed in generated code
without building text, and cheap to group by. Unequal rows share a key with a
probability of about 2^-128.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG_BOUND = float(2**63)
KEY = ["key_a", "key_b"]
FINGERPRINT_WORDS = 4

# Kinds of cell; hashed before the value, so that equal bytes of two kinds differ.
_NULL, _INTEGRAL, _FRACTIONAL, _TEXT, _BINARY, _NESTED = range(6)


def _tag(c: Column, kind: int) -> Column:
    return F.when(c.isNull(), F.lit(_NULL)).otherwise(F.lit(kind))


def _double_parts(value: Column) -> list[Column]:
    """Kind, value as a long, value as a double: nulls are skipped by the hash."""
    usable = value.isNotNull() & ~F.isnan(value)
    integral = usable & (value == F.floor(value)) & (F.abs(value) < _LONG_BOUND)
    kind = F.when(integral, F.lit(_INTEGRAL)).when(usable, F.lit(_FRACTIONAL)).otherwise(F.lit(_NULL))
    return [kind, F.when(integral, F.floor(value)), F.when(usable & ~integral, value)]


def _decimal_parts(c: Column, data_type: T.DecimalType, float_digits: int | None) -> list[Column]:
    as_long = c.try_cast("bigint")
    # Compared in the cell's own type: a common wider type may round digits away.
    integral = F.coalesce(as_long.try_cast(data_type) == c, F.lit(False))
    kind, long_value, double_value = _double_parts(_rounded(c.cast("double"), float_digits))
    return [
        F.when(integral, F.lit(_INTEGRAL)).otherwise(kind),
        F.when(integral, as_long).otherwise(long_value),
        F.when(~integral, double_value),
    ]


def _rounded(c: Column, float_digits: int | None) -> Column:
    return c if float_digits is None else F.round(c, float_digits)


def _parts(c: Column, data_type: T.DataType, float_digits: int | None) -> list[Column]:
    """What one cell contributes to the hash."""
    if isinstance(data_type, (T.BooleanType, T.IntegralType)):
        return [_tag(c, _INTEGRAL), c.cast("bigint")]
    if isinstance(data_type, T.DecimalType):
        return _decimal_parts(c, data_type, float_digits)
    if isinstance(data_type, T.FractionalType):
        return _double_parts(_rounded(c.cast("double"), float_digits))
    if isinstance(data_type, T.BinaryType):
        return [_tag(c, _BINARY), c]
    if isinstance(data_type, T.MapType):
        return [_tag(c, _NESTED), F.to_json(F.array_sort(F.map_entries(c)))]
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return [_tag(c, _NESTED), F.to_json(c)]
    return [_tag(c, _TEXT), c.cast("string")]


@functools.lru_cache(maxsize=1000)
def _key_columns(types: tuple[T.DataType, ...], float_digits: int | None) -> tuple[Column, ...]:
    """The keys of rows with columns c0, c1, … of these types; building them takes longer than using them."""
    parts = [F.lit(len(types))]
    for i, data_type in enumerate(types):
        parts += _parts(F.col(f"c{i}"), data_type, float_digits)
    return tuple(F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(KEY))


def row_keys(df: DataFrame, float_digits: int | None = None, by: list[str] | None = None) -> DataFrame:
    """The key of every row of ``df``; equal rows have equal keys. The first columns, named ``by``, are kept beside it."""
    by = by or []
    types = tuple(f.dataType for f in df.schema.fields[len(by):])
    return df.toDF(*by, *[f"c{i}" for i in range(len(types))]).select(*by, *_key_columns(types, float_digits))


@functools.lru_cache(maxsize=1)
def _fingerprint_columns() -> tuple[Column, list[Column]]:
    words = [
        F.bit_xor(F.xxhash64(F.lit(i), *KEY)).alias(f"f{i}") for i in range(FINGERPRINT_WORDS)
    ]
    return F.count(F.lit(1)).alias("copies"), [
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("n_rows"),
        *words,
    ]


@functools.lru_cache(maxsize=1)
def _drain_columns() -> list[Column]:
    return [F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*KEY)).alias("f0")]


def set_fingerprint(keys: DataFrame, by: list[str] | None = None, least: str | None = None) -> DataFrame:
    """One row describing the *set* of keys: its size and a 256-bit xor of hashes.

    With ``by`` one row for each value of those columns; a value without rows has none. With ``least``
    also the smallest value of that column.
    Duplicates are merged before the shuffle, so a key that repeats in a third of the
    rows reaches its reducer once per map task; the second step moves one row per task.
    """
    by, (copies, sizes), also = by or [], _fingerprint_columns(), [F.min(least).alias(least)] if least else []
    return keys.groupBy(*by, *KEY).agg(copies, *also).groupBy(*by).agg(*sizes, *also)


def drained(keys: DataFrame, by: list[str] | None = None, least: str | None = None) -> DataFrame:
    """Number of rows, with every cell evaluated and nothing shuffled but one row per task."""
    return keys.groupBy(*(by or [])).agg(*_drain_columns(), *([F.min(least).alias(least)] if least else []))
