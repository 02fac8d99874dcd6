"""Casts that give NULL where a value does not fit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spark trims blanks and control characters around text before a cast.
_EDGE = r"[\x00-\x20\x7F]*"
WHOLE_NUMBER = rf"\A{_EDGE}[+-]?[0-9]+{_EDGE}\z"
WITH_FRACTION = rf"\A{_EDGE}([+-]?[0-9]*)\.[0-9]*{_EDGE}\z"
# The texts Spark casts to a boolean, in any letter case.
TRUTH = rf"(?i)\A{_EDGE}(?:true|t|yes|y|1|false|f|no|n|0){_EDGE}\z"


def lenient_cast(column: Column, source: T.DataType, target: T.DataType) -> Column:
    """``column`` cast from ``source`` to ``target``; NULL for what cannot be cast.

    Text becomes a whole number as in a session without ANSI mode: a fraction
    after the digits is dropped, and without digits before the point it is 0.
    So does text inside arrays, structs and the values of maps. Dates have no
    number or truth value; a time stamp is true unless it is the epoch itself.
    For whole numbers and booleans, malformed text is told apart by a pattern
    first. ``try_cast`` alone would raise and catch an exception for each such
    row, at twenty times the cost.
    """
    if isinstance(source, T.StringType):
        return _from_text(column, source, target)
    if isinstance(source, T.ArrayType) and isinstance(target, T.ArrayType):
        return F.transform(column, lambda x: lenient_cast(x, source.elementType, target.elementType))
    if isinstance(source, T.MapType) and isinstance(target, T.MapType):
        values = F.transform_values(column, lambda _, v: lenient_cast(v, source.valueType, target.valueType))
        if source.keyType == target.keyType:
            return values
        # A key that cannot be cast would be NULL, which no map may hold: the key's own cast decides.
        return values.try_cast(T.MapType(target.keyType, target.valueType))
    if isinstance(source, T.StructType) and isinstance(target, T.StructType) and len(source) == len(target):
        fields = (
            lenient_cast(column.getField(own.name), own.dataType, wanted.dataType).alias(wanted.name)
            for own, wanted in zip(source, target)
        )
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(source, T.DateType) and isinstance(target, (T.NumericType, T.BooleanType)):
        return F.lit(None).cast(target)
    if isinstance(source, T.TimestampType) and isinstance(target, T.BooleanType):
        return F.unix_micros(column) != 0
    if isinstance(source, T.BooleanType) and isinstance(target, T.TimestampType):
        return F.timestamp_micros(column.cast("long"))
    return column.try_cast(target)


def _from_text(column: Column, source: T.StringType, target: T.DataType) -> Column:
    if source.collation != "UTF8_BINARY":
        column = F.collate(column, "UTF8_BINARY")
    if isinstance(target, T.IntegralType):
        digits = F.regexp_extract(column, WITH_FRACTION, 1)
        whole = F.when(digits.isin("", "+", "-"), "0").otherwise(digits)
        column = F.when(column.rlike(WHOLE_NUMBER), column).when(column.rlike(WITH_FRACTION), whole)
    elif isinstance(target, T.BooleanType):
        column = F.when(column.rlike(TRUTH), column)
    return column.try_cast(target)
