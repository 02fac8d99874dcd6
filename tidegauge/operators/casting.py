"""Declarative casts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DataType

from tidegauge.functions.casts import lenient_cast
from tidegauge.schema import CastRule


def cast_columns(df: DataFrame, rules: Iterable[CastRule], strict: bool = False) -> DataFrame:
    """Apply cast rules in order, a later rule seeing what earlier ones made.

    Rules that do not build on each other share one projection; a rule that
    reads a column made before it opens the next. The plan thus grows with the
    number of rules however long the chains are. A value that does not fit its
    type becomes NULL; with ``strict`` the session's ANSI setting decides, as
    in ``Column.cast``.
    """
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"

    def folded(name: str) -> str:
        return name if exact else name.lower()

    types = {folded(field.name): field.dataType for field in df.schema}
    made: dict[str, tuple[str, Column, DataType]] = {}

    def applied() -> DataFrame:
        types.update({name: type_ for name, (_, _, type_) in made.items()})
        return df.withColumns({name: column for name, column, _ in made.values()})

    def reads(source: str) -> set[str]:
        """The columns a source may stem from: the one of that name, else the one its path begins with."""
        return {source} if source in types or source in made else {source, *(name for name in made if source.startswith(f"{name}."))}

    for rule in rules:
        source = folded(rule.source)
        if not made.keys().isdisjoint(reads(source)):
            df = applied()
            made = {}
        column = df[f"`{rule.source}`"] if source in types else df[rule.source]
        # A field inside a struct is not in the list.
        source_type = types.get(source) or df.select(column).schema[0].dataType
        type_ = DataType.fromDDL(rule.type)
        cast = column.cast(type_) if strict else lenient_cast(column, source_type, type_)
        made[folded(rule.target)] = rule.target, cast, type_
    return applied()
