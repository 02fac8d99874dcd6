"""Row identity over a list of key columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType

DIGEST_BYTES = 32


def row_key(df: DataFrame, keys: Sequence[str], digest: bool = True) -> Column:
    """The key columns as one struct: equal structs mean equal keys.

    A struct, unlike a list of columns, lets NULL parts equal each other and
    count in a distinct. With ``digest``, text and binary parts of 32 bytes or
    more are replaced by their SHA-256, which bounds what a shuffle moves per
    row however long the texts are. Shorter parts stay as they are, and no
    short part can equal a digest since their lengths differ.
    """
    if not keys:
        return F.struct(F.lit(0).alias("all_rows"))
    types = [field.dataType for field in df.select(*keys).schema]
    return F.struct(
        *(
            (_bounded(key) if digest and _digestible(type_) else F.col(key)).alias(f"k{i}")
            for i, (key, type_) in enumerate(zip(keys, types))
        )
    )


def _digestible(type_: DataType) -> bool:
    # Under another collation two texts can be equal without equal bytes.
    return isinstance(type_, BinaryType) or (isinstance(type_, StringType) and type_.collation == "UTF8_BINARY")


def _bounded(key: str) -> Column:
    raw = F.col(key).cast("binary")
    return F.when(F.octet_length(key) < DIGEST_BYTES, raw).otherwise(F.unhex(F.sha2(raw, 256)))
