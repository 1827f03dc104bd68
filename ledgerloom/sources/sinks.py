"""Writing rows for people: bytes become 0x-hex, other values stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.u256 import hex0x


def shown(df: DataFrame) -> DataFrame:
    """Binary columns as 0x-hex text."""
    return df.select(*[hex0x(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """CSV with a header in each file; null is empty; quotes only where needed."""
    shown(df).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with all fields, null ones too."""
    shown(df).write.mode(mode).option("ignoreNullFields", False).json(path)
