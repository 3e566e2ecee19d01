"""Names and schemas beside the columns that documents bring along."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores before it while a column is so named in any case."""
    held = {c.lower() for c in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def with_fields(fields: Iterable[StructField], **more: DataType) -> StructType:
    """Fields as they are, of whatever names and types, and further ones."""
    return StructType([*fields, *[StructField(name, kind) for name, kind in more.items()]])


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and spaces included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


REST = "rest"


def set_aside(df: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and, as one struct, all others, whose names then can't clash."""
    rest = named(c for c in df.columns if c not in used)
    return df.select(*named(used), F.struct(*rest).alias(REST) if rest else F.lit(0).alias(REST))


def restored(df: DataFrame, columns: list[str], *used: str) -> DataFrame:
    """What was set aside, in the order it had."""
    return df.select(*[(F.col(c) if c in used else F.col(REST).getField(c)).alias(c) for c in columns])
