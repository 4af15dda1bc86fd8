"""Hierarchical columns: structs to flat names and back, and names of columns as strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_hierarchical(df: DataFrame) -> bool:
    return any(isinstance(f.dataType, T.StructType) for f in df.schema.fields)


def flatten(df: DataFrame, separator: str = "__") -> DataFrame:
    """Struct columns replaced by their fields, at any depth."""
    while is_hierarchical(df):
        columns = []
        for f in df.schema.fields:
            if isinstance(f.dataType, T.StructType):
                columns += [F.col(f"`{f.name}`").getField(g.name).alias(f"{f.name}{separator}{g.name}") for g in f.dataType.fields]
            else:
                columns.append(F.col(f"`{f.name}`"))
        df = df.select(*columns)
    return df


def nest(df: DataFrame, separator: str = "__") -> DataFrame:
    """Columns named level__name gathered in a struct for each level, in order of first appearance."""
    groups: dict[str, list[str]] = {}
    for name in df.columns:
        groups.setdefault(name.split(separator, 1)[0] if separator in name else name, []).append(name)
    columns = []
    for top, names in groups.items():
        if names == [top]:
            columns.append(F.col(f"`{top}`"))
        else:
            columns.append(F.struct(*(F.col(f"`{n}`").alias(n.split(separator, 1)[1] if separator in n else "") for n in names)).alias(top))
    return df.select(*columns)


def check_names(names) -> None:
    """Names of hierarchical columns must be strings."""
    for name in names:
        for part in name if isinstance(name, tuple) else (name,):
            if not isinstance(part, str):
                raise TypeError(f"column label {part!r} is not a string")


def conform_names(names, separator: str = "__") -> list[str]:
    """Flat string names of hierarchical labels of any type; empty parts are left out."""
    return [separator.join(str(p) for p in n if str(p)) if isinstance(n, tuple) else str(n) for n in names]
