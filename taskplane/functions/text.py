"""Text made of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _value(name: str, kind: T.DataType) -> Column:
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit("null"))
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit("null"))
    return F.coalesce(c.cast("string"), F.lit("null"))


def render_task(df: DataFrame, columns: list[str] | None = None) -> Column:
    """``key: value`` lines of a row: strings bare, everything else as compact JSON, null as null."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    return F.concat_ws("\n", *[F.concat(F.lit(f"{f.name}: "), _value(f.name, f.dataType)) for f in fields])
