"""PostgreSQL sink: ``postgres://user:password@host:port/database#table`` through Spark's JDBC writer (its driver's jar is needed)."""

from __future__ import annotations

import re
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame


def postgres_options(target: str) -> dict[str, str]:
    """JDBC options of a target; the table must be a plain identifier, with a schema or without."""
    parts = urlsplit(target)
    if parts.scheme not in ("postgres", "postgresql") or not parts.fragment:
        raise ValueError(f"{target!r} is not postgres://connection#table")
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)?", parts.fragment):
        raise ValueError(f"{parts.fragment!r} is not a table name")
    out = {"url": f"jdbc:postgresql://{parts.hostname or 'localhost'}:{parts.port or 5432}{parts.path or '/'}", "dbtable": parts.fragment, "driver": "org.postgresql.Driver"}
    if parts.username:
        out["user"] = unquote(parts.username)
    if parts.password:
        out["password"] = unquote(parts.password)
    return out


def write_postgres(df: DataFrame, target: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(**postgres_options(target), **options).mode(mode).save()
