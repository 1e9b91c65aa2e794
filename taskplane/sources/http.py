"""Downloads: a frame of URLs becomes rows (key, value)."""

from __future__ import annotations

import hashlib
import os
import urllib.request
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def cache_name(url: str) -> str:
    return hashlib.sha256(url.encode()).hexdigest()


def get(url: str, cache: str | None = None, timeout: float = 60) -> bytes:
    """The body of one GET; an error for any status from 400 on. A cached copy wins; it is the executor's own."""
    where = os.path.join(cache, cache_name(url)) if cache else None
    if where and os.path.exists(where):
        with open(where, "rb") as f:
            return f.read()
    with urllib.request.urlopen(url, timeout=timeout) as r:  # raises for 4xx and 5xx
        body = r.read()
    if where:
        os.makedirs(cache, exist_ok=True)
        temp = f"{where}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.write(body)
        os.replace(temp, where)
    return body


def fetch(urls: DataFrame, column: str = "url", cache: str | None = None, timeout: float = 60, partitions: int | None = None) -> DataFrame:
    """key (the URL) and value for each distinct URL; a failed download fails its task, which Spark repeats."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf[column], "value": [get(u, cache, timeout) for u in pdf[column]]})

    distinct = urls.select(column).where(f"`{column}` is not null").distinct()
    return (distinct.repartition(partitions) if partitions else distinct).mapInPandas(run, "key string, value binary")
