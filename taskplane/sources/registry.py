"""Which reader or writer a target gets: by scheme, else by the extension of a file, else the one for any file."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: Schemes whose targets are files that Spark's readers open by themselves (fixed values).
STORES = ("s3", "s3a", "gs", "az", "azure", "abfss", "hdfs", "viewfs")
_HADOOP = {"s3": "s3a", "az": "abfss", "azure": "abfss"}


@dataclass(frozen=True)
class Target:
    """scheme ``file`` where none is given; ``path`` is what follows it; ``raw`` is the whole."""

    scheme: str
    path: str
    raw: str

    @staticmethod
    def parse(raw: str) -> Target:
        if not raw:
            raise ValueError("an empty target")
        scheme, found, path = raw.partition("://")
        return Target(scheme.lower(), path, raw) if found else Target("file", raw, raw)

    @property
    def extension(self) -> str:
        return PurePosixPath(self.path).suffix[1:].lower()

    @property
    def location(self) -> str:
        """What Spark's readers take."""
        return f"{_HADOOP.get(self.scheme, self.scheme)}://{self.path}" if "://" in self.raw else self.path


class Registry:
    """Functions by scheme and by extension; the last registration of a name wins."""

    def __init__(self) -> None:
        self.by_scheme: dict[str, Callable] = {}
        self.by_extension: dict[str, Callable] = {}

    def register_scheme(self, scheme: str, f: Callable) -> Registry:
        self.by_scheme[scheme.lower()] = f
        return self

    def register_ext(self, extension: str, f: Callable) -> Registry:
        self.by_extension[extension.lower().lstrip(".")] = f
        return self

    def resolve(self, target: Target) -> Callable:
        if target.scheme != "file" and target.scheme in self.by_scheme:
            return self.by_scheme[target.scheme]
        if target.scheme == "file" or target.scheme in STORES:
            if target.extension in self.by_extension:
                return self.by_extension[target.extension]
            if "file" in self.by_scheme:
                return self.by_scheme["file"]
        raise ValueError(f"nothing is registered for {target.raw!r} (schemes: {sorted(self.by_scheme)}, extensions: {sorted(self.by_extension)})")


def for_path(path: str) -> str:
    """The format of a path by its extension, in this case only: parquet, arrow, csv or jsonl."""
    kinds = {"parquet": "parquet", "arrow": "arrow", "ipc": "arrow", "csv": "csv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "jsonl"}
    extension = PurePosixPath(path).suffix[1:]
    if extension not in kinds:
        raise ValueError(f"no format for {path!r}")
    return kinds[extension]


def record_sources() -> Registry:
    from . import ipc, records

    out = Registry()
    for extension, f in (("parquet", records.read_parquet), ("arrow", ipc.read_ipc), ("ipc", ipc.read_ipc), ("csv", records.read_csv), ("json", records.read_jsonl), ("jsonl", records.read_jsonl), ("ndjson", records.read_jsonl)):
        out.register_ext(extension, f)
    return out


def record_sinks() -> Registry:
    from . import ipc, jdbc, records

    out = Registry()
    for extension, f in (("parquet", records.write_parquet), ("arrow", ipc.write_ipc), ("ipc", ipc.write_ipc), ("csv", records.write_csv), ("json", records.write_jsonl), ("jsonl", records.write_jsonl), ("ndjson", records.write_jsonl)):
        out.register_ext(extension, f)
    for scheme in ("postgres", "postgresql"):
        out.register_scheme(scheme, jdbc.write_postgres)
    return out


def blob_sources() -> Registry:
    from . import blobs, http

    out = Registry().register_scheme("file", blobs.read_blobs)
    for scheme in STORES:
        out.register_scheme(scheme, blobs.read_blobs)
    for scheme in ("http", "https"):
        out.register_scheme(scheme, lambda spark, target, **o: http.fetch(spark.createDataFrame([(target,)], "url string"), **o))
    return out


def read(spark: SparkSession, target: str, registry: Registry | None = None, **options) -> DataFrame:
    t = Target.parse(target)
    return (registry or record_sources()).resolve(t)(spark, t.location, **options)


def write(df: DataFrame, target: str, registry: Registry | None = None, **options) -> None:
    t = Target.parse(target)
    (registry or record_sinks()).resolve(t)(df, t.raw if t.scheme.startswith("postgres") else t.location, **options)
