"""Committed tables: each write is a folder of its own, and a pointer that is put last says which one readers see."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession

_LOG = "_versions"


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the committed versions of a table, ascending."""
    fs, log = _fs(spark, f"{root}/{_LOG}")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()) if fs.exists(log) else []


def folder_of(spark: SparkSession, root: str, version: int | None = None) -> str:
    """The folder of the last committed version, or of an earlier one."""
    known = versions(spark, root)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"no committed version {'' if version is None else version} of {root}")
    fs, path = _fs(spark, f"{root}/{_LOG}/{known[-1] if version is None else version:012d}")
    stream = fs.open(path)
    try:
        return f"{root}/{bytes(stream.readAllBytes()).decode()}"
    finally:
        stream.close()


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The last committed version of a table, or an earlier one. What a writer left half-way is never seen."""
    return spark.read.parquet(folder_of(spark, root, version))


def commit_with(spark: SparkSession, root: str, write: Callable[[str], object], seen: int | None = None) -> int:
    """Let `write` fill a new folder, then point a new version at it; returns its number.

    `seen` is the version that the new one was made of (0 for none; by default the last): if another writer has committed
    meanwhile, this one fails with FileExistsError and nothing changes. The pointer is one small file that must not exist
    before, so a version is there as a whole or not at all.
    """
    number = (max(versions(spark, root), default=0) if seen is None else seen) + 1
    name = f"v{number}-{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    fs, pointer = _fs(spark, f"{root}/{_LOG}/{number:012d}")
    _, draft = _fs(spark, f"{root}/{_LOG}/.{name}")
    stream = fs.create(draft, False)
    stream.write(bytearray(name.encode()))
    stream.close()
    if fs.exists(pointer) or not fs.rename(draft, pointer):
        fs.delete(draft, False)
        raise FileExistsError(f"version {number} of {root} is there already")
    return number


def commit(df: DataFrame, root: str, seen: int | None = None) -> int:
    """Write a table as a new version; see `commit_with`."""
    return commit_with(df.sparkSession, root, df.write.parquet, seen)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the last `keep` committed versions and every folder that no version names; how many folders went.

    Not while a writer is at work: its folder is not named yet.
    """
    known = versions(spark, root)
    kept = {folder_of(spark, root, v).rpartition("/")[2] for v in known[-keep:]}
    fs, where = _fs(spark, root)
    gone = 0
    for old in known[:-keep]:
        fs.delete(_fs(spark, f"{root}/{_LOG}/{old:012d}")[1], False)
    for s in fs.listStatus(where):
        name = s.getPath().getName()
        if name != _LOG and name not in kept:
            fs.delete(s.getPath(), True)
            gone += 1
    return gone


def merge(new: DataFrame, root: str, keys: list[str], score: Column, order: Column) -> int:
    """Commit the best row of each key of the last version and new rows; new columns are added. Returns the version."""
    from ..operators.dedup import best_per_key, upsert

    spark = new.sparkSession
    known = versions(spark, root)
    rows = upsert(read_version(spark, root), new, keys, score, order) if known else best_per_key(new, keys, score, order)
    return commit(rows, root, known[-1] if known else 0)


def consolidate(frames: dict[str, DataFrame], root: str, kind: str = "record_type") -> int:
    """Commit the records of several types as one table by name, each with its type; columns that a type lacks are null."""
    from pyspark.sql import functions as F

    from .tables import by_name

    return commit(by_name([df.withColumn(kind, F.lit(k)) for k, df in frames.items()]), root)
