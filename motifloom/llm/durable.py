"""Cutting lineage with written tables that every executor can read, and what Python workers load and give back."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from motifloom.sources.scratch import new_path


def durable(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    The result no longer depends on shuffle files or cached blocks, so losing
    executors costs only the tasks that were running. With ``by``, each value
    of that column has a folder of its own, so that a filter by it reads no other.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    return back.select(*columns(df)) if by else back


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[str]:
    """The columns of ``df``, quoted, so that names with dots are names."""
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run, without an installation."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="motifloom-py-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for ``mapInArrow``, whose worker then returns to the system what it doesn't use any more.

    Workers stay for later tasks, and what their allocators keep meanwhile is
    lacking to the executor, also in stages that need no Python.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return run
