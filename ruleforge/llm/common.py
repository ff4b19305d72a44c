"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from typing import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ruleforge.session import scratch_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SLICE_BYTES = 256_000  # bytes of text that a Python task works on at once, one text at least


def col(name: str) -> Column:
    """Column by its plain name: dots and spaces are part of the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A column name for a helper that the table doesn't use itself."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back.

    Cuts the lineage with files that every executor sees, so that neither a
    later action nor a lost executor computes the input again. Shuffle files
    of the write are deleted as it ends, since nothing reads them after it.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, f"llm-{name}")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    written = spark.read.parquet(path)
    written._ruleforge_path = path
    return written


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable cut of the lineage: a written table in the shared folder, compressed and of known size (never a local one)."""
    return stage(df, "cut")


def release(*frames: DataFrame | None) -> None:
    """Delete tables that ``stage`` wrote and that nothing reads any more, since what was made of them is written itself."""
    for df in frames:
        path = getattr(df, "_ruleforge_path", None)
        if path is not None:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Send this package with the tasks, so that executors need no copy of it; once per session's context."""
    context = spark.sparkContext
    if getattr(context, "_ruleforge_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="ruleforge-code-"), "ruleforge_tasks.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("ruleforge", os.path.relpath(os.path.join(folder, n), top)))
    context.addPyFile(path)  # Spark serves it from the driver to the executors
    context._ruleforge_shipped = True


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in slices of at most ``rows`` rows, and of at most ``size`` bytes of text where a slice has two or more."""
    total = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            total += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(total)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, done + size, "right"))))
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, schema: str, func: Callable[[pa.RecordBatch], dict], rows: int = 512) -> DataFrame:
    """``mapInArrow`` over slices of at most ``rows`` rows and ``SLICE_BYTES`` bytes of text.

    ``func`` gets a record batch and returns a dict of lists, arrays or Arrow
    arrays by output column, in the order of ``schema``. Slicing only bounds a
    task's memory; all rows are passed.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows):
                out = func(part)
                arrays = [v if isinstance(v := out[f.name], (pa.Array, pa.ChunkedArray)) and v.type == f.type
                          else pa.array(v, type=f.type) for f in target]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, name: str = "_text") -> list[str]:
    """The batch's texts; null becomes the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def id_type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def spans_text(spans: Iterable[tuple[str, int, int]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind in the given order, comma-joined."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], rank[x[0]], x[2])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
