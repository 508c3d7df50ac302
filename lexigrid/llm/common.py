"""What the operators share: reading tables, the shared folder, and Arrow batches in bounded steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Rows that a Python step holds at once as Python objects.
STEP = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, which a local session may lack."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexigrid-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_steps(batches: Iterator[pa.RecordBatch], step: int = STEP) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of consecutive rows whose values of a string or binary column take at most so many bytes together, or that are one row."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end


def arrow_schema(ddl: str) -> pa.Schema:
    """On the driver; executors get the result."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def by_rows(df: DataFrame, make: Callable[[], Callable], schema: str, step: int = STEP) -> DataFrame:
    """mapInArrow in steps of rows. make() runs once a task and returns f(columns as lists) -> list of columns."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in in_steps(batches, step):
            out = f(*(batch.column(i).to_pylist() for i in range(batch.num_columns)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def rounds_of(n_bytes: float, each: int, least: int = 1) -> int:
    return max(least, -(-int(n_bytes) // each))
