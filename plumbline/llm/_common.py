"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python worker unpacks at once.
SLICE_CHARS = 2_000_000
#: Rows of an Arrow batch while a table is written.
BATCH_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@functools.cache
def _own_root(application: str) -> str:
    """A temporary folder of one application on one machine."""
    return "file://" + tempfile.mkdtemp(prefix="plumbline-")


class Scratch:
    """Tables written under ``spark.checkpoint.dir`` to cut lineage.

    The folder is one that driver and executors share. Where the setting is
    absent (tests on one machine) a temporary folder is set once.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = _own_root(spark.sparkContext.applicationId)
        self.root = f"{root}/plumbline-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        """Write ``df`` once and return a reader of what was written; Python gets ``rows`` at a time."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        # Batches of few rows: long texts and sets cross to Python in little memory at a time.
        size = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(size)
        self.spark.conf.set(size, str(min(rows, int(before)) if int(before) > 0 else rows))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(size, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._plumbline_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._plumbline_path)
            with contextlib.suppress(Exception):  # a leftover only costs disk
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Let Spark notice plans that nothing holds any more: it then removes their shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch so that each part holds about ``chars`` of text; no row is cut."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n)
        if held >= chars:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def map_text(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """Apply a function of Arrow slices to a frame without moving rows.

    ``make`` runs once in each task and returns a function from a slice (the
    columns of ``df``) to a dict of output columns in the order of ``schema``.
    """
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, text):
                got = work(part)
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def texts(part: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings, null as empty."""
    return [t or "" for t in part.column(part.schema.get_field_index(name)).to_pylist()]


def fill(cache: dict, groups: list[list[str]], make: Callable[[list[str]], dict], limit: int) -> None:
    """Add to ``cache`` every word of ``groups`` that it lacks; empty it first beyond ``limit``."""
    missing = set().union(*groups).difference(cache) if groups else set()
    if missing and len(cache) + len(missing) > limit:
        cache.clear()
        missing = set().union(*groups)
    if missing:
        cache.update(make(sorted(missing)))


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the names that an operator uses."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
