"""What the operators share: the cluster's shared folder, tables that cut lineage, and Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import urllib.parse
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, whichever comes first: they bound a Python worker's memory but for a text that is
#: longer on its own.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20

_LOCAL_ROOT: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the context's checkpoint folder.

    Only a local master may go without; it then gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL_ROOT:
        _LOCAL_ROOT[key] = "file://" + tempfile.mkdtemp(prefix="methylake-")
    return _LOCAL_ROOT[key]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_root(spark)}/methylake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: lineage is cut and the rows survive lost executors."""
    return written_at(df, name)[0]


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As written(), with the table's path."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder of the shared folder that nothing will read again."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard_all(spark: SparkSession) -> None:
    """Deletes everything that the operators have left in the shared folder. Results are read from there lazily, so
    this is for the time after they have been written elsewhere, and no other session may use the folder."""
    discard(spark, f"{shared_root(spark)}/methylake")


def split_join(big: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """big joined with small, which has one row for each key. small's keys are passed through a function that changes
    nothing, so a shuffle stands between the join and whatever made small by key; without it the two would share a
    stage, and adaptive execution could not split the big side's partition of a key with very many rows."""
    same = {c: F.concat(F.col(c), F.lit("")) if small.schema[c].dataType.typeName() == "string" else F.bitwise_not(F.bitwise_not(F.col(c))) for c in keys}
    return big.join(small.select(*(same[c].alias(c) if c in same else c for c in small.columns)), keys)


def give_back() -> None:
    """Returns what this Python process has freed to the system, where its C library can; else it stays resident."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim is not None:
        trim(0)


def filesystem(uri: str):
    """(pyarrow file system, path in it) for a shared-folder URI, usable in Python workers."""
    from pyarrow import fs

    parts = urllib.parse.urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Writes a whole file; a name is used by one task attempt only, so no two writers meet."""
    system, path = filesystem(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    with system.open_output_stream(path) as out:
        out.write(data)


def attempt_name() -> str:
    """A file name that no other attempt of this or another task uses."""
    from pyspark import TaskContext

    return f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Bounds the Arrow batches of the session's Python stages. Spark has no such setting for one plan alone, so smaller
    values of the session stand and larger ones are lowered for good."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded rows and bytes."""
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """map_arrow with a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (id long, text string): other columns, whatever their names, never reach an operator. Ids are whole
    numbers; a text that is none is an error under ANSI casts, and null without them."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
