"""What the training-data operators share: the shared folder, table reading and empty inputs."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, local mode alone (tests) gets a temporary folder, once for the application and removed at its end;
    a cluster's machines would each write to their own disk, so there it is an error.
    """
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            made = tempfile.mkdtemp(prefix="waymark-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            sc.setCheckpointDir(made)
        return sc.getCheckpointDir()
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_MADE: list[list[str]] = []  # for each open ``working_folders``, the paths made in it


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def working_folders(spark: SparkSession):
    """Folders made inside are removed at its end: what is to stay must be written elsewhere by then."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and Spark knows its size."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "row") -> DataFrame:
    """``df`` with a distinct number of each row, written so that the numbers stay."""
    return written(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df`` in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _released() -> None:
    """Give back to the system what is free: a worker waits for its next task with all that it ever held otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def map_texts(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` for rows of texts, in batches that end at ``BATCH_BYTES`` (a longer text is one whole).

    Spark's own bounds are 10,000 rows and 64 MB, which each task holds several times: in Python, and outside the heap on
    the JVM's side. The bound is a setting of the session and stays set, as the rows are read after this call.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            _released()

    return df.mapInArrow(tidy, schema)


def hashed_part(df: DataFrame, column: str, most: int, total: int) -> DataFrame:
    """About ``most`` of ``total`` rows of distinct ``column``, by its hash: no sort, no merge on the driver.

    The bound is met to a few standard deviations (the square root of ``most``).
    """
    if total <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(column, F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * most / total))


def put_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write bytes as a file in the shared folder through Hadoop's file system; return its URI."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{new_folder(spark, 'files')}/{name}")
    fs = path.getFileSystem(conf)
    out = fs.create(path, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()
    return str(fs.makeQualified(path).toString())
