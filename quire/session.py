"""The session's shared folder, and tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken on one machine; on a cluster its
    executors would not see each other's files, so that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("-quire"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the shared folder."""
    _checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as the session shuffles to, two for each core at least.

    A number that is given stays: adaptive execution goes by bytes and would put small rows
    that become whole files into a few tasks, which then do all the work.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def batched(rows: Iterable[tuple], schema: pa.Schema, most: int = 4096, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as batches of that many, or of fewer that together have ``size`` bytes of text and data."""
    held: list[tuple] = []
    full = 0
    for row in rows:
        held.append(row)
        full += sum(len(x) for x in row if isinstance(x, (str, bytes)))
        if len(held) >= most or full >= size:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)
            held, full = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(schema)], schema=schema)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's URI within the shared one."""
    return f"{_checkpoints(spark)}/{name}-{uuid.uuid4().hex}"


def shipped(df: DataFrame) -> DataFrame:
    """``df``, in an application whose Python workers can import this package.

    They can where it is on PYTHONPATH or in the working directory; anywhere else it is
    sent to them once, as a zip file, through Spark.
    """
    sc, here = df.sparkSession.sparkContext, os.path.dirname(os.path.abspath(__file__))
    root = os.path.realpath(os.path.dirname(here))
    known = [os.path.realpath(p) for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p]
    name = os.path.basename(here) + ".zip"
    if root not in known and name not in sc._python_includes:
        path = os.path.join(tempfile.mkdtemp("-quire"), name)
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(here):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        sc.addPyFile(path)
    return df
