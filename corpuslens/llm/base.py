"""Reading and small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a local one only where none is set (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Writes df once into the shared folder and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def anew(c: str) -> Column:
    """A 64-bit key as a value of its own.

    A table that was grouped by its key joins without another shuffle, and then a hot key of the other side can't be split.
    Under a new value both sides are shuffled for the join, and the adaptive skew join splits the hot one.
    """
    return F.col(c).bitwiseXOR(F.lit(0).cast("long"))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """fn(RecordBatch) -> dict of column -> array (or RecordBatch), applied to every batch; empty batches are skipped."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out if isinstance(out, pa.RecordBatch) else pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(run, schema)


def ragged(first: np.ndarray, values: np.ndarray, kind=None) -> pa.Array:
    """list<T> column from offsets and flat values."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values) if kind is None else pa.array(values, kind))


def frequency_sketch(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """Counts of 64-bit values folded into 2**bits counters: a table of fixed size, whatever the input.

    ``hashes(batch)`` gives the values of a batch.  Each task sends at most 2**bits counters; they are added on the
    executors and the sums, at most 2**bits numbers, come to the driver.
    """

    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            if batch.num_rows:
                total += np.bincount((hashes(batch) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    out = np.zeros(1 << bits, np.int64)
    rows = df.mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[rows["at"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def bit_filter(df: DataFrame, hashes, bits: int) -> np.ndarray:
    """A membership filter of 2**bits bits (fixed size) over 64-bit values: a superset test, never a false 'absent'."""

    def mark(batches):
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            if batch.num_rows:
                flags[(hashes(batch) >> np.uint64(64 - bits)).astype(np.int64)] = True
        packed = np.packbits(flags).view(np.int64)
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at.astype(np.int32)), "w": pa.array(packed[at])})

    rows = df.mapInArrow(mark, "at int, w long").groupBy("at").agg(F.expr("bit_or(w)").alias("w")).toPandas()
    packed = np.zeros((1 << bits) // 64, np.int64)
    packed[rows["at"].to_numpy(np.int64)] = rows["w"].to_numpy(np.int64)
    return np.unpackbits(packed.view(np.uint8)).astype(bool)
