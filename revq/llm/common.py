"""Small helpers of the text operators: shared folder, Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import os
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from revq.session import scratch_dir, ship_package
from revq.sources.files import file_system

WORD = r"[^\x20\x09-\x0D]+"  # fixed: a word of the contracts


_MADE = threading.local()  # tables written by the operators that run in this thread, innermost last


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read again.

    Cuts the lineage: a lost executor costs no work from before the table.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark, 'llm')}-{name}-{uuid.uuid4().hex[:6]}"
    df.write.parquet(path)
    if scopes := getattr(_MADE, "scopes", None):
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator that removes its intermediate tables when its plan is made.

    What the returned DataFrame reads stays, as its action is still to come;
    an operator that calls this one removes it in turn. Tables of an outermost
    operator's result stay until the checkpoint folder is cleared.
    """

    @functools.wraps(operator)
    def run(*args, **kwargs) -> DataFrame:
        scopes = _MADE.scopes = getattr(_MADE, "scopes", [])
        scopes.append([])
        try:
            out = operator(*args, **kwargs)
        finally:
            made = scopes.pop()
        read = {name.rsplit("/", 1)[0].rsplit("/", 1)[-1] for name in out.inputFiles()}
        for path in made:
            if path.rsplit("/", 1)[-1] in read:
                if scopes:
                    scopes[-1].append(path)
            else:
                fs, p = file_system(out.sparkSession, path)
                fs.delete(p, True)
        return out

    return run


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a column that tells its rows apart and is the same in every scan.

    Rows of files are known by file and place in it. Rows that do not come
    straight from files are written once, numbered.
    """
    try:
        file = F.xxhash64("_metadata.file_path").cast("decimal(20,0)")
        return docs.withColumn(name, (file * F.lit(1 << 40) + F.col("_metadata.row_index")).cast("decimal(38,0)"))
    except AnalysisException:
        return written(docs.withColumn(name, F.monotonically_increasing_id().cast("decimal(38,0)")), "rows")


def _lean(f: Callable) -> Callable:
    """``f``, after whose last batch the Python worker keeps no memory that it does not use.

    Workers outlive their tasks; what Arrow and the C library have free of all
    batches would stay theirs while other stages run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return run


def in_tasks(df: DataFrame, f: Callable, schema: str | StructType) -> DataFrame:
    """``df`` through a function of Arrow batches whose code the executors are sent."""
    ship_package(df.sparkSession)
    return df.mapInArrow(_lean(f), schema)


def shipped(df: DataFrame, path: str) -> str:
    """Send a file to the executors; tasks open ``SparkFiles.get`` of the returned name."""
    df.sparkSession.sparkContext.addFile(path)
    return os.path.basename(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups from batches that are sorted by ``keys``.

    Yields tables that hold one or more whole groups; a group is held back
    until its last row has come.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        if held:
            last = held[-1]
            new[0] = any(last.column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        whole = [*held, batch.slice(0, cut)] if cut else held
        if whole:
            yield pa.Table.from_batches(whole)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def group_edges(table_: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers where groups begin, and the row count."""
    new = np.ones(table_.num_rows, bool)
    if table_.num_rows > 1:
        new[1:] = False
        for k in keys:
            c = table_.column(k).to_numpy()
            new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), table_.num_rows)


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))
