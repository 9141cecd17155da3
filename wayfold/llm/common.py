"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Bytes of a batch that Python works on at once; a larger one is halved until it is within or has one row.
PIECE_BYTES = 8 << 20
#: Rows of a table of ids that is broadcast; a larger one is shuffled.
SMALL = 500_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what setCheckpointDir() was given. Where both are unset, one machine has a
    temporary folder; a cluster has none, which is an error."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="wayfold-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. The caller's job owns it; it stays until the folder is cleaned."""
    return f"{shared_folder(spark)}/wayfold/{name}-{uuid.uuid4().hex}"


class _Scopes(threading.local):
    """Paths of the tables that each open scratch() of this thread has, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = []


_SCRATCH = _Scopes()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are landed inside are deleted at the end, but for those that are kept."""
    _SCRATCH.open.append([])
    try:
        yield
    finally:
        for name in _SCRATCH.open.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def landed(df: DataFrame, name: str, by: str | None = None, keep: bool = False) -> DataFrame:
    """`df` written to the shared folder and read again: a cut lineage that survives lost executors. `by` names a column that rows are kept apart by;
    with `keep` the table outlives the scratch() around it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    scopes = _SCRATCH.open[:-1] if keep else _SCRATCH.open
    if scopes:
        scopes[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _rows_of_one_scan(df: DataFrame) -> bool:
    """Whether each row of `df` is another row of one folder or file: columns are chosen and rows filtered, nothing else."""
    plan = df._jdf.queryExecution().analyzed()
    while (kind := plan.getClass().getSimpleName()) in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return kind == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation" and plan.relation().location().rootPaths().size() == 1


def numbered(df: DataFrame, name: str) -> DataFrame:
    """`df` with a column `name` that tells its rows apart and is the same whenever they are read: of a plain scan, the place of a
    row in its file; rows of any other origin (exploded, joined, put together, not from a file) are written with a number."""
    if _rows_of_one_scan(df):
        try:
            return df.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(name))
        except AnalysisException:  # a format without row numbers
            pass
    return landed(df.withColumn(name, F.monotonically_increasing_id()), "numbered", keep=True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo `modulus`; null for a null key."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(modulus)


def pieces(batch: pa.RecordBatch, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """`batch` in parts of at most `limit` bytes or one row."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), limit)
    yield from pieces(batch.slice(half), limit)


def append_columns(
    df: DataFrame,
    needs: list[str],
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """`df` row by row with columns that Python computes from Arrow batches.

    make() is called once in each task and gives the function from a batch (of the columns `needs`, among others) to the
    arrays of `fields`. Columns named in `keep` (all if None) pass through; one whose name clashes with a new field gives way.
    """
    new = {f.name for f in fields}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    chosen = df.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, *needs])))
    schema = T.StructType([*(chosen.schema[c] for c in keep), *fields])
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        try:
            for whole in batches:
                for batch in pieces(whole):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *compute(batch)], names=names)
        finally:
            release_memory()

    return chosen.mapInArrow(run, schema)


def join_ids(rows: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """`rows`, which are wide, joined to a written table of ids: broadcast if it has at most SMALL rows, else both are dealt by the id; rows aren't sorted."""
    return rows.join(F.broadcast(ids) if ids.count() <= SMALL else ids.hint("shuffle_hash"), on, how)


def release_memory() -> None:
    """Gives what a Python worker no longer uses back to the system; workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every system's C library has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def under_own_names(docs: DataFrame, step: Callable[[DataFrame, dict[str, str]], DataFrame], adds: tuple[str, ...] = (), without: tuple[str, ...] = ()) -> DataFrame:
    """step(renamed docs, new name of each column), whose rows are given the old names again: a step's own columns can't clash.
    Columns that the step `adds` come last; an old column of such a name gives way. The step drops those of `without`."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    out = step(docs.toDF(*names.values()), names)
    return out.select(*(F.col(new).alias(old) for old, new in names.items() if old not in (*adds, *without)), *adds)
