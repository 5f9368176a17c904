"""What several operators share: shared storage, row numbers and Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "__row"
ROW_TYPE = "struct<file:bigint,index:bigint>"
#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local master may go without spark.checkpoint.dir."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir().rstrip("/")


#: Tables of stage() that are still there: path and session.
_STAGED: dict[str, SparkSession] = {}


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    What a lazy result still reads can't be deleted by the operator that made it; it goes with discard_since(), or
    when the application ends.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{name}-{uuid.uuid4().hex}"
    _STAGED[path] = df.sparkSession
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stage_path = path
    return out


def _delete(path: str) -> None:
    spark = _STAGED.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*staged: DataFrame) -> None:
    """Delete tables that stage() wrote, once all that was made of them has been written in turn."""
    for df in staged:
        if getattr(df, "_stage_path", None):
            _delete(df._stage_path)


def staged_now() -> set[str]:
    return set(_STAGED)


def discard_since(before: set[str], *but: DataFrame) -> None:
    """Delete the tables staged since staged_now() gave `before`, but for some that are still read."""
    for path in set(_STAGED) - before - {df._stage_path for df in but}:
        _delete(path)


@atexit.register
def _sweep() -> None:
    for path in list(_STAGED):
        try:
            _delete(path)
        except Exception:  # the session is gone; its folder is the application's to clear
            _STAGED.pop(path, None)


def apart(grouped: DataFrame, *keys: str) -> DataFrame:
    """Deal the result of a grouping out anew before it is joined on its keys.

    Else the join would take over the grouping's partitions, and a join on top of a grouping can't be split where
    one key of the other side is hot. The keys are distinct, so this small shuffle is even.
    """
    return grouped.repartition(F.xxhash64(*keys, F.lit(1)))


def _plain_scan(df: DataFrame) -> bool:
    """Whether df is nothing but a scan of Parquet files, each read once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() == "SubqueryAlias":
        plan = plan.child()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    relation = plan.relation()
    return relation.fileFormat().getClass().getSimpleName() == "ParquetFileFormat" and relation.location().rootPaths().size() == 1


def settled(df: DataFrame) -> DataFrame:
    """The same rows as a plain scan of Parquet files, whose rows have a fixed place; anything else is staged first.

    An operator that reads its input more than once settles it, so that every reading gives the same rows
    under the same numbers, whatever df is made of (a shuffle, a random filter, a join).
    """
    return df if _plain_scan(df) else stage(df, "rows")


def numbered(df: DataFrame) -> DataFrame:
    """Add the place of every row of a settled table, which tells repeated rows and null ids apart.

    The place is the hash of the file's path and the row's index in that file. Both belong to the
    file, so lost executors, other splits or other plans never renumber a later scan.
    """
    at = df.metadataColumn("_metadata")
    return df.withColumn(ROW, F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("index")))


def whole_rows(df: DataFrame) -> DataFrame:
    """The place of every row of a settled table, and the row as a struct `doc`, so that no column of it can clash."""
    at = df.metadataColumn("_metadata")
    place = F.struct(F.xxhash64(at["file_path"]).alias("file"), at["row_index"].alias("index"))
    return df.select(place.alias(ROW), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))


def small_batches(spark: SparkSession) -> None:
    """Hand at most 4 MB of rows to Python at once. For queries and jobs to call; operators change no setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "67108864", "64MB"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def release() -> None:
    """Hand back what a task has left in its worker process, since workers are reused by other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def in_tasks(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with a function of all batches of a task; the worker's memory is handed back at the end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(task, schema)


def arrow_map(df: DataFrame, function, schema: str) -> DataFrame:
    """mapInArrow with a function of one batch that returns a dict of columns, or None."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                made = function(batch)
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], (pa.Array, pa.ChunkedArray)) else made[f.name].cast(f.type) for f in target], schema=target)

    return in_tasks(df, run, schema)


def slices(batches, rows: int = 256):
    """Batches of a few rows each, so that what is made of them is small as well."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)
