"""Helpers shared by the corpus operators: the shared folder and per-process caches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Where the setting is absent, a local master gets a temporary folder; on a
    cluster that would not be shared, so it is an error there.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="maskspark-")
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has had."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.step_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made with stored() that nothing reads any more."""
    for table in tables:
        delete_path(table.sparkSession, table.step_path)


def bounded(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """df, marked for broadcast if it is proven to have few rows (it must have narrow ones)."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def joined_by_key(rows: DataFrame, keyed: DataFrame, same: dict[str, str], n: str, total: int, most_hot: int = 1_000, least_hot: int = 10_000) -> DataFrame:
    """rows joined with keyed, which has one row a key and in column n how many of rows have that key.

    same: columns of rows by their names in keyed. No key's rows are brought to one task: keys
    of more than total / most_hot rows are broadcast, and as their n add up to total at most
    there are at most most_hot of them. The others meet in a shuffle. Both sides are read twice.
    """
    limit = max(least_hot, total // most_hot)
    if total <= limit:
        return rows.join(keyed, [rows[r] == keyed[k] for k, r in same.items()])
    often = F.broadcast(keyed.where(F.col(n) > limit))
    keys = F.broadcast(keyed.where(F.col(n) > limit).select(*same))
    on = lambda other: [rows[r] == other[k] for k, r in same.items()]
    hot = rows.join(often, on(often))
    rest = rows.join(keys, on(keys), "left_anti")
    seldom = keyed.where(F.col(n) <= limit)
    return hot.unionByName(rest.join(seldom, [rest[r] == seldom[k] for k, r in same.items()]))


def placed(df: DataFrame, name: str) -> DataFrame:
    """df with a number for each row, the same whenever it is read: a hash of its file and place in it.

    Where df isn't read straight from Parquet files, it is written to some first.
    """
    number = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias(name)
    try:
        return df.select("*", number)
    except AnalysisException:
        return stored(df, "placed").select("*", number)


def plain_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1, ..., which clash with no name an operator uses, and these by df's names."""
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder made with new_path, in whichever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


@contextlib.contextmanager
def memory_returned():
    """After a task's batches, what they took goes back to the system: waiting workers hold little."""
    import pyarrow as pa

    try:
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)
