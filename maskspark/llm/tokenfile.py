"""Token ids in Parquet files of list columns, in ascending order of the documents' ids.

The rows are parted by ranges of the id (and of rows of one id, by the text's hash and the
row's place, so that even these are cut in ranges) and sorted within them; each range is tokenised
and written as one file. Row groups, pages and the lists' encoding are set by
parameters; Parquet's own page indexes let a reader skip to some rows, and the
metadata columns (part, part_start, n_tokens) are read without touching the ids.

Edge cases: a null text counts as empty; an empty text is its end id alone; null ids of
documents come first; rows of one id are ordered by a hash of their text and keep a row each;
other columns are ignored; no rows give files of no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded
from .pretokens import no_gc
from .wordbpe import encoder

#: Writer settings for the lists: values of a page's dictionary, or differences packed to bits.
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true", "parquet.writer.version": "PARQUET_1_0"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


def write_token_files(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000, compression: str = "zstd") -> None:
    """Write (id_col, part int, part_start long, n_tokens int, ids array<int>) to path."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "part", "part_start", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        words, part, start = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1_000):
                with no_gc():
                    ids = [x + end for x in words.encode(texts.slice(at, 1_000).to_pylist())]
                sizes = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1_000), pa.array(np.full(len(ids), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes.astype(np.int32)), lists], names=names)
                start += int(offsets[-1])

    order = [F.col("id").asc_nulls_first(), F.col("hash"), F.col("place")]
    ranged = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()}).repartitionByRange(*order)
    done = ranged.sortWithinPartitions(*order).select("id", "text").mapInArrow(run, f"`{id_col}` {kind}, part int, part_start long, n_tokens int, ids array<int>")
    options = ENCODINGS[encoding] | {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.page.row.count.limit": str(page_rows), "compression": compression}
    done.write.options(**options).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with `start`: the ids of all documents before each.

    The starts of the parts come from the metadata columns alone: one row per file.
    """
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = bounded(totals.select(F.col("part").alias("part_"), before.alias("base")))
    return files.join(starts, files["part"] == starts["part_"]).withColumn("start", F.col("base") + F.col("part_start")).drop("part_", "base", "part_start")


def with_crc32(tokens: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(keep..., ids_crc32 long): checksums of the ids as little-endian unsigned 32-bit integers."""
    rows = tokens.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("ids").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets, values = lists.offsets.to_pylist(), memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.int32))
            sums = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())], names=[*keep, "ids_crc32"])

    return rows.mapInArrow(run, schema + ", ids_crc32 long")
