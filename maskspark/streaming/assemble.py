"""Scan results of chunks put together to documents, as a batch and as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from maskspark.operators.detect import FINDING
from maskspark.sources.messages import policy_name

ASSEMBLED = f"doc_id string, source_path string, total int, chunks int, complete boolean, late boolean, findings array<{FINDING}>"


def shifted(scans: DataFrame) -> DataFrame:
    """Scan results with a document and chunk number, their findings in the document's offsets and names."""
    rows = scans.where("doc_id is not null and doc_id <> ''").withColumn("idx", F.expr(r"try_cast(regexp_extract(chunk_id, '#c([0-9]+)$', 1) as int)")).where("idx is not null")
    offset = F.coalesce("chunk_offset", F.lit(0))
    moved = F.transform(
        F.coalesce("findings", F.expr("array()")),
        lambda f: F.struct(
            policy_name(f["entity"]).alias("entity_type"), (f["start"] + offset).alias("start"), (f["end"] + offset).alias("end"), F.coalesce(f["confidence"], F.lit(1.0)).alias("confidence"),
            F.coalesce(f["tier"], F.lit("T1")).alias("tier"), F.coalesce(f["validated"], F.lit(False)).alias("validated"),
        ),
    )
    return rows.withColumn("findings", moved).withColumns({"source_path": F.coalesce("file_id", "doc_id"), "total": F.coalesce("total_chunks", F.lit(1))})


def safe_id(source_path, doc_id):
    """A file name of its own for a document: the path's stem and the id's first eight characters."""
    stem = F.regexp_replace(F.regexp_extract(source_path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.concat(stem, F.lit("-"), F.substring(doc_id, 1, 8))


def assembled(scans: DataFrame, arrival: str, only_complete: bool = True) -> DataFrame:
    """Documents of a batch of scan results: file_id, source_path, doc_id, chunks, complete, findings.

    Of results for one chunk the last by `arrival` counts; how many chunks a document has, and
    its path, is as its first result says. Findings are in the chunks' order.
    """
    rows = shifted(scans)
    last = rows.groupBy("doc_id", "idx").agg(F.max_by("findings", arrival).alias("findings"))
    heads = rows.groupBy("doc_id").agg(F.min_by(F.struct("source_path", "total"), arrival).alias("head"))
    docs = last.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "findings"))).alias("parts")).join(heads, "doc_id")
    chunks = F.size("parts")
    out = docs.select(
        safe_id(F.col("head.source_path"), F.col("doc_id")).alias("file_id"), F.col("head.source_path").alias("source_path"), "doc_id", chunks.alias("chunks"),
        (chunks >= F.col("head.total")).alias("complete"), F.flatten(F.transform("parts", lambda p: p["findings"])).alias("findings"),
    )
    return out.where("complete") if only_complete else out


class Assembler(StatefulProcessor):
    """Holds a document's chunks until all are there, or until none has come for idle_ms.

    That a document has left is remembered for forget_ms; chunks that come in that time go out as late.
    """

    def __init__(self, idle_ms: int = 300_000, forget_ms: int = 86_400_000):
        self.idle_ms, self.forget_ms = idle_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "source_path string, total int, chunks int, done boolean", self.forget_ms)
        self.parts = handle.getMapState("parts", "idx int", "findings string")

    def _document(self, doc_id: str, head: tuple) -> pd.DataFrame:
        import json

        parts = sorted((int(k[0]), v[0]) for k, v in self.parts.iterator())
        self.parts.clear()
        self.head.update((*head[:3], True))
        self._disarm()
        return self._rows(doc_id, head, len(parts), [f for _, text in parts for f in json.loads(text)], False)

    @staticmethod
    def _rows(doc_id: str, head: tuple, chunks: int, findings: list, late: bool) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [doc_id], "source_path": [head[0]], "total": [head[1]], "chunks": [chunks], "complete": [chunks >= head[1]], "late": [late], "findings": [findings]})

    def _disarm(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        import json

        head = self.head.get() if self.head.exists() else None
        for batch in rows:
            for idx, source_path, total, text in zip(batch["idx"], batch["source_path"], batch["total"], batch["findings_json"]):
                if head is None:
                    head = (source_path, int(total), 0, False)
                if head[3]:  # the document has left; its chunks don't begin another
                    yield self._rows(key[0], head, 1, json.loads(text), True)
                    continue
                new = not self.parts.containsKey((int(idx),))
                self.parts.updateValue((int(idx),), (text,))
                head = (head[0], head[1], head[2] + new, False)
                if head[2] >= head[1]:
                    yield self._document(key[0], head)
                    head = (*head[:3], True)
        if head is not None and not head[3]:
            self.head.update(head)
            self._disarm()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        head = self.head.get() if self.head.exists() else None
        if head is not None and not head[3]:
            yield self._document(key[0], tuple(head))

    def close(self) -> None:
        pass


def assembled_stream(scans: DataFrame, idle_ms: int = 300_000, forget_ms: int = 86_400_000) -> DataFrame:
    """The same for a stream. A document goes out once; each chunk that comes later is a row with late = true.

    Needs spark.sql.streaming.stateStore.providerClass set to the RocksDB provider.
    """
    rows = shifted(scans).select("doc_id", "idx", "source_path", "total", F.to_json("findings").alias("findings_json"))
    return rows.groupBy("doc_id").transformWithStateInPandas(Assembler(idle_ms, forget_ms), ASSEMBLED, "append", "processingTime")


def write_documents(batch: DataFrame, path: str) -> None:
    """A foreachBatch sink: documents/ and late/, by whether they are late."""
    batch.where("not late").write.mode("append").json(f"{path}/documents")
    batch.where("late").write.mode("append").json(f"{path}/late")
