"""Language identification by a byte convolutional network, trained and run in numpy.

A text's bytes (A-Z in lower case) are cut into windows of a fixed length. Filters of
several widths run over each window's bytes, each filter keeps its maximum over the
window, and a softmax layer turns the maxima into probabilities. A text's probabilities
are the mean over all its windows, each weighted by its bytes. As inputs are single
bytes, a filter is a table of weights by place and byte; for prediction two places are
put together in one table of byte pairs.

Training reads a bounded sample: of each language the `docs_per_language` labelled
documents with the smallest hash of their id, and of each `windows_per_doc` windows, which
are cut where the texts are: only windows reach the driver. Only text and language are learned from.

Edge cases: a null text, and one without a letter, is `und` with score 0; so is every
text if there was nothing to learn from; null languages are not learned from, nor are those
whose sample has no letter; of rows of one id and language one is learned from (the smallest windows);
repeated rows and ids give a row each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, memory_returned, stored

UNDETERMINED = "und"
_NEVER = np.float32(-1e9)


def windows_of(raw: bytes, length: int) -> np.ndarray:
    """All windows of a text, the last filled up with zero bytes: (n, length)."""
    raw = raw.lower()
    raw += b"\0" * (-len(raw) % length)
    return np.frombuffer(raw, np.uint8).reshape(-1, length)


class ByteConvNet:
    """tables[w]: (w, 256, filters) weights by place and byte; dense: (features, languages)."""

    def __init__(self, languages: list[str], widths: tuple[int, ...] = (2, 3, 4), filters: int = 16, length: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.widths, self.filters, self.length = languages, widths, filters, length
        self.tables = {w: rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in widths}
        self.bias = {w: np.zeros(filters, np.float32) for w in widths}
        self.dense = rng.normal(0, 0.1, (len(widths) * filters, len(languages))).astype(np.float32)
        self.offset = np.zeros(len(languages), np.float32)
        self.pairs: dict[int, list[np.ndarray]] | None = None

    def _maxima(self, x: np.ndarray, at: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Each filter's maximum over each window (and its place): zero bytes never win."""
        found, places = [], []
        for w in self.widths:
            n = x.shape[1] - w + 1
            total = np.zeros((len(x), n, self.filters), np.float32)
            blank = np.zeros((len(x), n), bool)
            for k in range(w):
                total += self.tables[w][k][x[:, k : k + n]]
                blank |= x[:, k : k + n] == 0
            total[blank] = _NEVER
            if at:
                places.append(total.argmax(axis=1))
            found.append(total.max(axis=1) + self.bias[w])
        return np.maximum(np.concatenate(found, axis=1), 0), places

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross-entropy; only a maximum's place has a gradient in a table."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables.values(), *self.bias.values(), self.dense, self.offset]
        moment = [np.zeros_like(p) for p in weights]
        square = [np.zeros_like(p) for p in weights]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                step += 1
                bytes_, n = x[rows], len(rows)
                features, places = self._maxima(bytes_, at=True)
                p = softmax(features @ self.dense + self.offset)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.dense.T) * (features > 0)
                grads = []
                for k, w in enumerate(self.widths):
                    g = np.zeros_like(self.tables[w])
                    part = back[:, k * self.filters : (k + 1) * self.filters]
                    for j in range(w):
                        seen = np.take_along_axis(bytes_, places[k] + j, axis=1)
                        np.add.at(g[j], (seen, np.arange(self.filters)[None, :]), part)
                    grads.append(g)
                grads += [back[:, k * self.filters : (k + 1) * self.filters].sum(axis=0) for k in range(len(self.widths))]
                grads += [features.T @ p, p.sum(axis=0)]
                for q, g, m, s in zip(weights, grads, moment, square):
                    m += 0.1 * (g - m)
                    s += 0.001 * (g * g - s)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        self.pairs = None

    def _prepare(self) -> None:
        """Tables for prediction: neighbouring places as one table of 65,536 byte pairs."""
        self.pairs = {}
        for w, table in self.tables.items():
            table = table.copy()
            table[:, 0] = _NEVER
            self.pairs[w] = [(table[k][:, None] + table[k + 1][None]).reshape(65536, -1) if k + 1 < w else table[k] for k in range(0, w, 2)]

    def predict(self, x: np.ndarray, block: int = 96) -> np.ndarray:
        """Probabilities of windows, (n, languages)."""
        if self.pairs is None:
            self._prepare()
        out = np.empty((len(x), len(self.languages)), np.float32)
        for at in range(0, len(x), block):
            part = x[at : at + block]
            single = part.astype(np.int32)
            pair = single[:, :-1] << 8 | single[:, 1:]
            found = []
            for w in self.widths:
                n = self.length - w + 1
                total = None
                for k, table in enumerate(self.pairs[w]):
                    index = (pair if 2 * k + 1 < w else single)[:, 2 * k : 2 * k + n]
                    hit = table.take(index, axis=0)
                    total = hit if total is None else np.add(total, hit, out=total)
                found.append(total.max(axis=1) + self.bias[w])
            out[at : at + block] = softmax(np.maximum(np.concatenate(found, axis=1), 0) @ self.dense + self.offset)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 200, windows_per_doc: int = 6, length: int = 256, **shape) -> ByteConvNet | None:
    """A network learned from df's rows of non-null text and language, or None without any."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null and id is not null")
    # Hashes under a bound that twice the wanted ids of a language are expected under: few rows are ranked.
    sizes = bounded(rows.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("id").alias("n")))
    drawn = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / (1 << 53) < 2 * docs_per_language / F.col("n")
    few = rows.select("lang", "id").join(sizes, F.col("lang") == F.col("of")).where(drawn).select("of", F.col("id").alias("one")).distinct()
    rank = F.row_number().over(Window.partitionBy("of").orderBy("hash", "one"))
    ids = few.withColumn("hash", F.pmod(F.xxhash64("one"), F.lit(1 << 53))).withColumn("rank", rank).where(F.col("rank") <= docs_per_language).select("of", "one")
    texts = rows.join(bounded(stored(ids, "language-sample")), (F.col("lang") == F.col("of")) & (F.col("id") == F.col("one"))).select("lang", "id", "text")
    kind = texts.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [sample_windows(t, length, windows_per_doc) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(parts, pa.binary())], names=["lang", "id", "windows"])

    found = texts.mapInArrow(cut, f"lang string, id {kind}, windows binary").where("windows is not null")
    found = found.groupBy("lang", "id").agg(F.min("windows").alias("windows"))  # an id may be repeated
    sample = sorted((r["lang"], r["id"], bytes(r["windows"])) for r in found.collect())
    if not sample:
        return None
    languages = sorted({lang for lang, _, _ in sample})
    xs = [np.frombuffer(x, np.uint8).reshape(-1, length) for _, _, x in sample]
    ys = [languages.index(lang) for (lang, _, _), x in zip(sample, xs) for _ in x]
    net = ByteConvNet(languages, length=length, **shape)
    net.train(np.concatenate(xs), np.array(ys))
    return net


def sample_windows(text: str, length: int, most: int) -> bytes | None:
    """At most `most` windows spread over a text, one after another; None if it has no letter."""
    if not has_letter(text):
        return None
    x = windows_of(text.encode(), length)
    return x[np.unique(np.linspace(0, len(x) - 1, most).astype(int))].tobytes()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(df: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., lang_pred string, score double): score is the probability of lang_pred."""
    kept = df.select(id_col, *keep)
    again = text_col in keep and kept.schema[text_col].dataType.simpleString() == "string"  # texts are sent once
    rows = kept if again else df.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    at_text = 1 + keep.index(text_col) if again else 1 + len(keep)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "lang_pred string, score double"])
    if net is not None:
        net.pairs = None  # made anew in each process: small to send, large to use

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            for batch in batches:
                yield from labelled(batch)

    def labelled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 1_000):
            part = batch.slice(at, 1_000)
            found = classify(net, part.column(at_text).to_pylist())
            yield pa.RecordBatch.from_arrays([*part.columns[: 1 + len(keep)], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    return rows.mapInArrow(run, ddl)


def classify(net: ByteConvNet | None, texts: list[str | None]) -> list[tuple[str, float]]:
    out = [(UNDETERMINED, 0.0)] * len(texts)
    if net is None:
        return out
    jobs: list[tuple[int, np.ndarray]] = []
    held = 0

    def work() -> None:
        if not jobs:
            return
        p = net.predict(np.concatenate([x for _, x in jobs]))
        at = 0
        for i, x in jobs:
            weight = (x != 0).sum(axis=1) + 1e-9
            mean = (p[at : at + len(x)] * weight[:, None]).sum(axis=0) / weight.sum()
            best = int(mean.argmax())
            out[i] = (net.languages[best], float(min(1.0, mean[best])))
            at += len(x)
        jobs.clear()

    for i, text in enumerate(texts):
        if has_letter(text):
            x = windows_of(text.encode(), net.length)
            jobs.append((i, x))
            held += len(x)
            if held > 20_000:
                work()
                held = 0
    work()
    return out
