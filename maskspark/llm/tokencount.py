"""Token counts by rank-synchronous merging of ragged numpy arrays.

The pre-tokens of a batch lie one after another in one array of symbols. In every round
each sequence finds its pair of lowest rank and all occurrences of that pair in it are
merged at once; what is left when no sequence has a pair of the vocabulary is counted. Ranks
are kept from round to round: only pairs beside a merge are looked up again. A sequence of
over LONG bytes is an array of its own, whose symbols are linked, so that a round touches only
the occurrences of its pair and the work grows in proportion to the length, but for sorting.
Merging all occurrences at once gives what merging them one by one does, as a pair
with the new symbol always ranks behind the pair that made it.

Edge cases: a null or empty text has 0 tokens and 0 bytes; a special string of the
vocabulary inside a text counts as one token, as the library has it by default;
repeated rows and ids give a row each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LONGEST_KEPT, chunk_lists, no_gc
from .wordbpe import byte_characters


#: Bytes above which a pre-token is an array of its own.
LONG = 1_024


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merger:
    """count(pieces): how many symbols are left of each byte string."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.size = max(vocab.values()) + 1
        self.first = np.array([vocab[c] for c in byte_characters()], dtype=np.int64)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(order, 0).astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges] + [0], dtype=np.int64)

    NONE = np.int64(1) << 40

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at], self.NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        left = lengths.copy()
        for i in np.flatnonzero(lengths > LONG).tolist():
            left[i] = self.count_long(pieces[i])
        short = np.flatnonzero((lengths > 1) & (lengths <= LONG))
        symbols = self.first[np.frombuffer(b"".join([pieces[i] for i in short.tolist()]), np.uint8)]
        owner = np.repeat(short, lengths[short])
        rank = self._ranks_at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            alive = least != self.NONE  # sequences without a pair are done
            at = every_second(np.flatnonzero((rank == least) & alive))
            if not len(at):
                break
            symbols[at] = self.made[rank[at]]
            np.subtract.at(left, owner[at], 1)
            alive[at + 1] = False
            again = np.zeros(len(symbols), bool)
            again[at] = True
            again[at[at > 0] - 1] = True
            symbols, owner, rank, again = symbols[alive], owner[alive], rank[alive], again[alive]
            where = np.flatnonzero(again)
            rank[where] = self._ranks_at(symbols, owner, where)
        return left

    def _ranks_at(self, symbols: np.ndarray, owner: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at places of a ragged array; none over the end of a sequence."""
        out = np.full(len(where), self.NONE)
        inner = where + 1 < len(symbols)
        inner[inner] = owner[where[inner]] == owner[where[inner] + 1]
        out[inner] = self._ranks(symbols[where[inner]], symbols[where[inner] + 1])
        return out

    def count_long(self, piece: bytes) -> int:
        """The same for one long sequence: places wait in a list for each rank."""
        n = left = len(piece)
        symbols = np.append(self.first[np.frombuffer(piece, np.uint8)], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        rank = np.full(n + 1, self.NONE)
        waiting: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def look(where: np.ndarray) -> None:
            rank[where] = self.NONE
            where = where[after[where] < n]
            rank[where] = found = self._ranks(symbols[where], symbols[after[where]])
            where, found = where[found != self.NONE], found[found != self.NONE]
            order = np.argsort(found, kind="stable")
            where, found = where[order], found[order]
            starts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else []
            for part, r in zip(np.split(where, starts[1:]), found[starts].tolist()) if len(found) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(lowest, r)
                waiting[r].append(part)

        look(np.arange(n))
        while lowest:
            r = heapq.heappop(lowest)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]  # others have merged with a neighbour since
            at = every_second(at, after)
            gone, beyond = after[at], after[after[at]]
            symbols[at] = self.made[r]
            rank[gone] = self.NONE
            after[at] = beyond
            before[beyond] = at
            left -= len(at)
            look(np.unique(np.concatenate([at, before[at[before[at] >= 0]]])))
        return left


def every_second(at: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Of places of one pair, those that merge: in a run of overlapping ones (aaa) every second, from its first.

    after: of each place the next one, if that is not the neighbour.
    """
    if not len(at):
        return at
    begins = np.append(True, (at[:-1] + 1 if after is None else after[at[:-1]]) != at[1:])
    starts = np.flatnonzero(begins)
    within = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    return at[within % 2 == 0]


class TokenCounter:
    """The number of tokens of texts for a byte-level vocabulary in a `tokenizers` file."""

    def __init__(self, path: str | None = None, pattern: str | None = None, cache: int = 600_000):
        import regex

        from public_tokenizers import PATTERN

        pattern = pattern or PATTERN
        self.whole = pattern != PATTERN
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.merger = Merger(spec["model"]["vocab"], merges)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pre_tokens = regex.compile(pattern).findall
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.cache = cache

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        jobs, held = [], 0
        for text in texts:
            found = len(self.at_special.findall(text)) if any(s in text for s in self.special) else 0
            lists = [c for part in (self.at_special.split(text) if found else (text,)) if part for c in chunk_lists(part, self.whole)]
            jobs.append((found, lists))
            held += sum(map(len, lists))
            if held > 2_000_000:
                out += self._work(jobs)
                jobs, held = [], 0
        return out + self._work(jobs)

    def _work(self, jobs: list[tuple[int, list[list[str]]]]) -> list[int]:
        if len(self.chunks) > self.cache:
            self.chunks.clear()
        if len(self.pieces) > self.cache:
            self.pieces.clear()
        new = set()
        for _, lists in jobs:
            for chunks in lists:
                new.update(chunks)
        new -= self.chunks.keys()
        split = {c: self.pre_tokens(c) for c in new}
        wanted = {p for pieces in split.values() for p in pieces} - self.pieces.keys()
        long = self._merge(list(wanted))
        for c, pieces in split.items():
            self.chunks[c] = sum([self.pieces[p] if p in self.pieces else long[p] for p in pieces])
        get = self.chunks.__getitem__
        out = [found + sum(sum(map(get, chunks)) for chunks in lists) for found, lists in jobs]
        for c in new:
            if len(c) > LONGEST_KEPT:
                del self.chunks[c]
        return out

    def _merge(self, wanted: list[str]) -> dict[str, int]:
        long = {}
        at = 0
        while at < len(wanted):  # so many pre-tokens at once that arrays stay some MB large
            end, size = at, 0
            while end < len(wanted) and size < 400_000:
                size += len(wanted[end]) + 1
                end += 1
            for p, n in zip(wanted[at:end], self.merger.count([w.encode() for w in wanted[at:end]]).tolist()):
                (self.pieces if len(p) <= LONGEST_KEPT else long)[p] = n
            at = end
        return long


_MADE: dict[tuple, TokenCounter] = {}


def counter(path: str | None = None, pattern: str | None = None) -> TokenCounter:
    """The process's counter for a vocabulary file."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = TokenCounter(path, pattern)
    return _MADE[path, pattern]


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, n_bytes long, n_tokens long), a row per row of df."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path, pattern)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = pa.compute.binary_length(batch.column(1).cast(pa.binary())).cast(pa.int64())
            with no_gc():
                n = tokens.counts(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
