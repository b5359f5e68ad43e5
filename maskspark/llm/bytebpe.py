"""Byte-level BPE encoding and decoding by a rank file.

Each match of the pattern (a pre-token) is looked up in two tiers: a minimal perfect
hash over the vocabulary resolves pre-tokens that are whole entries; for the others a
heap of candidate merges runs over a doubly linked list of bytes. Pre-tokens repeat, so
each process keeps what it has worked out, up to a bound.

Edge cases: a null text counts as empty and has no ids; an empty text has no ids; null
ids decode to null; repeated rows and ids give a row each; other columns are ignored; no
rows give no rows.
Text is encoded as ordinary text: strings of special tokens have no meaning.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_returned
from .pretokens import LONGEST_KEPT, chunk_lists, no_gc


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys, n slots, one displacement a bucket.

    Buckets are placed from the largest to the smallest; a bucket's displacement d puts
    each of its keys at (h1 + d * h2) mod p mod n (p: a large prime), all on free slots. The last buckets of one
    key get the slots left over, noted as a negative displacement.
    """

    PRIME = (1 << 31) - 1

    def __init__(self, keys: list[bytes]):
        import numpy as np
        import xxhash

        self.digest = xxhash.xxh3_128_intdigest
        self.n, self.buckets = len(keys), max(1, len(keys) // 4)
        self.displaced = [0] * self.buckets
        self.slots = [-1] * self.n
        within: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [self._hash(k) for k in keys]
        for i, (b, _, _) in enumerate(hashes):
            within[b].append(i)
        free = np.ones(self.n, dtype=bool)
        few, many = np.arange(48, dtype=np.int64), np.arange(4096, dtype=np.int64)
        order = sorted(range(self.buckets), key=lambda b: -len(within[b]))
        for b in order:
            group = within[b]
            if len(group) < 2:
                break
            h1 = np.array([hashes[i][1] for i in group])[:, None]
            h2 = np.array([hashes[i][2] for i in group])[:, None]
            base, tries = 0, few
            while True:
                at = (h1 + (tries + base) * h2) % self.PRIME % self.n
                fits = free[at].all(axis=0)
                for d in np.flatnonzero(fits):
                    column = at[:, d].tolist()
                    if len(set(column)) == len(column):
                        break
                else:
                    base, tries = base + len(tries), many
                    if base > 50_000_000:
                        raise ValueError("two keys are alike")
                    continue
                break
            self.displaced[b] = int(d) + base
            free[column] = False
            for slot, i in zip(column, group):
                self.slots[slot] = i
        left = iter(np.flatnonzero(free).tolist())
        for b in order:
            if len(within[b]) == 1:
                slot = next(left)
                self.displaced[b] = -slot - 1
                self.slots[slot] = within[b][0]

    def _hash(self, key: bytes) -> tuple[int, int, int]:
        h = self.digest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32 & 0xFFFFFFFF) % self.PRIME, 1 + (h >> 64 & 0xFFFFFFFF) % (self.PRIME - 1)

    def slot(self, key: bytes) -> int:
        """The slot of a key; any slot for other strings: the caller compares."""
        bucket, h1, h2 = self._hash(key)
        d = self.displaced[bucket]
        return -d - 1 if d < 0 else (h1 + d * h2) % self.PRIME % self.n


class ByteBPE:
    def __init__(self, path: str | None = None, pattern: str | None = None, cache: int = 800_000):
        import regex

        from public_tokenizers import PATTERN

        pattern = pattern or PATTERN
        self.one_chunk = pattern != PATTERN
        self.ranks = read_ranks(path or default_path())
        tokens = list(self.ranks)
        self.hash = PerfectHash(tokens)
        self.at_slot = [tokens[i] for i in self.hash.slots]
        self.id_at_slot = [self.ranks[t] for t in self.at_slot]
        self.pre_tokens = regex.compile(pattern).findall
        self.chunks: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a pre-token that is an entry of the vocabulary."""
        slot = self.hash.slot(piece)
        return self.id_at_slot[slot] if self.at_slot[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: merge the lowest-ranked neighbours, the leftmost first, until none is left."""
        n = len(piece)
        get = self.ranks.get
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i]:
                continue
            j = after[i]
            if j >= n or after[j] != end:
                continue
            after[i] = end
            gone[j] = 1
            if end < n:
                before[end] = i
                if (rank := get(piece[i : after[end]])) is not None:
                    heapq.heappush(heap, (rank, i, after[end]))
            p = before[i]
            if p >= 0 and (rank := get(piece[p:end])) is not None:
                heapq.heappush(heap, (rank, p, end))
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return ids

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for pre in self.pre_tokens(chunk):
            ids = self.known.get(pre)
            if ids is None:
                piece = pre.encode()
                one = self.whole(piece)
                ids = array("I", self.merged(piece) if one is None else (one,)).tobytes()
                if len(pre) <= LONGEST_KEPT:
                    self.known[pre] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for chunks in chunk_lists(text, self.one_chunk):
            try:
                out.append(b"".join(map(self.chunks.__getitem__, chunks)))
                continue
            except KeyError:
                pass
            if len(self.chunks) > self.cache:
                self.chunks.clear()
            if len(self.known) > self.cache:
                self.known.clear()
            kept, long = self.chunks, {}
            for c in chunks:
                if c not in kept:
                    (kept if len(c) <= LONGEST_KEPT else long)[c] = self._chunk(c)
            get = (lambda c, kept=kept, long=long: long[c] if len(c) > LONGEST_KEPT else kept[c]) if long else kept.__getitem__
            out.append(b"".join(map(get, chunks)))
        return b"".join(out)



class Decoder:
    """Ids to bytes: all that decoding needs is a list of the tokens."""

    def __init__(self, path: str | None = None):
        ranks = read_ranks(path or default_path())
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


_MADE: dict[tuple, ByteBPE] = {}
_DECODERS: dict[str | None, Decoder] = {}


def codec(path: str | None = None, pattern: str | None = None) -> ByteBPE:
    """The process's codec for a rank file."""
    if (path, pattern) not in _MADE:
        _MADE[path, pattern] = ByteBPE(path, pattern)
    return _MADE[path, pattern]


def decoder(path: str | None = None) -> Decoder:
    """The process's decoder for a rank file."""
    if path not in _DECODERS:
        _DECODERS[path] = Decoder(path)
    return _DECODERS[path]


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id_col, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        with memory_returned():
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    part = batch.slice(at, 1_000)
                    with no_gc():
                        ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "n_tokens", "ids"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, id_col: str = "doc_id", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep..., bytes binary) from rows with an `ids` column as encode() gives it."""
    rows = df.select(id_col, *keep, "ids")
    schema = rows.drop("ids").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = decoder(path)
        with memory_returned():
            for batch in batches:
                raw = [None if x is None else tokens.decode(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], names=[*schema.names, "bytes"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", bytes binary")
