"""Hierarchical packing of documents into windows of several context sizes.

Each partition packs its own documents, so nothing is shuffled. A document's full
longest windows are cut off first; what is left is routed to the smallest tier that
holds it. Tiers are packed from the longest to the shortest: each window begins with
the tier's longest piece, its gap takes whole pieces from shorter tiers, the best fit
first, and what gap remains is filled by cutting a piece. All windows of a tier are
thus full; of the longest tier's, gaps below `least_piece` stay as padding. The last
pieces of a partition, too few for a window, go to windows of ever smaller powers of two.
Windows are then dealt to step groups of nearly equal token counts, the largest first
to the group with least.

Memory: a partition holds `buffer_tokens` ids at a time, and one whole document.
Sequence and step ids hold the partition number, so they are unique; they are the same
in a rerun if the rows come in the same order, as they do from a table.

Edge cases: a null text counts as empty; an empty text is its end id alone; repeated
rows and ids are documents of their own; other columns are ignored; no rows, no pieces.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory_returned
from .pretokens import no_gc
from .wordbpe import encoder

TIERS = (256, 512, 1024, 2048)

#: (length, document, start): some of a document's ids.
Piece = tuple[int, int, int]


def pack(pieces: list[Piece], tiers: tuple[int, ...] = TIERS, least_piece: int = 16) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Windows (tier, pieces) and the pieces left over, fewer ids than one window holds."""
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    pools: list[list[Piece]] = [[] for _ in tiers]
    for length, doc, start in pieces:
        while length >= top:
            windows.append((top, [(top, doc, start)]))
            start, length = start + top, length - top
        if length:
            pools[bisect_left(tiers, length)].append((length, doc, start))
    for pool in pools:
        pool.sort()
    rest: list[Piece] = []
    for level in range(len(tiers) - 1, -1, -1):
        tier, own = tiers[level], pools[level]
        while own:
            window = [own.pop()]
            gap = tier - window[0][0]
            while gap and not (tier == top and gap < least_piece):
                for k in range(min(level, bisect_left(tiers, gap)), -1, -1):
                    if pools[k] and (at := bisect_right(pools[k], (gap, 1 << 62, 0))):
                        piece = pools[k].pop(at - 1)
                        break
                else:
                    k = next((k for k in range(level + 1) if pools[k]), None)
                    if k is None:
                        break
                    length, doc, start = pools[k].pop()
                    piece = (gap, doc, start)
                    left = (length - gap, doc, start + gap)
                    insort(pools[bisect_left(tiers, left[0])], left)
                window.append(piece)
                gap -= piece[0]
            if gap and not (tier == top and gap < least_piece):
                rest = window  # nothing is left in any tier up to this one: the last window
            else:
                windows.append((tier, window))
    return windows, rest


def ladder(pieces: list[Piece], top: int) -> list[tuple[int, list[Piece]]]:
    """The last pieces as windows whose sizes are falling powers of two."""
    windows, left = [], sum(p[0] for p in pieces)
    queue = list(reversed(pieces))
    while left:
        size = min(top, 1 << (left.bit_length() - 1))
        window, gap = [], size
        while gap:
            length, doc, start = queue.pop()
            take = min(length, gap)
            window.append((take, doc, start))
            if take < length:
                queue.append((length - take, doc, start + take))
            gap -= take
        windows.append((size, window))
        left -= size
    return windows


def balanced(sizes: list[int], group_tokens: int) -> list[int]:
    """A step group for each window, by the window's size; groups get nearly equal sums."""
    groups = [(0, g) for g in range(max(1, -(-sum(sizes) // group_tokens)))]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, g = groups[0]
        out[i] = g
        heapq.heapreplace(groups, (load + sizes[i], g))
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, least_piece: int = 16, group_tokens: int = 32 * 2048, buffer_tokens: int = 4_000_000) -> DataFrame:
    """A row per piece: id_col, start, length, ids binary, doc_tokens, sequence_id, offset, tier, step_id.

    ids are little-endian unsigned 32-bit integers; tier is the window's size.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema[id_col].dataType.simpleString()
    end = end_id.to_bytes(4, "little")
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with memory_returned():
            yield from packed(batches)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        base = TaskContext.get().partitionId() << 33
        ids_type, next_sequence, next_step = None, base, base
        docs: list[tuple[object, bytes]] = []
        pending: list[Piece] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal docs, pending, held, next_sequence, next_step
            windows, rest = pack(pending, tiers, least_piece)
            if last:
                windows += ladder(rest, tiers[-1])
                rest = []
            steps = balanced([t for t, _ in windows], group_tokens)
            out: list[list] = [[] for _ in names]
            size = 0
            for (tier, window), step in zip(windows, steps):
                offset = 0
                for length, d, start in window:
                    doc, ids = docs[d]
                    part = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(out, (doc, start, length, part, len(ids) // 4, next_sequence, offset, tier, next_step + step)):
                        column.append(value)
                    offset += length
                    size += len(part)
                next_sequence += 1
                if size > 4_000_000:
                    yield batch_of(out)
                    out, size = [[] for _ in names], 0
            if out[0]:
                yield batch_of(out)
            next_step += max(steps, default=-1) + 1
            kept = sorted({d for _, d, _ in rest})
            new = {d: i for i, d in enumerate(kept)}
            docs, pending = [docs[d] for d in kept], [(n, new[d], s) for n, d, s in rest]
            held = sum(n for n, _, _ in pending)

        def batch_of(out: list[list]) -> pa.RecordBatch:
            kinds = (ids_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

        for batch in batches:
            ids_type = batch.schema.field(0).type
            with no_gc():
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    for key, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                        docs.append((key, ids + end))
                        pending.append((len(ids) // 4 + 1, len(docs) - 1, 0))
                        held += len(ids) // 4 + 1
                    if held >= buffer_tokens:
                        yield from flush(False)
        if docs:
            yield from flush(True)

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_id long")
