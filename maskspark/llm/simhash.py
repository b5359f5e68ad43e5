"""SimHash fingerprints and near-duplicates, by exact tiled comparison.

Fingerprints: a bit is 1 if it is 1 in over half the 64-bit hashes of a text's word
shingles. Distinct fingerprints are laid in tiles by their population counts, each tile
packed in one row. Fingerprints at a distance of at most `radius` have population counts
that differ by at most `radius`, so pairs of tiles further apart are skipped; within a
pair of tiles, blocks are skipped likewise, by the population counts of their 16-bit
quarters. All other pairs are compared: numpy exclusive-or and bit counts. A task gives
a spanning forest of its links, of the least distances: fewer links than it has
fingerprints, and no component is lost. Components are then worked out over all
forests (components.py). Only counts by population count reach the driver.

similar_documents() is for a similarity of shingle sets: fingerprints of sets within a radius that
this similarity hardly ever exceeds, in tiles whose set sizes allow it, give candidate
links; those of the forests are held against the whole sets, and then all others between
fingerprints that are not yet in one component.

The comparisons grow with the square of the number of different fingerprints; tiles
only divide them by a constant.

Edge cases: a null text counts as empty; a text of no words has fingerprint zero; one
of fewer words than a shingle has one shingle; rows of a null id are linked like others,
and a component of null ids alone has a null component_id; repeated rows have the same
result; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, forget, joined_by_key, memory_returned, stored
from .components import components
from .pretokens import no_gc


#: Rows of a tile that one task packs, about.
PIECE_ROWS = 2_048


def word_shingles(text: str, words: int) -> list[bytes]:
    """Shingles of the words of a text, A-Z in lower case, repeats included."""
    found = text.encode().lower().split()  # of bytes: A-Z only, and at [\x20\x09-\x0D] only
    if len(found) < words:
        return [b" ".join(found)] if found else []
    return list(map(b" ".join, zip(*(found[k:] for k in range(words)))))


def fingerprint(text: str, words: int = 3, bits: int = 64, repeats: bool = True) -> list[int]:
    """bits / 64 unsigned integers; the k-th from XXH64 with seed 42 + k. Without repeats, each shingle counts once."""
    shingles = word_shingles(text, words)
    return fingerprint_of(shingles if repeats else list(set(shingles)), bits)


def fingerprint_of(shingles: list[bytes], bits: int) -> list[int]:
    """The fingerprint of a list of shingles."""
    import numpy as np
    import xxhash

    n, out = len(shingles), []
    for k in range(bits // 64):
        total = np.zeros(64, np.int64)
        seeds = [42 + k] * min(n, 255 * 512)
        for at in range(0, n, 255 * 512):
            part = shingles[at : at + 255 * 512] if n > 255 * 512 else shingles
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, seeds), np.uint64, len(part))
            rows = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(rows) // 255 * 255  # 255 ones at most still fit a byte
            if whole:
                total += rows[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
            total += rows[whole:].sum(axis=0, dtype=np.uint8)
        out.append(int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0)
    return out


def set_hash(shingles: set[bytes]) -> bytes:
    """128 bits of a set of shingles, which hold no line ends."""
    import xxhash

    return xxhash.xxh3_128_digest(b"\n".join(sorted(shingles)))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, sizes: int = 0) -> DataFrame:
    """(id_col, f0 long, f1 long, ...): the fingerprints' words as signed integers.

    With sizes, also n_shingles long and set_hash binary: how many different shingles a text
    has, and a hash of their set; and less_one array<binary>: for sets of at most `sizes`, the
    hashes of the set less one of its shingles. The fingerprints are of sets then.
    """
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = [f"f{k}" for k in range(bits // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def of_set(text: str) -> tuple:
            """Of one text at a time, as sets of many take more than their texts."""
            shingles = set(word_shingles(text, words))
            less = [set_hash(shingles - {x}) for x in shingles] if 1 < len(shingles) <= sizes else []
            return fingerprint_of(list(shingles), bits), len(shingles), set_hash(shingles), less

        with memory_returned():
            for batch in batches:
                for at in range(0, batch.num_rows, 1_000):
                    part = batch.slice(at, 1_000)
                    texts, counts = part.column(1).to_pylist(), []
                    with no_gc():
                        if sizes:
                            found, n, hashes, less = zip(*map(of_set, texts))
                            counts = [pa.array(n, pa.int64()), pa.array(hashes, pa.binary()), pa.array(less, pa.list_(pa.binary()))]
                        else:
                            found = [fingerprint(t, words, bits) for t in texts]
                    table = np.array(found, np.uint64).reshape(len(texts), len(names)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(np.ascontiguousarray(table[:, k])) for k in range(len(names))), *counts], names=[id_col, *names] + (["n_shingles", "set_hash", "less_one"] if sizes else []))

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"`{id_col}` {kind}", *(f"{n} long" for n in names)] + (["n_shingles long", "set_hash binary", "less_one array<binary>"] if sizes else [])))


def closest_forest(edges):
    """Of edges (rows of i, j, distance), those of a minimum spanning forest."""
    import numpy as np

    edges = edges[np.argsort(edges[:, 2], kind="stable")]
    ends, at = np.unique(edges[:, :2], return_inverse=True)
    parent = list(range(len(ends)))
    kept = []
    for n, (u, v) in enumerate(at.reshape(-1, 2).tolist()):
        while parent[u] != u:
            parent[u] = u = parent[parent[u]]
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        if u != v:
            parent[max(u, v)] = min(u, v)
            kept.append(n)
    return edges[kept]


def closest_forests(edges, forests: int):
    """Rows (i, j, distance, k): the k-th is a closest forest of what the earlier ones leave.

    Thinned so, the links of several thinned lists together still have these forests.
    """
    import numpy as np

    out = [np.empty((0, 4), np.int64)]
    for k in range(forests):
        chosen = closest_forest(np.column_stack([edges, np.arange(len(edges))]))
        out.append(np.column_stack([chosen[:, :3], np.full(len(chosen), k)]))
        edges = np.delete(edges, chosen[:, 3], axis=0)
    return np.concatenate(out)


def near_blocks(a, b, radius: int, block: int = 256):
    """(i, j, rows, others, distances) of blocks that may be near: a's i-th and b's j-th, or a's own with j >= i if b is None."""
    import numpy as np

    def ordered(x):
        quarters = np.bitwise_count(x.view(np.uint16).reshape(len(x), -1)).astype(np.int16)
        order = np.lexsort(quarters.T[::-1])
        starts = range(0, len(x), block)
        low = np.array([quarters[order[s : s + block]].min(axis=0) for s in starts])
        high = np.array([quarters[order[s : s + block]].max(axis=0) for s in starts])
        return order, x[order], low, high

    own = b is None
    oa, xa, low_a, high_a = ordered(a)
    ob, xb, low_b, high_b = (oa, xa, low_a, high_a) if own else ordered(b)
    shift = 0 if own else len(a)
    for i in range(len(low_a)):
        x = xa[i * block : (i + 1) * block]
        gap = np.maximum(0, np.maximum(low_b - high_a[i], low_a[i] - high_b)).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        for j in near[near >= i].tolist() if own else near.tolist():
            y = xb[j * block : (j + 1) * block]
            distance = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
            for k in range(1, x.shape[1]):
                distance += np.bitwise_count(x[:, None, k] ^ y[None, :, k])
            yield i, j, oa[i * block : (i + 1) * block], ob[j * block : (j + 1) * block] + shift, distance


def tile_pair_forest(a, b, radius: int, block: int = 256, most_held: int = 1_000_000, forests: int = 1):
    """Links (i, j, distance, k) between rows of a and b, or of a alone if b is None.

    a and b: arrays of shape (rows, words) of unsigned 64-bit integers; rows of b count
    on from a's. Of all pairs at most `radius` apart, a spanning forest of the least
    distances (k = 0), and `forests` - 1 more of other links. Links are held until there
    are many, then thinned to these.
    """
    import numpy as np

    found, held = [np.empty((0, 3), np.int64)], 0
    for i, j, rows, others, distance in near_blocks(a, b, radius, block):
        hit = np.flatnonzero(distance.ravel() <= radius)
        if b is None and i == j:
            hit = hit[hit // len(others) < hit % len(others)]
        if len(hit):
            found.append(np.stack([rows[hit // len(others)], others[hit % len(others)], distance.ravel()[hit]], axis=1).astype(np.int64))
            held += len(hit)
            if held > most_held:
                found = [closest_forests(np.concatenate(found), forests)[:, :3]]
                held = 0
    return closest_forests(np.concatenate(found), forests)


def open_ends(a, b, labels, radius: int, most_rows: int, block: int = 256):
    """(part, rows, others): the ends of all pairs at most `radius` apart with different labels.

    a and b as in tile_pair_forest; labels are a's, then b's. A part has at most `most_rows`
    rows a side (a block at least); others is empty if its rows are to be held against each other.
    """
    import numpy as np

    many = max(1, most_rows // block)
    parts: dict[tuple[int, int], tuple[list, list]] = {}
    for i, j, rows, others, distance in near_blocks(a, b, radius, block):
        hit = distance <= radius
        if not hit.any():
            continue
        hit &= labels[rows][:, None] != labels[others][None, :]
        if hit.any():
            left, right = parts.setdefault((i // many, j // many), ([], []))
            left.append(rows[hit.any(axis=1)])
            right.append(others[hit.any(axis=0)])
    for (i, j), (left, right) in parts.items():
        if b is None and i == j:
            left, right = left + right, [np.empty(0, np.int64)]
        yield i << 20 | j, np.unique(np.concatenate(left)), np.unique(np.concatenate(right))


def alike_pairs(prints, labels, split: int, sets: list[bytes], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets that join all labels that such links can join.

    All pairs of different labels and at most `radius` apart are held against the sets, but
    those that earlier links have joined: rows before `split` with rows from it on, or
    all with each other if no rows are before it.
    """
    import numpy as np

    group = np.unique(labels, return_inverse=True)[1]
    sizes = np.array([len(x) // 8 for x in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    _, at, times = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True, return_counts=True)
    within = np.concatenate([[0], np.cumsum(times[at] > 1)])
    shared = within[starts[1:]] - within[starts[:-1]]  # of hashes that no other row has, no pair has any in common
    marked = np.zeros(len(times), bool)
    out = []
    for i in range(split or len(sets)):
        low = split or i + 1
        most = np.minimum(shared[i], shared[low:])
        near = np.bitwise_count(prints[i] ^ prints[low:]).sum(axis=1) <= radius
        j = low + np.flatnonzero(near & (group[low:] != group[i]) & (most / np.maximum(1, sizes[i] + sizes[low:] - most) >= similarity))
        if not len(j):
            continue
        ends = np.cumsum(sizes[j])
        own = at[starts[i] : starts[i + 1]]
        marked[own] = True
        common = np.concatenate([[0], np.cumsum(marked[at[np.repeat(starts[j] - ends + sizes[j], sizes[j]) + np.arange(ends[-1])]])])
        marked[own] = False
        common = common[ends] - common[ends - sizes[j]]
        for k in j[common / np.maximum(1, sizes[i] + sizes[j] - common) >= similarity].tolist():
            if group[k] != group[i]:
                out.append((i, k))
                group[group == group[k]] = group[i]
    return out


def tile_pairs(prints: DataFrame, radius: int, bits: int, tile_rows: int, level: str | None = None, label: str | None = None) -> tuple[DataFrame, list[int]]:
    """(pair long, tile int, ids, words, labels binary): two rows a pair of tiles to compare, or one for a tile itself; and the tiles' levels."""
    import numpy as np

    names = [f"f{k}" for k in range(bits // 64)]
    ones = sum((F.bit_count(n) for n in names[1:]), F.bit_count(names[0]))
    rows = prints.select(F.col("id").cast("long"), *names, ones.cast("int").alias("ones"), F.col(level).cast("int").alias("level") if level else F.lit(0).alias("level"), *([F.col(label).cast("long").alias("label")] if label else []))
    count_of = {(r["level"], r["ones"]): r["n"] for r in rows.groupBy("level", "ones").agg(F.count("*").alias("n")).collect()}
    # Tiles: neighbouring population counts of a level together up to tile_rows; large ones in several.
    tiles_: list[list[int]] = []  # level, least and greatest population count
    first, several, filled = {}, {}, 0
    for (of, c), n in sorted(count_of.items()):
        if not tiles_ or tiles_[-1][0] != of or filled + n > tile_rows:
            several[of, c] = -(-n // tile_rows)
            first[of, c] = len(tiles_)
            tiles_ += [[of, c, c] for _ in range(several[of, c])]
            filled = n if several[of, c] == 1 else tile_rows
        else:
            several[of, c], first[of, c] = 1, len(tiles_) - 1
            tiles_[-1][2] = c
            filled += n
    tiles_ = tiles_ or [[0, 0, 0]]
    base = min((of for of, _ in count_of), default=0)
    every = [(of, c) for of in range(base, max((of for of, _ in count_of), default=0) + 1) for c in range(bits + 1)]
    at = (F.col("level") - base) * (bits + 1) + F.col("ones")
    array_of = lambda x: F.expr(f"cast(split('{','.join(map(str, x))}', ',') as array<int>)")  # noqa: E731  # a literal
    tile = F.get(array_of([first.get(k, 0) for k in every]), at) + F.pmod(F.xxhash64("id", *names), F.get(array_of([several.get(k, 1) for k in every]), at)).cast("int")

    def packed(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy().astype("<i8")
        words = np.stack([table.column(n).to_numpy() for n in names], axis=1).astype("<i8")
        return pa.table({"tile": table.column("tile").slice(0, 1), "ids": pa.array([ids.tobytes()], pa.binary()), "words": pa.array([words.tobytes()], pa.binary()), "labels": pa.array([table.column("label").to_numpy().astype("<i8").tobytes() if label else b""], pa.binary())})

    # A tile is packed in pieces, by tasks of their own, and put together where it is compared.
    piece = F.pmod(F.xxhash64(F.lit("piece"), "id", *names), F.lit(-(-tile_rows // PIECE_ROWS))).cast("int")
    tiles = rows.select("id", *names, *(["label"] if label else []), tile.alias("tile"), piece.alias("piece")).groupBy("tile", "piece").applyInArrow(packed, "tile int, ids binary, words binary, labels binary")
    tiles = stored(tiles, "tiles")
    levels, lows, highs = (array_of([t[k] for t in tiles_]) for k in range(3))
    mine = F.col("tile")
    other = F.filter(
        F.sequence(F.lit(0), F.lit(len(tiles_) - 1)),
        lambda t: (F.abs(F.get(levels, t) - F.get(levels, mine)) <= 1) & (F.get(lows, t) - F.get(highs, mine) <= radius) & (F.get(lows, mine) - F.get(highs, t) <= radius),
    )
    sides = tiles.select("tile", "ids", "words", "labels", F.explode(other).alias("other"))
    sides = sides.select((F.least("tile", "other").cast("long") * len(tiles_) + F.greatest("tile", "other")).alias("pair"), "tile", "ids", "words", "labels")
    parts = min(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(tiles_) * (len(tiles_) + 1) // 2)
    return sides.repartition(parts, "pair"), [t[0] for t in tiles_]


def unpacked(table: pa.Table, width: int):
    """Of a pair of tiles: the ids of both, a list of each one's fingerprints, and the labels of both."""
    import numpy as np

    table = table.sort_by("tile")
    ids, labels = (np.concatenate([np.frombuffer(x, "<i8") for x in table.column(n).to_pylist()]) for n in ("ids", "labels"))
    of, words = table.column("tile").to_pylist(), table.column("words").to_pylist()
    tiles = [np.concatenate([np.frombuffer(x, "<u8").reshape(-1, width) for t, x in zip(of, words) if t == tile]) for tile in sorted(set(of))]
    return ids, [*tiles, None][:2], labels


def links(prints: DataFrame, radius: int, bits: int = 64, tile_rows: int = 32_768, level: str | None = None) -> DataFrame:
    """(u long, v long, distance int) between ids of `prints` (id, f0, ...), one row per id.

    Spanning forests of the links of each pair of tiles. level names an integer column:
    only rows of the same or neighbouring levels are linked then.
    """
    import numpy as np

    sides, _ = tile_pairs(prints, radius, bits, tile_rows, level)

    def compared(table: pa.Table) -> pa.Table:
        ids, words, _ = unpacked(table, bits // 64)
        found = np.array(tile_pair_forest(*words, radius), np.int64)
        return pa.table({"u": ids[found[:, 0]], "v": ids[found[:, 1]], "distance": found[:, 2].astype(np.int32)})

    return sides.groupBy("pair").applyInArrow(compared, "u long, v long, distance int")


def open_links(prints: DataFrame, sets: DataFrame, radius: int, bits: int, tile_rows: int, similarity: float, most_rows) -> DataFrame:
    """(u long, v long): links of similar sets that join all components (label) that links within the radius can join.

    prints: (id, f0, ..., level, label); sets: (node, shingles), of all ends of links at least.
    most_rows gives the rows a side, by level, that are held against each other in one task.
    """
    import numpy as np

    sides, levels = tile_pairs(prints, radius, bits, tile_rows, "level", "label")
    room = [most_rows(n) for n in levels]
    width = bits // 64

    def opened(table: pa.Table) -> pa.Table:
        ids, words, labels = unpacked(table, width)
        both = np.concatenate([w for w in words if w is not None])
        out = [(np.empty(0, np.int64), 0, 0)]
        for part, *ends in open_ends(*words, labels, radius, min(room[t] for t in table.column("tile").to_pylist())):
            out += [(rows, part, side) for side, rows in enumerate(ends)]
        rows = np.concatenate([x[0] for x in out])
        parts, side = (np.repeat([x[k] for x in out], [len(x[0]) for x in out]) for k in (1, 2))
        pair = np.full(len(rows), table.column("pair")[0].as_py())
        return pa.table({"pair": pair, "part": parts, "side": side.astype(np.int32), "end": ids[rows], "label": labels[rows], "print": pa.array([both[r].tobytes() for r in rows], pa.binary())})

    def held(table: pa.Table) -> pa.Table:
        with memory_returned():
            table = table.sort_by([("side", "ascending"), ("end", "ascending")])
            side, ends, labels = (table.column(n).to_numpy() for n in ("side", "end", "label"))
            prints = np.frombuffer(b"".join(table.column("print").to_pylist()), "<u8").reshape(-1, width)
            split = int((side == 0).sum()) % len(side)
            found = np.array(alike_pairs(prints, labels, split, table.column("shingles").to_pylist(), radius, similarity), np.int64).reshape(-1, 2)
            return pa.table({"u": ends[found[:, 0]], "v": ends[found[:, 1]]})

    ends = stored(sides.groupBy("pair").applyInArrow(opened, "pair long, part long, side int, end long, label long, print binary"), "open-ends")
    rows = sets.join(bounded(ends), F.col("node") == F.col("end")).drop("node")
    out = stored(rows.groupBy("pair", "part").applyInArrow(held, "u long, v long"), "proven-links")
    forget(ends)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 64, radius: int = 3, tile_rows: int = 32_768) -> DataFrame:
    """(id_col, f0 ..., component_id): documents whose fingerprints chain at most `radius` apart.

    component_id is the smallest id reachable, its own included.
    """
    prints = fingerprints(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col)), "id", text_col, words, bits)
    out = grouped(stored(prints, "fingerprints"), lambda nodes: links(nodes, radius, bits, tile_rows), [f"f{k}" for k in range(bits // 64)])
    return out.withColumnRenamed("id", id_col)


def numbered(prints: DataFrame, names: list[str], *more) -> DataFrame:
    """A table of the different rows of prints (id, names ...): id, names, least id, times and more aggregates. The id is a number of its own."""
    rows = prints.groupBy(*names).agg(F.min("id").alias("least"), F.count("*").alias("times"), *more)
    return stored(rows.select(F.monotonically_increasing_id().alias("id"), *rows.columns), "distinct-prints")


def grouped(prints: DataFrame, edges_of, names: list[str], nodes: DataFrame | None = None) -> DataFrame:
    """(id, names ..., component_id) for stored prints (id, names ...): rows equal in names are one node (of numbered()); edges_of: links between nodes."""
    if nodes is None:
        nodes = numbered(prints, names)
    found = components(edges_of(nodes.select(*names, "id")))
    labels = nodes.join(found, nodes["id"] == found["node"], "left").select(*names, "least", "times", F.coalesce("component", "id").alias("component"))
    sizes = labels.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members")).withColumnRenamed("component", "c")
    labels = joined_by_key(labels, sizes, {"c": "component"}, "members", nodes.count())
    labels = labels.select(*(F.col(n).alias(f"_{n}") for n in names), "component_id", "times")
    # documents of one fingerprint may be most of all
    return joined_by_key(prints, labels, {f"_{n}": n for n in names}, "times", prints.count()).select("id", *names, "component_id")


def radius_for(similarity: float, bits: int, deviations: float = 4.0) -> int:
    """The distance that fingerprints of sets of this Jaccard similarity seldom exceed."""
    turned = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(bits * turned + deviations * math.sqrt(bits * turned * (1 - turned)))


def most_exact(similarity: float) -> int:
    """The most shingles of sets of which no two are as similar as this, unless one is the other and one shingle more."""
    n = 1
    while n / (n + 2) < similarity and n < 16:
        n += 1
    return n


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 128, tile_rows: int = 32_768) -> DataFrame:
    """(id_col, component_id): documents chained by Jaccard similarities of their shingle sets.

    Ids can be of any type that has an order, and are unique but for repeated rows; component_id is
    the smallest of a component. Only documents of equal sets count as alike unproven. The
    candidate links of the forests are held against the sets, then all candidate links that
    would still join two components. Sets of few shingles (most_exact) need no candidates:
    those that are another set less one shingle are joined by their hashes.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = [f"f{k}" for k in range(bits // 64)]
    prints = fingerprints(docs, "id", "text", words, bits, sizes=most_exact(similarity))
    step = max(-math.log(similarity), 1e-6) * (1 + 1e-9)  # sets of this similarity are one level apart at most
    prints = stored(prints.withColumn("level", F.floor(F.log(F.greatest("n_shingles", F.lit(1))) / step).cast("int")), "fingerprints")
    keys = [*names, "set_hash"]
    first = numbered(prints, keys, F.first("level").alias("level"), F.first("less_one").alias("less_one"))  # equal sets have equal ones
    radius = radius_for(similarity, bits)
    edges = stored(links(first, radius, bits, tile_rows, "level").select("u", "v").distinct(), "candidate-links")
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))).distinct()
    wanted = stored(ends.join(first, ends["node"] == first["id"]).select("node", F.col("least").alias("wanted")), "linked-documents")
    sets = shingle_sets(docs.join(bounded(wanted), F.col("id") == F.col("wanted")).select("node", "text").dropDuplicates(["node"]), "node", "text", words)
    sets = stored(sets, "shingle-sets")
    left, right = (sets.select(F.col("node").alias(f"n{k}"), F.col("shingles").alias(f"s{k}")) for k in "ab")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = [jaccard(a.as_py(), b.as_py()) >= similarity for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["u", "v"]).filter(pa.array(alike, pa.bool_()))

    both = edges.join(left, F.col("u") == F.col("na")).join(right, F.col("v") == F.col("nb")).select("u", "v", "sa", "sb")
    short = first.select(F.col("id").alias("u"), F.explode("less_one").alias("less"), F.size("less_one").alias("n")).where((F.col("n") - 1) / F.greatest("n", F.lit(1)) >= similarity)
    wholes = first.where(F.col("level") <= F.floor(F.log(F.lit(most_exact(similarity))) / step)).select(F.col("id").alias("v"), "set_hash")
    short = stored(short.join(wholes, F.col("less") == F.col("set_hash")).select("u", "v"), "short-links")
    proven = stored(both.mapInArrow(compared, "u long, v long").unionByName(short), "proven-links")
    labels = stored(components(proven), "labels")
    forget(proven)
    labelled = first.join(labels, first["id"] == labels["node"], "left").select("id", *names, "level", F.coalesce("component", "id").alias("label"))
    rest = open_links(labelled, sets, radius, bits, tile_rows, similarity, lambda n: math.ceil(2_000_000 / math.exp((n + 1) * step)))
    forget(edges, wanted, sets, short)
    good = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest)
    return grouped(prints, lambda _: good, keys, first).select(F.col("id").alias(id_col), "component_id")


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets of sorted 64-bit integers; of two empty ones, 1."""
    import numpy as np

    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common) if len(x) or len(y) else 1.0


def shingle_sets(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id_col, shingles binary): the hashes of a text's different shingles, sorted."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            found = []
            for text in batch.column(1):
                different = set(word_shingles(text.as_py(), words))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, different), np.uint64, len(different))
                found.append(np.unique(hashes).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=[id_col, "shingles"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, shingles binary")
