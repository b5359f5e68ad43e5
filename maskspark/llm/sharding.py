"""A uniform shuffle into shards of exact sizes, by a communication matrix.

Rows lie in source partitions (by a hash of id, text and place). How many rows each source
partition sends to each shard is drawn from the multivariate hypergeometric law, given
the partitions' counts and the shards' exact sizes; it is the law of those counts in a
uniform random permutation. Each partition is permuted by random keys and cut by its
row of the matrix; the rows move to their shards; each shard is permuted again, by new
keys. Keys are hashes of the seed, the id, the text and the row's place in its file, so rows that
repeat are spread like others, and a rerun after a lost executor gives the same shuffle.
What isn't read straight from Parquet files is written to some first; rows that change while
they are read are found out and raise.

The driver holds one count per source partition and the matrix: at most `most_sources`
by `shards` numbers, whatever the data's size. A shard is permuted in bins of about
`bin_rows` rows, by ranges of the random key, so no task holds a whole shard.

Edge cases: null ids and null texts are rows like others; repeated rows and ids get a
place each; all columns of df pass through, whatever their names, but a column shard or slot
gives way to the new one; no rows give no rows; with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import placed, plain_columns


def hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """How many of `draws` taken from good + bad without replacement are good."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws))
    # Too many for numpy: walk out from the mode, with the ratios of neighbouring terms.
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = math.exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    up, down, at_up, at_down = p, p, mode, mode
    left = float(rng.random()) - p
    while left > 0 and (at_up < high or at_down > low):
        if at_up < high:
            up *= (good - at_up) / (at_up + 1) * (draws - at_up) / (bad - draws + at_up + 1)
            at_up, left = at_up + 1, left - up
            if left <= 0:
                return at_up
        if at_down > low:
            down *= at_down / (good - at_down + 1) * (bad - draws + at_down) / (draws - at_down + 1)
            at_down, left = at_down - 1, left - down
            if left <= 0:
                return at_down
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each source to each shard; shard sizes differ by one at most."""
    import numpy as np

    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        row, left = [], sum(room)
        for s in range(shards):
            left -= room[s]
            row.append(hypergeometric(rng, room[s], left, n) if n else 0)
            n -= row[-1]
        room = [a - b for a, b in zip(room, row)]
        matrix.append(row)
    return matrix


def shuffled_shards(df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, source_rows: int = 8_192, most_sources: int = 8_192, bin_rows: int = 65_536) -> DataFrame:
    """df with `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 in each shard)."""
    spark = df.sparkSession
    plain, column = plain_columns(df.drop("shard", "slot"))
    parts = [F.col(column[c]) for c in (id_col, text_col) if c in column]
    rows = placed(plain, "_place")

    def key(n: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + n), *parts, F.col("_place"))

    total = rows.count()
    sources = max(1, min(most_sources, -(-total // source_rows)))
    rows = rows.withColumns({"_source": F.pmod(key(0), F.lit(sources)).cast("int"), "_local": key(1), "_key": key(2)})
    count_of = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([count_of.get(s, 0) for s in range(sources)], shards, seed)
    cuts = spark.range(1).select(F.from_json(F.lit(json.dumps(matrix)), "array<array<bigint>>").alias("m")).select(F.posexplode("m").alias("_from", "_cuts"))
    # cumulative: a row's shard is the number of cuts at or below its rank in its source
    cuts = cuts.select("_from", F.expr("transform(sequence(1, size(_cuts)), i -> aggregate(slice(_cuts, 1, i), 0L, (a, x) -> a + x))").alias("_cuts"))
    rank = F.row_number().over(Window.partitionBy("_source").orderBy("_local", "_place")) - 1
    sent = rows.withColumn("_rank", rank).join(F.broadcast(cuts), F.col("_source") == F.col("_from"))
    shard = F.expr("size(filter(_cuts, c -> c <= _rank))")
    other = F.raise_error(F.lit("the rows have changed while they were read")).cast("int")
    sent = sent.withColumn("_shard", F.when(shard < shards, shard).otherwise(other)).drop("_rank", "_from", "_cuts", "_source", "_local")
    bins = max(1, -(-total // (shards * bin_rows)))
    sent = sent.withColumn("_bin", F.shiftrightunsigned(F.shiftrightunsigned("_key", 40) * F.lit(bins), 24))
    sizes = sent.groupBy("_shard", "_bin").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_shard").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select(F.col("_shard").alias("_s"), F.col("_bin").alias("_b"), before.alias("_base"))
    within = F.row_number().over(Window.partitionBy("_shard", "_bin").orderBy("_key", "_place")) - 1
    out = sent.withColumn("_within", within).join(bases, (F.col("_shard") == F.col("_s")) & (F.col("_bin") == F.col("_b")))
    return out.select(*(F.col(c).alias(name) for name, c in column.items()), F.col("_shard").alias("shard"), (F.col("_base") + F.col("_within")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """One folder per shard, its rows in the order of their slots, in files by ranges of the slot."""
    shuffled_shards(df, **options).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
