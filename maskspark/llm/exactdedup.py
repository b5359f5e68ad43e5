"""Exact deduplication in DataFrame operations alone, safe for groups of any size.

Texts are equal when they are the same after all ASCII white space is deleted. The
whole normalised text, with its digest before it, is the key of every stage:
1. each task combines its own copies before anything is shuffled (a partial aggregate);
2. what is left, one copy of a text from each task, is merged by (digest, text, salt), so copies
   that many tasks hold meet in `salts` tasks rather than one; the salt is the task's;
3. the winners of the salts, at most `salts` a text, are merged by (digest, text).
A group's result goes back to its documents by the digest alone, which moves no text;
digests of very many documents are broadcast, so these stay where they are. If
two texts share a digest, the documents of that digest are merged and joined by their
whole texts.

Of a group, the row with the most code points in its original text stays; of those the
one with the smallest id. A null text counts as empty. A null id comes after all others
of the same length. Of rows that share an id, those as long as the longest are all marked
kept; without_copies() leaves one row of them, that of the least text, and of rows that
share the text too any one. deduplicate() ignores other columns, without_copies() returns
them, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, joined_by_key, plain_columns, stored

WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for c in WHITE_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _documents(df: DataFrame, id_col: str, text_col: str, digest_bits: int) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = df.select(F.col(id_col).cast("long").alias("id"), normalised(text).alias("norm"), F.length(text).alias("n_chars"))
    docs = docs.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    # One number orders the rows of a group: code points, then the smallest id. Its type
    # has a fixed width, so the aggregates hash and needn't sort whole texts.
    order = F.expr("cast(n_chars as decimal(10,0)) * 100000000000000000000 + coalesce(9223372036854775808 - id, 0)")
    return docs.select("id", "norm", "sha", F.expr(f"substring(sha, 1, {digest_bits // 8})").alias("digest"), order.cast("decimal(38,0)").alias("best"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest_bits: int = 256) -> DataFrame:
    """A row per row of df: id_col, keep_id, group_size long, kept boolean, text_sha256.

    The id must be an integer. digest_bits below 256 shortens the digest that parts the
    work, which changes no result (it is for tests of digests that clash).
    """
    docs = _documents(df, id_col, text_col, digest_bits)
    salt = F.pmod(F.spark_partition_id(), F.lit(salts))
    groups = (
        docs.select("digest", "norm", salt.alias("salt"), "best")
        .groupBy("digest", "norm", "salt").agg(F.max("best").alias("best"), F.count("*").alias("n"))
        .repartition("digest")  # serves both of the next two
        .groupBy("digest", "norm").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
        .groupBy("digest").agg(F.max("best").alias("best"), F.max("n").alias("n"), F.count("*").alias("texts"))
    )
    groups = stored(groups.withColumnRenamed("digest", "of"), "exact-groups")
    single = groups.where("texts = 1").select("of", F.col("best").alias("most"), "n")
    total, clashes = groups.agg(F.sum("n"), F.max("texts")).head()
    found = joined_by_key(docs.select("id", "sha", "digest", "best"), single, {"of": "digest"}, "n", total or 0).select("id", "sha", "best", "most", "n")
    if clashes and clashes > 1:
        clashing = docs.join(groups.where("texts > 1"), F.col("digest") == F.col("of"), "left_semi")
        by_text = clashing.groupBy("digest", "norm").agg(F.max("best").alias("most"), F.count("*").alias("n"))
        found = found.unionByName(clashing.join(by_text, ["digest", "norm"]).select("id", "sha", "best", "most", "n"))
    rest = F.expr("most % 100000000000000000000")
    keep = F.when(rest > 0, F.expr("cast(9223372036854775808 - most % 100000000000000000000 as long)"))
    kept = F.col("best") == F.col("most")
    return found.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def without_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of df that stay, with all their columns; of rows alike in id, one."""
    rows, column = plain_columns(df)
    found = deduplicate(rows.select(F.col(column[id_col]).alias("id"), F.col(column[text_col]).alias("text")), "id", "text", salts)
    found = stored(found.select("id", F.unhex("text_sha256").alias("sha"), "kept"), "exact-kept")
    ids = stored(found.groupBy("id").agg(F.count("*").alias("times"), F.bool_or("kept").alias("kept")), "exact-ids")
    keys = lambda i: [F.coalesce(i.cast("long"), F.lit(0)), i.isNull()]  # noqa: E731  # without nulls
    named = lambda letter, i: [k.alias(f"{letter}{n}") for n, k in enumerate(keys(i))]
    same = lambda n: [F.col(f"r{k}") == F.col(f"k{k}") for k in range(n)]
    own = rows.select("*", *named("r", F.col(column[id_col])))
    # Rows of ids that stand once stay or go by their id; others are looked at by their texts.
    gone = ids.where("times > 1 or not kept").select(*named("k", F.col("id")))
    first = own.join(bounded(gone), same(2), "left_anti")
    again = ids.where("times > 1").select(*named("k", F.col("id")))
    if again.head(1):
        text = F.coalesce(F.col(column[text_col]).cast("string"), F.lit(""))
        kept = found.where("kept").select(*named("k", F.col("id")), F.col("sha").alias("k2")).distinct()
        many = own.join(bounded(again), same(2), "left_semi").withColumn("r2", F.unhex(F.sha2(normalised(text), 256)))
        order = Window.partitionBy("r0", "r1", "r2").orderBy(F.length(text).desc(), text)
        many = many.join(kept, same(3), "left_semi").withColumn("place", F.row_number().over(order)).where("place = 1")
        first = first.unionByName(many.select(*first.columns))
    return first.select(*(F.col(c).alias(name) for name, c in column.items()))
