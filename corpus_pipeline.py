"""A corpus pipeline of four stages: language, exact copies, near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read back as the next stage's docs. All but the last return the columns they
were given, whatever their names.

Edge cases, in all stages: no rows give no rows; null ids are ids like others, null languages
and sources are kept; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskspark.llm import exactdedup, langid, packing, simhash
from maskspark.llm.common import bounded, delete_path, new_path, plain_columns, stored

#: Below this probability a text's language counts as unknown, like that of one without letters.
LEAST_LANGUAGE_SCORE = 0.3


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised by a network learned from their labels.

    A null text, and one without a letter, has no language and goes; repeated rows all stay.
    """
    plain, column = plain_columns(docs)
    net = langid.fit(plain, column["doc_id"], column["text"], column["lang"])
    rest = tuple(c for c in plain.columns if c != column["doc_id"])
    found = langid.predict(plain, net, column["doc_id"], column["text"], keep=rest)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*(F.col(c).alias(name) for name, c in column.items()))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space: the longest, then the smallest doc_id.

    A null text is equal to an empty one; of rows that repeat an id, one stays.
    """
    return exactdedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the smallest doc_id; of rows that repeat it, one.

    Null and empty texts are alike, a null doc_id is the largest. Of rows of one doc_id whose texts
    are alike but not equal, the one with the smallest digest of its text stays.
    """
    plain, column = plain_columns(docs)
    doc_id, text = F.col(column["doc_id"]).cast("long"), F.col(column["text"]).cast("string")
    # The order in which they stay; rows equal in all of it have one id and one text.
    key = F.struct(F.coalesce(doc_id, F.lit((1 << 63) - 1)).alias("id"), doc_id.isNull().alias("none"), F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("digest"))
    keyed = plain.withColumn("key", key)
    groups = simhash.similar_documents(keyed, "key", column["text"])
    keys = stored(groups.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("times"), F.first(F.col("component_id") == F.col("key")).alias("first")), "near-keys")
    # Few rows go, and few are repeated: the others stay where they are.
    gone, again = keys.where("times > 1 or not first").select("of"), keys.where("times > 1 and first").select("of")
    first = keyed.join(bounded(gone), keyed["key"] == gone["of"], "left_anti")
    if again.head(1):
        first = first.unionByName(keyed.join(bounded(again), keyed["key"] == again["of"], "left_semi").dropDuplicates(["key"]))
    return first.select(*(F.col(c).alias(name) for name, c in column.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' token ids in windows of 256 to 2048 tokens.

    A null text is packed as an empty one, its end id alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack),
]

#: Networks, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read back."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            delete_path(spark, before)
        before = path
    return docs
