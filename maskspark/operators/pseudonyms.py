"""Consistent pseudonyms: keyed digests cut short, longer where two identities would clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskspark.functions import canonical as C
from maskspark.functions.crypto import hmac_sha256, key_table

STEP, FULL = 4, 64
REGISTRY = "entity_class string, prefix string, digest string, token_length int"


def with_digest(df: DataFrame, salt: bytes, entity_type: Column, canonical: Column, name: str = "digest") -> DataFrame:
    """df with the full digest of version, class and canonical form, and its `entity_class`."""
    message = F.concat_ws("|", F.lit(C.VERSION), C.entity_class(entity_type), canonical)
    key = key_table(df.sparkSession, salt).withColumn("_one", F.lit(1))
    joined = df.withColumn("_1", F.lit(1)).join(F.broadcast(key), F.col("_1") == F.col("_one"))
    out = joined.withColumns({name: hmac_sha256(message, F.col("inner_pad"), F.col("outer_pad")), "entity_class": C.entity_class(entity_type)})
    return out.drop("_1", "_one", "inner_pad", "outer_pad")


def token_lengths(identities: DataFrame, length: int = 8, registry: DataFrame | None = None) -> DataFrame:
    """Registry rows (entity_class, prefix, digest, token_length), one for each identity.

    identities: (entity_class, digest, first_seen), one row each. A prefix belongs to the
    identity the registry names, else to the one seen first; others take longer ones.
    """
    left = identities.select("entity_class", "digest", "first_seen")
    settled = None
    while True:
        tried = left.withColumn("prefix", F.substring("digest", 1, length))
        order = Window.partitionBy("entity_class", "prefix").orderBy("first_seen", "digest")
        if registry is not None:
            owners = registry.select(F.col("entity_class").alias("_c"), F.col("prefix").alias("_p"), F.col("digest").alias("_owner"))
            tried = tried.join(owners, (F.col("entity_class") == F.col("_c")) & (F.col("prefix") == F.col("_p")), "left")
            mine = F.when(F.col("_owner").isNotNull(), F.col("_owner") == F.col("digest"))
        else:
            mine = F.lit(None).cast("boolean")
        tried = tried.withColumn("_mine", F.coalesce(mine, F.row_number().over(order) == 1))
        done = tried.where("_mine").select("entity_class", "prefix", "digest", F.lit(min(length, FULL)).alias("token_length"))
        settled = done if settled is None else settled.unionByName(done)
        left = tried.where(~F.col("_mine")).select("entity_class", "digest", "first_seen")
        if length >= FULL or left.isEmpty():
            return settled
        length += STEP


def identities_of(df: DataFrame, id_col: str = "file_id") -> DataFrame:
    """One row for each identity of rows with entity_class and digest, with where it is seen first."""
    return df.groupBy("entity_class", "digest").agg(F.min(F.struct(F.col(id_col).cast("string").alias("id"), "start")).alias("first_seen"))


def registry_of(plan: DataFrame) -> DataFrame:
    """Registry rows of the pseudonyms of a plan (planned())."""
    owned = plan.where("strategy = 'hmac_pseudonym'").select("entity_class", F.expr("substring(digest, 1, token_length)").alias("prefix"), "digest", "token_length")
    return owned.dropDuplicates(["entity_class", "prefix"])


def merged_registry(old: DataFrame, new: DataFrame) -> DataFrame:
    """The registry with new rows; whoever owns a prefix keeps it."""
    return old.unionByName(new.join(old.select("entity_class", "prefix"), ["entity_class", "prefix"], "left_anti").select(*old.columns))
