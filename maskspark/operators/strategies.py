"""Replacements for spans: a policy's strategy for each, as columns over all spans at once."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskspark.functions import canonical as C
from maskspark.functions import checkdigits, crypto, dates
from maskspark.plans.policy import Job, Policy

# The vocabulary of placeholders.
TOKEN_NAMES = {"PERSON": "NAME", "ORGANIZATION": "ORG", "LOCATION": "LOC", "ADDRESS": "ADDR"}
NEVER_INDEXED = ("MEDICATION", "DIAGNOSIS", "TREATMENT", "PROCEDURE")
DATES = ("DATE", "DOB", "DATE_OF_BIRTH")
POSTCODES = ("ZIP", "PIN", "PINCODE", "POSTAL_CODE", "ZIPCODE")
MOST_SHIFT = 365


def policy_table(spark: SparkSession, policy: Policy, job: Job) -> DataFrame:
    """The job's row for each type: kind, strategy (overridden where the job says so), indexed, token, bracket."""
    entries = policy.of(job.target)
    rows = []
    for kind in sorted({*entries, *job.strategy_overrides}):
        e = policy.lookup(job.target, kind)
        rows.append((kind, job.strategy_overrides.get(kind, e.strategy), e.indexed, e.token, bool(e.params.get("bracket_5y", True))))
    return spark.createDataFrame(rows, "kind string, strategy string, indexed boolean, token string, bracket boolean")


def with_policy(spans: DataFrame, table: DataFrame, target: str) -> DataFrame:
    """spans with strategy, indexed, token and bracket; a type without a row is suppressed."""
    joined = spans.join(F.broadcast(table), F.upper("entity_type") == F.col("kind"), "left")  # at most a row per type
    strategy = F.coalesce("strategy", F.lit("suppress"))
    if target == "training":
        strategy = F.when(strategy.isin("hmac_pseudonym", "fpe"), F.raise_error(F.lit("a linkable strategy in training")).cast("string")).otherwise(strategy)
    name = F.coalesce(F.upper("token"), *(F.when(F.upper("entity_type") == k, v) for k, v in TOKEN_NAMES.items()), F.upper("entity_type"))
    return joined.select(*spans.columns, strategy.alias("strategy"), F.coalesce("indexed", F.lit(True)).alias("indexed"), name.alias("token"), F.coalesce("bracket", F.lit(True)).alias("bracket"))


def placeholders(spans: DataFrame, canonical: Column, id_col: str = "file_id") -> DataFrame:
    """spans with `placeholder`: <TOKEN>, or <TOKEN_n> by order of first appearance in the document."""
    numbered = (F.col("strategy") == "placeholder_indexed") & F.col("indexed") & ~F.upper("entity_type").isin(*NEVER_INDEXED)
    rows = spans.withColumns({"_numbered": numbered, "_class": C.entity_class(F.col("entity_type")), "_canonical": F.when(numbered, canonical)})
    own = [id_col, "_numbered", "token"]
    rows = rows.withColumn("_first", F.min("start").over(Window.partitionBy(*own, "_class", "_canonical")))
    number = F.dense_rank().over(Window.partitionBy(*own).orderBy("_first"))
    label = F.when(F.col("_numbered"), F.concat(F.lit("<"), "token", F.lit("_"), number.cast("string"), F.lit(">"))).otherwise(F.concat(F.lit("<"), "token", F.lit(">")))
    return rows.withColumn("placeholder", label).drop("_numbered", "_class", "_canonical", "_first")


def generalized(entity_type: Column, surface: Column, bracket: Column, token: Column, date: Column | None = None) -> Column:
    """Dates to years, postcodes to three digits, ages to brackets; others to a bare token.

    date: the surface parsed (dates.parsed), if it is there already.
    """
    date = dates.parsed(surface) if date is None else date
    kind, digits = F.upper(entity_type), crypto.digits_of(surface)
    age = F.try_to_number(digits, F.lit("9" * 38)).cast("decimal(38,0)")
    low = (F.floor(age / 5) * 5).cast("int")
    ages = (
        F.when(digits == "", "<AGE>").when(age.isNull() | (age > 89), "90+")
        .when(bracket, F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))).otherwise(age.cast("string"))
    )
    zips = F.when(F.length(digits) >= 4, F.concat(F.substring(digits, 1, 3), F.repeat(F.lit("X"), F.length(digits) - 3))).otherwise("<ZIP>")
    return (
        F.when(kind.isin(*DATES), F.coalesce(F.year(date["date"]).cast("string"), F.lit("<DATE>"))).when(kind.isin(*POSTCODES), zips)
        .when(kind == "AGE", ages).otherwise(F.concat(F.lit("<"), token, F.lit(">")))
    )


def shift_days(document: Column, key: bytes) -> Column:
    """A document's shift: uniform over 1 to 365 days either way, from a key that lives as long as the run.

    With a fresh secret key nobody can find the shift afterwards, and a task that is run
    again draws the same one.
    """

    @F.pandas_udf("int")
    def draw(ids: pd.Series) -> pd.Series:
        def days(x: object) -> int:
            n = int.from_bytes(hmac.new(key, str(x).encode(), hashlib.sha256).digest(), "big") % (2 * MOST_SHIFT)
            return n - MOST_SHIFT if n < MOST_SHIFT else n - MOST_SHIFT + 1

        return ids.map(days)

    return draw(document)


def date_shifted(date: Column, days: Column) -> Column:
    """A parsed date (dates.parsed) moved by days."""
    return F.coalesce(dates.shifted_date(date, days), F.lit("<DATE>"))


def with_fpe(rows: DataFrame, key: bytes | None, tweak: bytes | None, name: str = "fpe") -> DataFrame:
    """rows with the surfaces of fpe spans encrypted in their layout, check digits put right.

    Without a key, or where the number of digits is outside the cipher's domain: a bare token.
    """
    bare = F.concat(F.lit("<"), F.col("token"), F.lit(">"))
    if key is None or tweak is None:
        return rows.withColumn(name, bare)
    surface = F.when(F.col("strategy") == "fpe", F.col("surface"))
    rows = rows.withColumn("_cipher", crypto.fpe_digits(crypto.digits_of(surface), key, tweak))
    right = checkdigits.recompute(F.col("entity_type"), F.col("_cipher"))
    return rows.withColumn("_cipher", right).withColumn(name, F.coalesce(crypto.with_digits(F.col("surface"), F.col("_cipher")), bare)).drop("_cipher")
