"""Operators over flat findings (file_id, ord, entity_type, start, end, confidence, tier, validated)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


def literal_map(values: dict, kind: str) -> Column:
    """A map literal of a job's settings; an empty one keeps its type."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.create_map(*pairs).cast(f"map<string,{kind}>") if pairs else F.expr(f"cast(map() as map<string,{kind}>)")


def threshold_for(entity_type: Column, default: float, by_type: dict[str, float]) -> Column:
    own = {k.upper(): float(v) for k, v in by_type.items()}
    return F.coalesce(F.try_element_at(literal_map(own, "double"), F.upper(entity_type)), F.lit(float(default)))


def at_threshold(findings: DataFrame, default: float = 0.5, by_type: dict[str, float] | None = None) -> DataFrame:
    """The findings whose confidence reaches their type's threshold."""
    return findings.where(F.col("confidence") >= threshold_for(F.col("entity_type"), default, by_type or {}))


def resolved(findings: DataFrame, id_col: str = "file_id") -> DataFrame:
    """Disjoint spans: runs of overlapping findings become one, of the first and outermost one's type.

    Findings that only touch stay apart. A run's confidence is its greatest; it is
    validated if any part is.
    """
    order = Window.partitionBy(id_col).orderBy("start", F.desc("end"), "ord")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    runs = findings.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.struct("start", (-F.col("end")).alias("e"), "ord", "entity_type", "tier")
    grouped = runs.groupBy(id_col, "_run").agg(
        F.min(head).alias("head"), F.min("start").alias("start"), F.max("end").alias("end"), F.max("confidence").alias("confidence"), F.bool_or("validated").alias("validated")
    )
    return grouped.select(id_col, F.col("head.entity_type").alias("entity_type"), "start", "end", "confidence", F.col("head.tier").alias("tier"), "validated")


def with_new_offsets(plan: DataFrame, id_col: str = "file_id") -> DataFrame:
    """new_start and new_end of each replacement in the masked text."""
    before = Window.partitionBy(id_col).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.length("replacement") - (F.col("end") - F.col("start"))).over(before), F.lit(0))
    out = plan.withColumn("new_start", (F.col("start") + moved).cast("int"))
    return out.withColumn("new_end", F.col("new_start") + F.length("replacement"))


def checked(plan: DataFrame, id_col: str = "file_id") -> DataFrame:
    """The plan, or an error where two of its spans overlap."""
    following = F.lead("start").over(Window.partitionBy(id_col).orderBy("start"))
    # each row says itself whether it breaks the rule, so no optimiser can drop the check
    return plan.withColumn("end", F.when(following < F.col("end"), F.raise_error(F.lit("spans of a plan must not overlap")).cast("int")).otherwise(F.col("end")))


def surfaces(documents: DataFrame, spans: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """spans with `surface`, the text each covers. Texts meet lists of offsets, never single spans.

    Raises where a span ends behind its text, or has no text.
    """
    rest = [c for c in spans.columns if c not in (id_col, "start")]
    lists = spans.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", *rest))).alias("_spans"))
    joined = lists.join(documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), F.col(id_col) == F.col("_id"), "left")
    cut = joined.select(id_col, "_spans", _cut(F.col("_text"), F.col("_spans.start"), F.col("_spans.end")).alias("_surfaces"))
    both = cut.select(id_col, F.explode(F.arrays_zip("_spans", "_surfaces")).alias("_z"))
    return both.select(id_col, *(F.col(f"_z._spans.{c}").alias(c) for c in spans.columns if c != id_col), F.col("_z._surfaces").alias("surface"))


@F.arrow_udf(ArrayType(StringType()))
def _cut(text: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for t, s, e in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        if e and (t is None or max(e) > len(t)):
            raise ValueError("a span ends behind its text: offsets do not match the canonical text")
        out.append([t[a:b] for a, b in zip(s, e)])
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(StringType())
def replaced(text: pa.Array, starts: pa.Array, ends: pa.Array, replacements: pa.Array) -> pa.Array:
    """Texts with their spans replaced, in one pass over each."""
    out = []
    for t, s, e, r in zip(text.to_pylist(), starts.to_pylist(), ends.to_pylist(), replacements.to_pylist()):
        if t is None or not s:
            out.append(t)
            continue
        if e[-1] > len(t):
            raise ValueError("a span ends behind its text: offsets do not match the canonical text")
        parts = [t[: s[0]]]
        for new, a, b in zip(r, e, [*s[1:], len(t)]):
            parts += (new, t[a:b])
        out.append("".join(parts))
    return pa.array(out, pa.string())


replaced = replaced.asNondeterministic()  # so no optimiser writes a text twice


def applied(documents: DataFrame, plan: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(id_col, masked_text) of all documents, those without spans as they are."""
    lists = plan.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_plan")).withColumnRenamed(id_col, "_id")
    joined = documents.join(lists, F.col(id_col) == F.col("_id"), "left")
    masked = replaced(F.col(text_col), F.col("_plan.start"), F.col("_plan.end"), F.col("_plan.replacement"))
    return joined.select(id_col, masked.alias("masked_text"))


def applied_natively(text: Column, plan: Column) -> Column:
    """The same in column expressions, for short lists: plan is a sorted array of (start, end, replacement)."""
    pieces = F.transform(plan, lambda r, i: F.concat(F.substring(text, F.coalesce(F.get(plan, i - 1)["end"], F.lit(0)) + 1, r["start"] - F.coalesce(F.get(plan, i - 1)["end"], F.lit(0))), r["replacement"]))
    last = F.coalesce(F.get(plan, F.size(plan) - 1)["end"], F.lit(0))
    return F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))
