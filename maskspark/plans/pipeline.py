"""The masking plan: threshold, overlap resolution, strategies, application, verification."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from maskspark.functions import dates
from maskspark.functions.canonical import VERSION, canonical, type_prefix
from maskspark.operators import pseudonyms, spans, strategies
from maskspark.operators.detect import Detector, find
from maskspark.sources.store import written

from .policy import Job, Policy, PolicyViolation, default_policy

_LEAKS = ArrayType(StructType([StructField("entity_type", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("confidence", DoubleType())]))
VERIFIED, LEAK, UNVERIFIED = "VERIFIED", "LEAK_DETECTED", "UNVERIFIED"


@dataclass(frozen=True)
class Keys:
    """Secrets of a rag job. Plans for training are never given any."""

    salt: bytes | None = None
    fpe_key: bytes | None = None
    fpe_tweak: bytes | None = None

    def __repr__(self) -> str:
        return "Keys(...)"


def outside(detector: Detector):
    """A column of what a detector finds in masked texts, but for what lies inside one replacement."""

    @F.arrow_udf(_LEAKS)
    def found(masked: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        from bisect import bisect_right

        kind = pa.list_(pa.struct([("entity_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))
        out = []
        for text, s, e in zip(masked.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            left = []
            for name, start, end, confidence in detector(text or ""):
                i = bisect_right(s or [], start) - 1
                if i < 0 or end > e[i]:
                    left.append({"entity_type": name, "start": start, "end": end, "confidence": confidence})
            out.append(left)
        return pa.array(out, kind)

    return found.asNondeterministic()  # so no optimiser scans a text twice


def _formed(documents: DataFrame, findings: DataFrame, job: Job, policy: Policy, id_col: str, text_col: str) -> DataFrame:
    """The spans that a plan replaces, with what the policy says of them, their surfaces and canonical forms (_form)."""
    disjoint = spans.resolved(spans.at_threshold(findings, job.confidence_threshold, job.type_thresholds), id_col)
    table = strategies.policy_table(documents.sparkSession, policy, job)
    wanted = strategies.with_policy(disjoint, table, job.target).where("strategy <> 'keep'")
    rows = spans.surfaces(documents, wanted.select(id_col, "start", "end", "entity_type", "strategy", "indexed", "token", "bracket"), id_col, text_col)
    # Forms, and dates in planned(), are columns of their own: used inside larger expressions they would be worked out anew each time.
    return rows.withColumn("_form", canonical(F.col("entity_type"), F.col("surface")))


def owners(documents: DataFrame, findings: DataFrame, job: Job, policy: Policy, keys: Keys, registry: DataFrame | None = None, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """Registry rows of every identity that planned() would name, without its replacements."""
    if job.target == "training" or keys.salt is None:
        raise PolicyViolation("pseudonyms need a rag job and a salt")
    hashed = _formed(documents, findings, job, policy, id_col, text_col).where("strategy = 'hmac_pseudonym'")
    hashed = pseudonyms.with_digest(hashed, keys.salt, F.col("entity_type"), F.col("_form"))
    identities = written(pseudonyms.identities_of(hashed, id_col), "identities")
    return written(pseudonyms.token_lengths(identities, job.pseudonym_len, registry), "registry")


def planned(documents: DataFrame, findings: DataFrame, job: Job, policy: Policy, keys: Keys = Keys(), registry: DataFrame | None = None, shift_key: bytes | None = None, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """A row per replacement: id_col, entity_type, strategy, start, end, surface, replacement, new_start, new_end.

    documents may have a column shift_days, which then sets each document's date shift.
    """
    spark = documents.sparkSession
    training = job.target == "training"
    if training and keys != Keys():
        raise PolicyViolation("a training plan is given no keys")
    used = {job.strategy_overrides.get(kind, policy.lookup(job.target, kind).strategy) for kind in {*policy.of(job.target), *job.strategy_overrides}}
    rows = _formed(documents, findings, job, policy, id_col, text_col)
    kind, surface, token, strategy = (F.col(c) for c in ("entity_type", "surface", "token", "strategy"))
    if used & {"generalize", "date_shift"}:
        dated = (strategy == "date_shift") | (strategy == "generalize") & F.upper(kind).isin(*strategies.DATES)
        rows = rows.withColumn("_date", F.when(dated, dates.parsed(surface)))
    rows = strategies.placeholders(rows, F.col("_form"), id_col)
    choice = F.when(strategy == "placeholder_indexed", F.col("placeholder"))
    if "generalize" in used:
        choice = choice.when(strategy == "generalize", strategies.generalized(kind, surface, F.col("bracket"), token, F.col("_date")))
    if "date_shift" in used:
        if "shift_days" in documents.columns:
            shifts = documents.select(F.col(id_col).alias("_of"), F.col("shift_days").alias("_days"))
            rows = rows.join(shifts, F.col(id_col) == F.col("_of"), "left").drop("_of")
            days = F.col("_days")
        else:
            days = strategies.shift_days(F.col(id_col), shift_key or secrets.token_bytes(32))
        choice = choice.when(strategy == "date_shift", strategies.date_shifted(F.col("_date"), days))
    if not training and "hmac_pseudonym" in used:
        if keys.salt is None:
            raise PolicyViolation("pseudonyms need a salt")
        rows = pseudonyms.with_digest(rows, keys.salt, kind, F.col("_form"))
        hashed = rows.where(strategy == "hmac_pseudonym")
        # Who owns a prefix is known only after all identities are; they (digests, no originals) are written once.
        identities = written(pseudonyms.identities_of(hashed, id_col), "identities")
        owned = pseudonyms.token_lengths(identities, job.pseudonym_len, registry)
        owned = owned.select(F.col("entity_class").alias("_c"), F.col("digest").alias("_d"), "token_length")
        rows = rows.join(owned, (F.col("entity_class") == F.col("_c")) & (F.col("digest") == F.col("_d")) & (strategy == "hmac_pseudonym"), "left")
        choice = choice.when(strategy == "hmac_pseudonym", F.concat(type_prefix(kind), F.lit("_"), F.expr("substring(digest, 1, token_length)")))
    if not training and "fpe" in used:
        in_base = any(e.strategy == "fpe" for e in policy.of(job.target).values())
        key, tweak = (keys.fpe_key, keys.fpe_tweak) if in_base else (None, None)
        rows = strategies.with_fpe(rows, key, tweak, "_fpe")
        choice = choice.when(strategy == "fpe", F.col("_fpe"))
    rows = rows.withColumn("replacement", choice.otherwise(""))
    keep = [id_col, "entity_type", "strategy", "start", "end", "surface", "replacement"]
    keep += [c for c in ("entity_class", "digest", "token_length") if c in rows.columns]
    return spans.with_new_offsets(spans.checked(rows.select(*keep), id_col), id_col)


def mask(documents: DataFrame, findings: DataFrame, job: Job | None = None, policy: Policy | None = None, keys: Keys = Keys(), registry: DataFrame | None = None, verify: bool = True, detector: Detector = find, shift_key: bytes | None = None, honor_overrides: bool = False, redact_quarantined: bool = False, id_col: str = "file_id", text_col: str = "text", plan: DataFrame | None = None) -> DataFrame:
    """Masked documents with their receipts, a row per document.

    documents: (id_col, text); findings: flat, with ord, their order in the message. Columns: id_col,
    masked_text, job_id, mode, policy_version, canonicalizer_version, status, deliverable,
    replacements, leaks. Documents without findings pass through and are verified too. A leak
    is judged by the base policy; with honor_overrides by the job's strategies. The detector gives
    (type, start, end, confidence) of a text (detect.find, http_detector, all_of). With
    redact_quarantined the receipt of a quarantined document has no originals. plan: what planned()
    gave for them, if it is there already.
    """
    job, policy = job or Job(), policy or default_policy()
    # Texts are shuffled once, by their ids; both joins with spans read that.
    documents = documents.select(id_col, text_col, *(c for c in ("shift_days",) if c in documents.columns)).repartition(F.col(id_col))
    plan = planned(documents, findings, job, policy, keys, registry, shift_key, id_col, text_col) if plan is None else plan
    original = F.lit(None).cast("string") if job.target == "training" else F.col("surface")
    record = F.struct("start", "end", "new_start", "new_end", "entity_type", "strategy", "replacement", original.alias("original"))
    lists = plan.groupBy(id_col).agg(F.sort_array(F.collect_list(record)).alias("replacements")).withColumnRenamed(id_col, "_id")
    joined = documents.join(lists, F.col(id_col) == F.col("_id"), "left")
    none = F.array().cast(lists.schema["replacements"].dataType)
    out = joined.select(id_col, spans.replaced(F.col(text_col), F.col("replacements.start"), F.col("replacements.end"), F.col("replacements.replacement")).alias("masked_text"), F.coalesce("replacements", none).alias("replacements"))
    if verify:
        kept = [k for k, e in policy.of(job.target).items() if (job.strategy_overrides.get(k, e.strategy) if honor_overrides else e.strategy) == "keep"]
        found = outside(detector)(F.col("masked_text"), F.col("replacements.new_start"), F.col("replacements.new_end"))
        out = out.withColumn("_found", found)
        real = lambda f: (f["confidence"] >= spans.threshold_for(f["entity_type"], job.confidence_threshold, job.type_thresholds)) & ~F.upper(f["entity_type"]).isin(*kept)
        out = out.withColumn("leaks", F.filter("_found", real)).drop("_found")
        out = out.withColumn("status", F.when(F.size("leaks") > 0, LEAK).otherwise(VERIFIED))
    else:
        out = out.withColumn("leaks", F.array().cast(_LEAKS)).withColumn("status", F.lit(UNVERIFIED))
    if redact_quarantined:
        bare = F.transform("replacements", lambda r: r.withField("original", F.lit(None).cast("string")))
        out = out.withColumn("replacements", F.when(F.col("status") == LEAK, bare).otherwise(F.col("replacements")))
    return out.select(
        id_col, "masked_text", F.lit(job.job_id).alias("job_id"), F.lit(job.target).alias("mode"), F.lit(job.policy_version or policy.version).alias("policy_version"),
        F.lit(VERSION).alias("canonicalizer_version"), "status", (F.col("status") == VERIFIED).alias("deliverable"), "replacements", "leaks",
    )


def dry_run(documents: DataFrame, findings: DataFrame, **options) -> DataFrame:
    """What mask() would give; nothing is written anywhere."""
    return mask(documents, findings, **options)
