"""Command line: python -m maskspark validate | run | dry-run | eval."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from maskspark.operators import detect, evaluate, pseudonyms, spans, state
from maskspark.plans import packs
from maskspark.plans.jobs import VAULT, Masked, mask_messages, statuses
from maskspark.plans.pipeline import Keys, mask, planned
from maskspark.plans.policy import Job, Policy, default_policy, load_policy
from maskspark.sources import messages
from maskspark.sources.secrets import Secrets
from maskspark.sources.store import written

QUARANTINED = 3


def job_from(args: argparse.Namespace, spark: SparkSession, policy: Policy) -> Job:
    """The job of the arguments; with packs, under their thresholds and strategies."""
    settings = {}
    if args.packs:
        there = packs.shipped()
        settings = packs.job_settings(spark, [there[name] for name in args.packs], args.target, set(policy.of(args.target)))
        settings.pop("policy_provenance")
    return Job(job_id=args.job, target=args.target, tenant_id=args.tenant, **settings)


def masked_folder(spark: SparkSession, args: argparse.Namespace) -> Masked:
    """A folder's messages masked, each under its own job; what that leaves open is as the arguments say."""
    policy = load_policy(args.policy) if args.policy else default_policy()
    rows = messages.collect(spark, args.input, job_id=args.job, target=args.target, tenant_id=args.tenant)
    registry = state.load(spark, f"{args.state}/registry", pseudonyms.REGISTRY) if args.state else None
    vault = state.load(spark, f"{args.state}/vault", VAULT) if args.state else None
    detector = detect.detector_named(args.detector, args.detector_url)
    return mask_messages(rows, job_from(args, spark, policy), policy, Secrets(args.secrets, args.secrets_file), registry, vault, detector=detector, verify=args.detector != "none")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskspark")
    steps = parser.add_subparsers(dest="step", required=True)
    for name in ("run", "dry-run"):
        step = steps.add_parser(name)
        step.add_argument("input")
        if name == "run":
            step.add_argument("output")
        step.add_argument("--job", default="batch")
        step.add_argument("--target", choices=("training", "rag"), default="training")
        step.add_argument("--tenant", default="default")
        step.add_argument("--packs", nargs="*", default=[])
        step.add_argument("--policy")
        step.add_argument("--detector", choices=("regex", "http", "none"), default="regex")
        step.add_argument("--detector-url")
        step.add_argument("--secrets", choices=("env", "file"), default="env")
        step.add_argument("--secrets-file")
        step.add_argument("--state")
    steps.add_parser("validate").add_argument("--policy")
    steps.add_parser("eval").add_argument("--docs", type=int, default=40)
    args = parser.parse_args(argv)
    if args.step == "validate":
        policy = load_policy(args.policy) if args.policy else default_policy()
        print(f"policy {policy.version}: {len(policy.entries)} entries; packs: {', '.join(packs.shipped())}")
        return 0
    spark = spark or SparkSession.builder.appName("maskspark").getOrCreate()
    if args.step == "eval":
        made = written(evaluate.corpus(spark, args.docs), "made-corpus")
        docs, found = made.select("file_id", "text"), detect.flat(made)
        job, keys = Job(target="rag"), Keys(b"eval salt" * 4, b"k" * 32, b"tweak77")
        truth = spans.surfaces(docs, found.select("file_id", "start", "end", "entity_type")).where("entity_type in ('PERSON', 'ORG', 'EMAIL')")
        tokens = planned(docs, found, job, default_policy(), keys).where("strategy = 'hmac_pseudonym'")
        print(evaluate.report(evaluate.kpis(mask(docs, found, job, keys=keys), truth, tokens).head()))
        return 0
    out = masked_folder(spark, args)
    if args.step == "dry-run":
        out.documents.select("file_id", "status", "masked_text").show(truncate=False)
        return 0
    messages.write_results(out.documents, args.output)
    out.failed.write.mode("append").json(f"{args.output}/failed")
    if args.state:
        state.save(out.registry, f"{args.state}/registry")
        state.save(out.vault, f"{args.state}/vault")
    found = {r["status"]: r["count"] for r in statuses(out).groupBy("status").count().collect()}
    quarantined, failed = found.pop("LEAK_DETECTED", 0), found.pop("FAILED", 0)
    print(f"{sum(found.values())} delivered, {quarantined} quarantined, {failed} failed")
    return QUARANTINED if quarantined else 0


if __name__ == "__main__":
    sys.exit(main())
