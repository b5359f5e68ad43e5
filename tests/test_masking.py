import random
import time

import pytest
from pyspark.sql import functions as F

from maskspark.operators import detect, evaluate, pseudonyms, redline, spans, state
from maskspark.plans import packs
from maskspark.plans.pipeline import Keys, mask, owners, planned
from maskspark.plans.policy import Job, PolicyViolation, build_pack, build_policy, default_policy, job_of, load_pack, load_packs, load_policy

FINDINGS = "file_id string, ord int, entity_type string, start int, end int, confidence double, tier string, validated boolean"
RAG = Keys(b"B" * 32, b"k" * 32, b"tweak77")


def tables(spark, docs, findings):
    rows = [(d, i, k, s, e, c, "T1", False) for i, (d, k, s, e, c) in enumerate(findings)]
    return spark.createDataFrame(docs, "file_id string, text string"), spark.createDataFrame(rows, FINDINGS)


def masked(spark, text, findings, job=None, **options):
    docs, found = tables(spark, [("f", text)], [("f", *f) if len(f) == 4 else ("f", *f, 0.95) for f in findings])
    return mask(docs, found, job, **options).head()


COREF = "Dr. Priya Sharma met Anil Rao. Later SHARMA, Priya emailed Anil Rao at anil.rao@x.com."
COREF_SPANS = [("PERSON", 0, 16), ("PERSON", 21, 29), ("PERSON", 37, 50), ("PERSON", 59, 67), ("EMAIL", 71, 85)]


def test_training_placeholders(spark):
    out = masked(spark, COREF, COREF_SPANS)
    assert out.masked_text == "<NAME_1> met <NAME_2>. Later <NAME_1> emailed <NAME_2> at <EMAIL>."
    assert out.status == "VERIFIED" and out.deliverable and all(r.original is None for r in out.replacements)
    assert all(out.masked_text[r.new_start : r.new_end] == r.replacement for r in out.replacements)


def test_generalize_and_fail_closed(spark):
    assert masked(spark, "DOB 1990-04-12, ZIP 560034, age 93", [("DOB", 4, 14), ("ZIP", 20, 26), ("AGE", 32, 34)]).masked_text == "DOB 1990, ZIP 560XXX, age 90+"
    assert masked(spark, "secret BLOB9 here", [("WEIRD_NEW_TYPE", 7, 12)]).masked_text == "secret  here"


def test_leak_is_quarantined_and_artefacts_are_not(spark):
    out = masked(spark, "Contact anil.rao@x.com now", [])
    assert out.status == "LEAK_DETECTED" and not out.deliverable and out.leaks[0].entity_type == "EMAIL"
    card = masked(spark, "Card: 4111 1111 1111 1111 ok", [("CREDIT_CARD", 6, 25)], Job(target="rag"), keys=RAG)
    assert card.status == "VERIFIED" and card.masked_text[:6] == "Card: " and card.masked_text[10] == " " and card.masked_text != "Card: 4111 1111 1111 1111 ok"
    assert masked(spark, "x", [], verify=False).status == "UNVERIFIED"


def test_rag_tokens_are_consistent(spark):
    docs, found = tables(spark, [("a", "Anil Rao x"), ("b", "y RAO, Anil")], [("a", "PERSON", 0, 8, 0.9), ("b", "PERSON", 2, 11, 0.9)])
    got = {r.file_id: r for r in mask(docs, found, Job(target="rag"), keys=RAG).collect()}
    assert got["a"].masked_text.split()[0] == got["b"].masked_text.split()[1] and got["a"].replacements[0].original == "Anil Rao"


def test_date_shift_is_one_per_document(spark):
    docs, found = tables(spark, [("a", "2024-03-12 and 2024-03-15"), ("b", "someday")], [("a", "DATE", 0, 10, 0.9), ("a", "DATE", 15, 25, 0.9), ("b", "DATE", 0, 7, 0.9)])
    got = {r.file_id: r.masked_text for r in mask(docs, found, shift_key=b"1" * 32).collect()}
    from datetime import date

    one, two = (date.fromisoformat(x) for x in got["a"].split(" and "))
    assert (two - one).days == 3 and one != date(2024, 3, 12) and abs((one - date(2024, 3, 12)).days) <= 365 and got["b"] == "<DATE>"
    fixed = docs.withColumn("shift_days", F.lit(1))
    assert planned(fixed, found, Job(), default_policy()).where("file_id = 'a'").orderBy("start").head().replacement == "2024-03-13"


def test_training_never_links(spark):
    with pytest.raises(PolicyViolation):
        Job(strategy_overrides={"PERSON": "fpe"})
    with pytest.raises(PolicyViolation):
        masked(spark, "x", [], keys=RAG)
    with pytest.raises(PolicyViolation):
        build_policy({"policies": {"training": {"PERSON": "hmac_pseudonym"}}})
    with pytest.raises(PolicyViolation):
        masked(spark, COREF, COREF_SPANS, Job(target="rag"))


def test_edges(spark):
    docs, found = tables(spark, [("n", None), ("e", ""), ("z", "abc"), ("z2", "a😀b Eve")], [("z2", "PERSON", 4, 7, 0.9), ("z", "PERSON", 0, 3, 0.1)])
    got = {r.file_id: r.masked_text for r in mask(docs.withColumn("entity_type", F.lit("x")), found).collect()}
    assert got == {"n": None, "e": "", "z": "abc", "z2": "a😀b <NAME_1>"}
    assert mask(docs.limit(0), found.limit(0)).count() == 0
    with pytest.raises(Exception):
        masked(spark, "short", [("PERSON", 0, 99)])


@pytest.mark.parametrize(("given", "wanted"), [
    ([("PHONE", 0, 10, 0.6), ("PHONE", 5, 15, 0.9)], [("PHONE", 0, 15, 0.9)]), ([("ADDRESS", 0, 40, 0.6), ("PERSON", 5, 15, 0.9)], [("ADDRESS", 0, 40, 0.9)]),
    ([("ADDRESS", 0, 20, 0.6), ("PERSON", 15, 30, 0.5)], [("ADDRESS", 0, 30, 0.6)]), ([("A", 0, 5, 0.6), ("B", 5, 9, 0.7)], [("A", 0, 5, 0.6), ("B", 5, 9, 0.7)]),
    ([("A", 0, 5, 0.6), ("B", 0, 5, 0.7)], [("A", 0, 5, 0.7)]),
])
def test_overlaps(spark, given, wanted):
    _, found = tables(spark, [], [("f", *g) for g in given])
    got = spans.resolved(found).orderBy("start").select("entity_type", "start", "end", "confidence").collect()
    assert [tuple(r) for r in got] == wanted


def test_overlaps_like_a_fold(spark):
    rng = random.Random(3)
    rows = [(str(d), k, s, s + rng.randint(1, 12), rng.random()) for d in range(60) for _ in range(rng.randint(1, 9)) for k in [rng.choice("ABC")] for s in [rng.randint(0, 40)]]
    _, found = tables(spark, [], rows)
    want = {}
    by_doc = {}
    for i, r in enumerate(rows):
        by_doc.setdefault(r[0], []).append((r[2], -r[3], i, r[1], r[4]))
    for d, fs in by_doc.items():
        out = []
        for s, e, _, k, c in sorted(fs):
            if out and s < out[-1][2]:
                out[-1] = (out[-1][0], out[-1][1], max(out[-1][2], -e), max(out[-1][3], c))
            else:
                out.append((k, s, -e, c))
        want[d] = out
    got = {}
    for r in spans.resolved(found).orderBy("file_id", "start").collect():
        got.setdefault(r.file_id, []).append((r.entity_type, r.start, r.end, r.confidence))
    assert got == want


def test_application_forms_agree(spark):
    rng = random.Random(1234)
    docs, plan = [], []
    for d in range(80):
        text = "".join(rng.choice("abc é😀\n") for _ in range(rng.randint(10, 200)))
        docs.append((str(d), text))
        at = sorted(rng.sample(range(len(text) + 1), 2 * (min(20, len(text)) // 4)))
        plan += [(str(d), s, e, "x" * rng.randint(0, 6)) for s, e in zip(at[::2], at[1::2]) if e > s]
    documents, rows = spark.createDataFrame(docs, "file_id string, text string"), spark.createDataFrame(plan, "file_id string, start int, end int, replacement string")
    by_arrow = {r.file_id: r.masked_text for r in spans.applied(documents, rows).collect()}
    lists = rows.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("p"))
    natively = {r[0]: r[1] for r in documents.join(lists, "file_id").select("file_id", spans.applied_natively(F.col("text"), F.col("p"))).collect()}
    assert all(by_arrow[k] == v for k, v in natively.items())
    for r in spans.with_new_offsets(rows).collect():
        assert by_arrow[r.file_id][r.new_start : r.new_end] == r.replacement
    with pytest.raises(Exception):
        spans.checked(spark.createDataFrame([("f", 0, 5, "x"), ("f", 3, 9, "y")], "file_id string, start int, end int, replacement string")).collect()


@pytest.mark.parametrize(("text", "wanted"), [
    ("pay 4532 0151 1283 0366 today", [("CREDIT_CARD", 4, 23)]), ('{"bbox": [123456789012], "id": 4111111111111111}', []), ("on 2020-06-24 12:34:56", []), ("date 24-06-2020 1234", []),
    ("call +91 98765 43210", [("PHONE", 5, 20)]), ("ssn 123-45-6789.", [("SSN", 4, 15)]), ("pan ABCDE1234F x", [("PAN", 4, 14)]), ("a.b@c.de", [("EMAIL", 0, 8)]), ("", []),
])
def test_detector(text, wanted):
    assert [(k, s, e) for k, s, e, _ in detect.find(text)] == wanted


def test_detector_scale():
    began = time.time()
    assert len(detect.find("Ravi +91 98765 43210 said hi. " * 40_000)) == 40_000
    assert time.time() - began < 9  # three seconds on a machine that does nothing else


def test_email_expression_agrees(spark):
    texts = ["a@b.cd x@y.zz", "none", "", "é a.b@c.de😀 q@r.st", "@@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {(r.doc_id, r.start, r.end) for r in detect.detect_email(docs).collect()}
    assert got == {(i, s, e) for i, t in enumerate(texts) for k, s, e, _ in detect.find(t) if k == "EMAIL"}


def test_collisions_extend_and_registry_wins(spark):
    rows = spark.createDataFrame([("person", "aa11" + "0" * 60, 2), ("person", "aa22" + "0" * 60, 1), ("org", "aa33" + "0" * 60, 3)], "entity_class string, digest string, first_seen int")
    got = {r.digest[:4]: r.token_length for r in pseudonyms.token_lengths(rows, 2).collect()}
    assert got == {"aa22": 2, "aa11": 6, "aa33": 2}
    registry = spark.createDataFrame([("person", "aa", "aa11" + "0" * 60, 2)], pseudonyms.REGISTRY)
    got = {r.digest[:4]: r.token_length for r in pseudonyms.token_lengths(rows, 2, registry).collect()}
    assert got == {"aa22": 6, "aa11": 2, "aa33": 2}
    assert pseudonyms.merged_registry(registry, pseudonyms.token_lengths(rows, 2, registry)).count() == 3


def test_policies_and_packs(spark, tmp_path):
    assert len(default_policy().of("training")) == len(default_policy().of("rag")) == 24
    there = packs.shipped()
    assert len(there) == 18 and len(there["hipaa_safe_harbor"].rules) == 17 and all(len(p.rules) == 24 for n, p in there.items() if n != "hipaa_safe_harbor")
    assert [n for n, p in there.items() if p.targets() == {"rag"}] == ["rag_default"]
    for bad in ({"policies": {}, "x": 1}, {}, {"policies": {"other": {}}}, {"policies": {"rag": {"A": "burn"}}}, {"policies": {}, "default_strategy": "keep"}):
        with pytest.raises(PolicyViolation):
            build_policy(bad)
    rule = {"entity": "ssn", "action": "suppress", "min_confidence": 0.8}
    for bad in ({"rules": [rule, rule]}, {"rules": [{**rule, "action": "burn"}]}, {"rules": [{**rule, "min_confidence": 2}]}, {"rules": [], "default_action": "keep"}, {"rules": [], "y": 1}, {"rules": [], "below_threshold": "drop"}):
        with pytest.raises(PolicyViolation):
            build_pack({"regulation": "R", "version": "1"} | bad)
    (tmp_path / "mine.yaml").write_text("regulation: R\nversion: '1'\nrules:\n  - {entity: ssn, action: suppress}\n")
    assert load_pack(tmp_path / "mine.yaml").rule_for("SSN").action == "suppress" and len(load_packs(tmp_path, ["mine"])[0].sha256) == 64
    with pytest.raises(FileNotFoundError):
        load_packs(tmp_path, ["other"])
    (tmp_path / "policy.yaml").write_text("version: 2\npolicies: {rag: {person: keep}}\n")
    assert load_policy(tmp_path / "policy.yaml").lookup("rag", "Person").strategy == "keep"
    assert job_of({"downstream_target": "rag", "job_id": "j", "type_thresholds": {"ssn": 0.9}}).threshold("SSN") == 0.9


def test_pack_job_settings(spark):
    there = packs.shipped()
    settings = packs.job_settings(spark, [there["training_default"]], "training", {"PERSON", "BADGE"})
    assert settings["strategy_overrides"]["BADGE"] == "suppress" and settings["policy_version"] == "training_default/1.0"
    job = Job(**{k: settings[k] for k in ("type_thresholds", "strategy_overrides", "policy_version")})
    docs, found = tables(spark, [("f", COREF)], [("f", *s, 0.95) for s in COREF_SPANS])
    assert mask(docs, found, job).head().masked_text == mask(docs, found).head().masked_text
    with pytest.raises(PolicyViolation):
        packs.resolved(found, packs.rule_table(spark, [there["rag_default"]]), "training", [there["rag_default"]])
    with pytest.raises(PolicyViolation):
        packs.job_settings(spark, [], "rag")
    out = packs.resolved(spark.createDataFrame([("f", 0, "SSN", 0, 3, 0.94, "T1", False), ("f", 1, "person", 4, 9, 0.82, "T1", False), ("f", 2, "ZEBRA", 10, 12, 0.99, "T1", False)], FINDINGS), packs.rule_table(spark, [there["hipaa_safe_harbor"]]), "rag", [there["hipaa_safe_harbor"]])
    assert [(r.outcome, r.strategy) for r in out.orderBy("ord").collect()] == [("apply", "suppress"), ("review", "hmac_pseudonym"), ("apply", "suppress")]


def test_vault_and_audit(spark, tmp_path):
    docs, found = tables(spark, [("a", "Anil Rao")], [("a", "PERSON", 0, 8, 0.9)])
    plan = planned(docs, found, Job(target="rag", reversible=True), default_policy(), RAG)
    key = spark.createDataFrame([(bytearray(b"v" * 32),)], "vault_key binary")
    status = spark.createDataFrame([("a", "VERIFIED")], "file_id string, status string")
    assert state.vault_rows(plan, status, False, key).count() == 0
    vault, log = state.vault_rows(plan, status, True, key), str(tmp_path / "audit")
    name = plan.head().replacement
    assert state.reveal(vault, key, name, "ann", "dpo", "a court order came", log) == "Anil Rao"
    assert state.reveal(vault, key, "User_0", "ann", "dpo", "a court order came", log) is None
    for role, reason in (("analyst", "a court order came"), ("dpo", "  why  ")):
        with pytest.raises(state.BreakGlassDenied):
            state.reveal(vault, key, name, "bob", role, reason, log)
    assert sorted(r.action for r in state.audit_entries(spark, log).collect()) == ["reveal", "reveal", "reveal_denied", "reveal_denied"]
    assert state.vault_rows(plan, status.withColumn("status", F.lit("LEAK_DETECTED")), True, key).count() == 0


def test_state_tables(spark, tmp_path):
    path = f"file://{tmp_path}/registry"
    assert state.load(spark, path, pseudonyms.REGISTRY).count() == 0
    for n in (1, 2, 3):
        state.save(state.load(spark, path, pseudonyms.REGISTRY).unionByName(spark.createDataFrame([("person", str(n), "d", 8)], pseudonyms.REGISTRY)), path)
    assert state.load(spark, path, pseudonyms.REGISTRY).count() == 3
    receipts = spark.createDataFrame([("a", "j", "1", "1", "t1", "x"), ("a", "j", "1", "1", "t2", "y")], "file_id string, job_id string, policy_version string, canonicalizer_version string, created_at string, status string")
    assert state.upserted_receipts(receipts.limit(0), receipts).head().status == "y" and state.receipt_of(receipts, "a", "j").head().status == "y"


def test_redline_and_kpis(spark):
    assert redline.marked("a <b> c", "a <X> c") == "a <del>&lt;b&gt;</del><ins>&lt;X&gt;</ins> c" and "<ins>" in redline.page("a", "b", "t", {"mode": "rag"})
    made = evaluate.corpus(spark, 10, 7)
    for r in made.collect():
        assert all(0 <= f.start < f.end <= len(r.text) for f in r.findings)
    found = detect.flat(made)
    docs = made.select("file_id", "text")
    truth = spans.surfaces(docs, found.select("file_id", "start", "end", "entity_type")).where("entity_type in ('PERSON', 'ORG', 'EMAIL')")
    tokens = planned(docs, found, Job(target="rag"), default_policy(), RAG).where("strategy = 'hmac_pseudonym'")
    row = evaluate.kpis(mask(docs, found, Job(target="rag"), keys=RAG), truth, tokens).head()
    assert (row.residual_leaks, row.quarantined_docs, row.consistency, row.false_merges) == (0, 0, 1.0, 0) and row.entities > 10 and "consistency" in evaluate.report(row)


def test_owners_are_those_of_a_plan(spark):
    docs, found = tables(spark, [("a", "Ann Lee"), ("b", "Bob Ray")], [("a", "PERSON", 0, 7, 0.9), ("b", "PERSON", 0, 7, 0.9), ("b", "DATE", 0, 0, 0.9)])
    job = Job(target="rag")
    wanted = pseudonyms.registry_of(planned(docs, found, job, default_policy(), RAG)).select("entity_class", "prefix", "digest", "token_length")
    known = owners(docs, found, job, default_policy(), RAG)
    assert known.count() == 2 and set(known.select(*wanted.columns).collect()) == set(wanted.collect())
    taken = known.where(F.col("digest") == known.head().digest).withColumn("digest", F.lit("f" * 64))
    assert sorted(r.token_length for r in owners(docs, found, job, default_policy(), RAG, taken).collect()) == [8, 12]
    for target, keys in (("training", RAG), ("rag", Keys())):
        with pytest.raises(PolicyViolation):
            owners(docs, found, Job(target=target), default_policy(), keys)


def test_jobs_query_with_clashing_prefixes_is_its_sql(spark, tmp_path):
    import duckdb

    from maskspark.queries import ORACLE, QUERIES

    # The digests of these customers' addresses begin with the same eight digits; the even note, a training message, is first.
    duck = duckdb.connect()
    duck.execute("CREATE TABLE customer AS SELECT * FROM (VALUES (31796::BIGINT, 'Customer#1'), (63242, 'Customer#2')) AS v(c_custkey, c_name)")
    duck.execute("CREATE TABLE orders AS SELECT *, TIMESTAMP '1995-10-21' AS o_orderdate FROM (VALUES (4::BIGINT, 63242::BIGINT), (5, 31796), (9, 63242)) AS v(o_orderkey, o_custkey)")
    for name in ("customer", "orders"):
        duck.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    wanted = {r[0]: r[1:] for r in duck.execute(ORACLE["mask_jobs"]).fetchall()}
    got = {r.file_id: (r.job_id, r.masked_text, r.status) for r in QUERIES["mask_jobs"](spark, str(tmp_path)).collect()}
    tokens = {k: v[1].split("mail ")[1].rstrip(".") for k, v in wanted.items()}
    assert tokens["n4"] == "<EMAIL>" and tokens["n5"] == tokens["n9"] + tokens["n5"][-4:]
    assert got == wanted
