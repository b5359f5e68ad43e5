import collections
import hashlib
import importlib.util
import os
import re
import zlib
from array import array

import duckdb
import pytest
import xxhash

from maskspark.llm import gif

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def entry():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spec = importlib.util.spec_from_file_location("__spark_entry__", f"{root}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


@pytest.mark.parametrize("name", ["op1_warc", "op5_exact_dedup"])
def test_sql_agrees(spark, entry, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))


def test_columns(spark, entry):
    wanted = {
        "op2_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}, "op3_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
        "op4_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"}, "op6_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op7_gif": {"doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"},
        "op8_token_files": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op9_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op10_simhash": {"doc_id", "fingerprint", "component_id"},
    }
    for name, columns in wanted.items():
        assert columns <= set(entry.queries()[name](spark, DATA).columns)


@pytest.fixture(scope="module")
def texts():
    return {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()}


def test_queries_like_libraries(spark, entry, texts):
    """op2, op3, op4 and op8 over the whole table, against tiktoken and tokenizers."""
    import public_tokenizers
    import tiktoken
    from maskspark.llm import bytebpe
    from tokenizers import Tokenizer

    query = entry.queries()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.default_path()), special_tokens={})
    raw = {i: array("I", library.encode_ordinary(t)).tobytes() for i, t in texts.items()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in query["op2_byte_bpe"](spark, DATA).collect()}
    assert got == {i: (len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest()) for i, x in raw.items()}
    counts = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in query["op4_token_counts"](spark, DATA).collect()}
    sizes = {i: len(counts.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    assert got == {i: (len(t.encode()), sizes[i], sizes[i] > 1024) for i, t in texts.items()}
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: words.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    at, want = 0, {}
    for i in sorted(ids):
        want[i] = (at, len(ids[i]) + 1, zlib.crc32(array("I", [*ids[i], 2]).tobytes()))
        at += len(ids[i]) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in query["op8_token_files"](spark, DATA).collect()} == want
    rows, sequences, at = sorted(query["op3_packing"](spark, DATA).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()), {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        whole = array("I", [*ids[doc], 1])
        assert total == len(whole) and start == at.get(doc, 0) and zlib.crc32(whole[start : start + length].tobytes()) == crc
        at[doc] = start + length
        sequences.setdefault(sequence, []).append((offset, length))
    assert at == {i: len(x) + 1 for i, x in ids.items()}
    for parts in sequences.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 2048


def test_queries_like_plain_code(spark, entry, texts):
    """op6, op7, op9 and op10 over the whole table: what plain Python can say of them."""
    query = entry.queries()
    got = {r.doc_id: r for r in query["op7_gif"](spark, DATA).collect()}
    for i, t in texts.items():
        raw = t.encode()
        whole = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        media = gif.text_to_gif(raw)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        frames = -(-len(whole) // (64 * 256))
        bins = collections.Counter((b >> 6) * 21 for b in whole)
        assert r.feature.startswith(f"frames={frames};ms={100 * frames};bins=") and sum(int(x.split(":")[1]) for x in r.feature.split("bins=")[1].split()) == len(whole) and len(bins) >= 1
    rows = query["op9_sharding"](spark, DATA).collect()
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in rows} == {i: (len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", None) for i, t in texts.items()}
    shards = collections.defaultdict(list)
    for r in rows:
        shards[r.shard].append(r.slot)
    assert sorted(shards) == list(range(40)) and all(sorted(x) == list(range(len(x))) for x in shards.values()) and len({len(x) for x in shards.values()}) <= 2
    rows = {r.doc_id: r for r in query["op10_simhash"](spark, DATA).collect()}
    prints = {i: by_hand(t) for i, t in texts.items()}
    assert {i: int(r.fingerprint, 16) for i, r in rows.items()} == prints
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {i: r.component_id for i, r in rows.items()} == {i: find(i) for i in prints}
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    rows = query["op6_language_id"](spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows) and len(rows) == len(texts)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, texts[r.doc_id]))) for r in rows)
    known = [r for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in known) >= 0.9 * len(known)


def by_hand(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def test_pipeline_stages_by_hand(spark, texts):
    """Exact and near copies of the whole table go as brute force says; documents with letters and a sure language stay."""
    import corpus_pipeline
    from maskspark.llm import simhash

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, DATA)
    groups = collections.defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {min(g)[1] for g in groups.values()}
    near = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    sets = {i: set(simhash.word_shingles(t, 5)) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j:
                joined = len(sets[i] | sets[j])
                if (len(sets[i] & sets[j]) / joined if joined else 1) >= 0.8:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    assert {r.doc_id for r in near.select("doc_id").collect()} == {i for i in sets if find(i) == i}
    stayed = {r.doc_id for r in corpus_pipeline.keep_known_language(spark, docs, DATA).select("doc_id").collect()}
    assert not any(i in stayed for i, t in texts.items() if not any(map(str.isalpha, t)))
    assert len(stayed) >= 0.98 * sum(any(map(str.isalpha, t)) for t in texts.values())


def test_pipeline_stages(spark, docs, empty):
    import corpus_pipeline
    from maskspark.llm.common import stored

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]
    for start in (docs, empty):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stored(stage(spark, now, DATA), "test-stage")
            assert now.columns == docs.columns
        last = corpus_pipeline.STAGES[-1][1](spark, now, DATA).collect()
        kept = [r.text for r in now.collect()]
        assert len(kept) == len(set(kept)) and len({r.doc_id for r in last}) == len({r.doc_id for r in now.collect()})
    texts = {r.text for r in spark.createDataFrame(stored(corpus_pipeline.keep_known_language(spark, docs, DATA), "test-stage").collect(), docs.schema).collect()}
    assert None not in texts and "12345 !!! ..." not in texts and "Hello wide world, hello again" in texts
