import base64
import random
import time
import zlib
from array import array

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskspark.llm import bytebpe, packing, tokencount, tokenfile, wordbpe
from maskspark.llm.common import new_path

CHARS = [" ", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "　", "᠎", "​", "a", "B", "é", "é", "Σ", "ς", "İ", "1", "²", "½", "'s", "'", "!", "<|endoftext|>", "<|startoftext|>", "日", "😀", "ß", "ا", "\xad", "z" * 70, "aaaa", "\x00", "the", "ing"]


def strings(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def ids(library, texts):
    return [array("I", e.ids).tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_file(wordbpe.default_path())


def test_word_encoder_is_the_library(words, awkward):
    texts = strings(4000) + [t or "" for _, t in awkward]
    ours = wordbpe.WordEncoder(cache_words=50)
    assert ours.encode(texts) == ids(words, texts)


def test_word_encoder_knows_every_entry(words):
    shown = {c: b for b, c in enumerate(wordbpe.byte_characters())}
    entries = []
    for token in list(words.get_vocab())[::7]:
        try:
            entries.append(bytes(shown[c] for c in token.replace("</w>", "")).decode())
        except (KeyError, UnicodeDecodeError):
            continue
    assert wordbpe.WordEncoder().encode(entries) == ids(words, entries)


def test_perfect_hash():
    keys = [str(i).encode() for i in range(3000)]
    found = bytebpe.PerfectHash(keys)
    assert sorted(found.slot(k) for k in keys) == list(range(3000)) and [found.slots[found.slot(k)] for k in keys] == list(range(3000))
    assert bytebpe.PerfectHash([b"one"]).slot(b"one") == 0


@pytest.fixture(scope="module")
def bpe():
    return bytebpe.ByteBPE(cache=100)


def test_byte_bpe_is_tiktoken(bpe, awkward):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bytebpe.default_path(), "rb"))}
    back = bytebpe.Decoder()
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in strings(4000) + [t or "" for _, t in awkward]:
        got = bpe.encode(text)
        assert got == array("I", library.encode_ordinary(text)).tobytes()
        assert back.decode(got) == text.encode()


def test_byte_bpe_over_tables(spark, docs, empty, awkward):
    rows = bytebpe.encode(docs)
    assert rows.columns == ["doc_id", "n_tokens", "ids"] and rows.count() == len(awkward)
    back = bytebpe.decode(rows).select("doc_id", F.decode("bytes", "UTF-8").alias("text")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in awkward)
    assert bytebpe.decode(bytebpe.encode(empty)).count() == 0
    assert bytebpe.decode(spark.createDataFrame([(1, None)], "doc_id int, ids binary")).head().bytes is None


def test_token_counts_are_the_library(spark, docs, empty, awkward):
    library = Tokenizer.from_file(tokencount.default_path())
    texts = strings(4000, 2) + [t or "" for _, t in awkward]
    assert tokencount.TokenCounter(cache=100).counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    got = tokencount.count_tokens(docs).collect()
    want = [(i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in awkward]
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == sorted(want)
    assert tokencount.count_tokens(empty).count() == 0


def test_long_pre_tokens(spark):
    """Above a length a pre-token is an array of its own; the library says the same of both, and time grows in proportion."""
    library = Tokenizer.from_file(tokencount.default_path())
    rng = random.Random(4)
    edge = tokencount.LONG
    texts = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("a", "ab", "etaoins", "abcdefghijklmnopqrstuvwxyz") for n in (edge - 1, edge, edge + 1, 5_000, 40_000)]
    texts.append("é日" * 3_000)
    counter = tokencount.TokenCounter()
    assert counter.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    took = []
    for n in (40_000, 400_000):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        began = time.perf_counter()
        counter.counts([text])
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0] + 1


def test_other_patterns(awkward):
    """A pattern that takes line ends along with what is before them: its matches are not those of chunks."""
    pattern = r"[^\s]+\n*|\s+"
    texts = strings(500, 7) + ["a!\n\nb", "!\n"] + [t or "" for _, t in awkward if len(t or "") < 10_000]
    ranks = bytebpe.read_ranks(bytebpe.default_path())
    library = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bytebpe.ByteBPE(pattern=pattern)
    assert [own.encode(t) for t in texts] == [array("I", library.encode_ordinary(t)).tobytes() for t in texts]
    counter, merger = tokencount.TokenCounter(pattern=pattern), tokencount.TokenCounter().merger
    plain = [t for t in texts if "<|" not in t]
    import regex

    assert counter.counts(plain) == [int(merger.count([m.encode() for m in regex.findall(pattern, t)]).sum()) for t in plain]


def test_runs_of_one_pair_merge_from_the_left():
    vocab = {c: i for i, c in enumerate(wordbpe.byte_characters())} | {"aa": 256, "aaaa": 257}
    merger = tokencount.Merger(vocab, [("a", "a"), ("aa", "aa")])
    assert merger.count([b"a" * n for n in range(1, 10)]).tolist() == [1, 1, 2, 1, 2, 2, 3, 2, 3]


def pieces_are_whole(rows, want):
    """rows: (doc, start, length, crc, doc_tokens, sequence, offset); want: ids by document."""
    at = {}
    for doc, start, length, crc, total, _, _ in sorted(rows):
        assert total == len(want[doc]) and start == at.get(doc, 0) and zlib.crc32(want[doc][start : start + length].tobytes()) == crc
        at[doc] = start + length
    assert at == {d: len(x) for d, x in want.items()}
    sequences = {}
    for _, _, length, _, _, sequence, offset in rows:
        sequences.setdefault(sequence, []).append((offset, length))
    padding = 0
    for parts in sequences.values():
        used = 0
        for offset, length in sorted(parts):
            assert offset == used
            used += length
        assert used <= 2048
        padding += 0 if used & (used - 1) == 0 else 2048 - used
    return padding


def test_packing(docs, empty, awkward, words):
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = packing.pack_documents(unique, buffer_tokens=3_000).withColumn("crc", F.crc32("ids")).collect()
    want = {i: np.append(np.frombuffer(x, np.uint32), np.uint32(1)) for (i, _), x in zip(awkward, ids(words, [t or "" for _, t in awkward])) if i is not None}
    rows = [(r.doc_id, r.start, r.length, r.crc, r.doc_tokens, r.sequence_id, r.offset) for r in got]
    assert pieces_are_whole(rows, want) <= 0.01 * sum(map(len, want.values()))
    assert packing.pack_documents(docs).groupBy("doc_id", "sequence_id", "offset").count().where("count > 1").count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_windows_are_full_and_groups_even():
    rng = random.Random(5)
    pieces = [(rng.choice((1, 7, 100, 256, 257, 900, 2047, 2048, 5000)), i, 0) for i in range(2_000)]
    windows, rest = packing.pack(pieces)
    for tier, parts in windows:
        used = sum(p[0] for p in parts)
        assert used == tier or tier == 2048 and used > 2048 - 16
    assert sum(p[0] for p in rest) < 2048 and sum(p[0] for p in pieces) == sum(p[0] for _, w in windows for p in w) + sum(p[0] for p in rest)
    ends = packing.ladder([(1000, 1, 0), (500, 2, 0)], 2048)
    assert [s for s, _ in ends] == [1024, 256, 128, 64, 16, 8, 4] and all(sum(p[0] for p in w) == s for s, w in ends)
    groups = packing.balanced([t for t, _ in windows], 65_536)
    loads = [sum(t for (t, _), g in zip(windows, groups) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 2048


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files(spark, docs, empty, awkward, words, encoding):
    import pyarrow.parquet as pq

    path = new_path(spark, "test-files")
    tokenfile.write_token_files(docs, path, encoding=encoding)
    got = tokenfile.with_crc32(tokenfile.read_token_files(spark, path), ("doc_id", "start", "n_tokens")).orderBy("start").collect()
    order = sorted(zip(awkward, ids(words, [t or "" for _, t in awkward])), key=lambda x: (x[0][0] is not None, x[0][0], x[0][1] or ""))
    at = 0
    for r, ((doc, _), x) in zip(got, order, strict=True):
        full = x + (2).to_bytes(4, "little")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, at, len(full) // 4, zlib.crc32(full))
        at += r.n_tokens
    (file, *_) = [f for f in spark.read.parquet(path).inputFiles()]
    column = pq.ParquetFile(file.removeprefix("file://")).metadata.row_group(0).column(4)
    assert column.has_column_index and (("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")) and (encoding == "delta" or "RLE_DICTIONARY" in column.encodings or "PLAIN_DICTIONARY" in column.encodings)
    none = new_path(spark, "test-files")
    tokenfile.write_token_files(empty, none)
    assert tokenfile.read_token_files(spark, none).count() == 0


def test_equal_ids_are_cut_in_ranges(spark, words):
    """30,000 of 40,000 rows have one id: no file holds much more than its share, and starts are right."""
    path = new_path(spark, "test-files")
    rows = spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(7).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 11).cast("string")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokenfile.write_token_files(rows.repartition(4), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = [r["count"] for r in spark.read.parquet(path).groupBy("part").count().collect()]
    assert sum(parts) == 40_000 and max(parts) < 2 * 40_000 / 4
    got = tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens").orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))


def test_selective_reads(spark, docs):
    """Metadata columns are read without the ids, and a range of documents without the other row groups."""
    path = new_path(spark, "test-files")
    tokenfile.write_token_files(docs, path, row_group_bytes=1_024, page_rows=2)
    plan = spark.read.parquet(path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan[plan.index("ReadSchema") :]
    some = spark.read.parquet(path).where("doc_id = 7")
    assert "EqualTo(doc_id,7)" in some._jdf.queryExecution().executedPlan().toString() and some.count() == 1
