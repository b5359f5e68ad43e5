import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from maskspark.llm import components, exactdedup, sharding, simhash
from maskspark.llm.common import joined_by_key, placed, stored


def groups_by_hand(rows):
    found = collections.defaultdict(list)
    for i, t in rows:
        found[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i))
    return found


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_groups(docs, empty, awkward, bits):
    """With a digest of eight bits most texts clash, and nothing changes."""
    got = exactdedup.deduplicate(docs, digest_bits=bits).collect()
    want = []
    for norm, members in groups_by_hand(awkward).items():
        keep = min(members)[2]
        want += [(i or 0, keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest()) for _, _, i in members]
    assert sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == sorted(want, key=str)
    assert exactdedup.deduplicate(empty, digest_bits=bits).count() == 0


def test_one_copy_stays(docs, awkward):
    out = exactdedup.without_copies(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(map(str, kept)) == sorted(str((i, t)) for members in [sorted(m) for m in groups_by_hand(awkward).values()] for i in [members[0][2]] for t in [next(t for j, t in awkward if j == i and len(t or "") == -members[0][0])])


def test_columns_and_repeated_ids(spark, docs, clashing):
    """All columns come back, whatever their names; of rows of one id the longest text stays."""
    out = exactdedup.without_copies(docs)
    assert out.columns == docs.columns and all(r[c] == c for r in out.collect() for c in clashing)
    rows = [(1, "a b"), (1, "a  b"), (1, "ab"), (2, "a b"), (1, "a  b"), (None, "c"), (None, "c"), (None, "c ")]
    for order in (rows, rows[::-1]):
        kept = exactdedup.without_copies(spark.createDataFrame(order, "doc_id long, text string").repartition(3)).collect()
        assert sorted(map(str, map(tuple, kept))) == ["(1, 'a  b')", "(None, 'c ')"]


def test_hot_keys_join_like_others(spark):
    rows = spark.range(3_000).select(F.when(F.col("id") < 2_000, 1).otherwise(F.col("id") % 7).cast("long").alias("k"), "id")
    keyed = rows.groupBy(F.col("k").alias("of")).agg(F.count("*").alias("n"), F.max("id").alias("last")).where("of <> 3")
    want = sorted(map(tuple, rows.join(keyed, rows["k"] == keyed["of"]).select("id", "k", "n", "last").collect()))
    for least in (10, 10_000):
        got = joined_by_key(rows, keyed, {"of": "k"}, "n", 3_000, most_hot=10, least_hot=least)
        assert sorted(map(tuple, got.select("id", "k", "n", "last").collect())) == want


def test_signed_ids(spark):
    low = -(1 << 63)
    rows = spark.createDataFrame([(low, "a"), ((1 << 63) - 1, "a "), (-5, "b"), (5, "b")], "doc_id long, text string")
    assert {r.doc_id: r.keep_id for r in exactdedup.deduplicate(rows).collect()} == {low: (1 << 63) - 1, (1 << 63) - 1: (1 << 63) - 1, -5: -5, 5: -5}


def test_shards(spark, docs, empty, awkward, clashing):
    rows = spark.range(1003).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit(1).alias("shard_"))
    out = sharding.shuffled_shards(rows, 7, source_rows=50, bin_rows=20).collect()
    sizes = collections.Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and len(sizes) == 7 and sorted(r.doc_id for r in out) == list(range(1003))
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    held = stored(rows, "test-rows")
    out, again = (sharding.shuffled_shards(held, 7, source_rows=50, bin_rows=20).collect() for _ in range(2))
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}
    other = sharding.shuffled_shards(held, 7, seed=2).collect()
    assert {(r.doc_id, r.shard) for r in out} != {(r.doc_id, r.shard) for r in other}
    few = sharding.shuffled_shards(docs, 40).collect()
    assert sorted(str((r.doc_id, r.text)) for r in few) == sorted(map(str, awkward)) and max(collections.Counter(r.shard for r in few).values()) == 1
    assert all(r[c] == c for r in few for c in clashing if c != "slot") and {r.slot for r in few} == {0}
    assert sharding.shuffled_shards(empty, 40).count() == 0


def test_rows_that_repeat_are_shuffled_too(spark):
    """30,000 of 40,000 rows are one row: their sources are even, and they end up all over the shards."""
    rows = stored(spark.range(40_000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), "id"), "test-hot")
    out = sharding.shuffled_shards(rows, 8, source_rows=500, bin_rows=1_000)
    got = out.select("shard", "slot", (F.col("id") % 4 != 0).alias("hot"), "id").collect()
    for s in range(8):
        mine = sorted((r.slot, r.hot, r.id) for r in got if r.shard == s)
        assert [r[0] for r in mine] == list(range(5_000))
        halves = [sum(r[1] for r in mine[k : k + 2_500]) for k in (0, 2_500)]
        assert all(abs(n - 1_875) < 6 * (2_500 * 0.75 * 0.25) ** 0.5 for n in halves)
        steps = [b[2] > a[2] for a, b in zip(mine, mine[1:])]
        assert 0.45 < sum(steps) / len(steps) < 0.55  # no order of the input is left
    assert len({r.id for r in got}) == 40_000
    sources = placed(rows, "p").groupBy(F.pmod(F.xxhash64(F.lit(8), "doc_id", "text", "p"), F.lit(80))).count()
    assert sources.agg(F.max("count")).head()[0] < 650


def test_matrix_is_exact_and_fair():
    counts = [10, 0, 35, 7]
    total = np.zeros((4, 3))
    for seed in range(400):
        m = np.array(sharding.communication_matrix(counts, 3, seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == [18, 17, 17]
        total += m
    assert np.abs(total / 400 - np.outer(counts, [18, 17, 17]) / 52).max() < 0.5
    rng = np.random.default_rng(3)
    wide = [sharding.hypergeometric(rng, 2_000_000_000, 1_000_000_000, 900) for _ in range(300)]
    assert abs(np.mean(wide) - 600) < 3 and 10 < np.std(wide) < 18


def by_hand(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + words]) for i in range(len(found) - words + 1)] or ([" ".join(found)] if found else [])
    n = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def test_fingerprints(awkward):
    rng = random.Random(2)
    for text in [t or "" for _, t in awkward if len(t or "") < 10_000] + [" ".join(rng.choice("ab Cd é 7".split()) for _ in range(n)) for n in (1, 2, 3, 4, 300, 900)]:
        assert simhash.fingerprint(text) == [by_hand(text)]
    long = "one two three four " * 40_000
    assert simhash.fingerprint(long, 2) == simhash.fingerprint(long, 2, 64) and simhash.fingerprint("", 3, 128) == [0, 0]


def linked(prints, radius):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= radius) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("tile", [10_000, 40])
def test_links_like_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    near = np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 63, 150, dtype=np.uint64)) for _ in range(4)] + [np.zeros(1, np.uint64)])
    near = np.unique(near ^ (np.uint64(1) << rng.integers(0, 63, len(near), dtype=np.uint64)))
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(near.astype(np.int64))], "id long, f0 long")
    edges = simhash.links(rows, 3, tile_rows=tile)
    assert edges.where("distance > 3 or u = v").count() == 0
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert [got.get(i, i) for i in range(len(near))] == linked(near, 3)


def test_dense_groups_give_few_links():
    rng = np.random.default_rng(6)
    x = np.unique(rng.integers(0, 8, 2_000, dtype=np.uint64) << np.uint64(40) | rng.integers(0, 64, 2_000, dtype=np.uint64))[:, None]
    assert len(simhash.tile_pair_forest(x, None, 12, block=16, most_held=1_000)) == len(x) - 1
    assert len(simhash.tile_pair_forest(x[:100], x[100:], 12, block=16)) == len(x) - 1
    three = np.array([[0, 1, 5], [1, 2, 1], [0, 2, 2]])
    assert simhash.closest_forests(three, 2).tolist() == [[1, 2, 1, 0], [0, 2, 2, 0], [0, 1, 5, 1]]


def test_near_duplicates_over_tables(docs, empty, awkward):
    got = collections.Counter((r.doc_id, r.f0 & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    prints = np.array([by_hand(t) for _, t in awkward], np.uint64)
    roots = linked(prints, 3)
    least = {}
    for (i, _), r in zip(awkward, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    assert got == collections.Counter((i, int(p), least[r]) for (i, _), p, r in zip(awkward, prints, roots))
    assert simhash.near_duplicates(empty).count() == 0


def test_chains_become_components(spark):
    n = 200
    chain = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    star = spark.range(50).select(F.lit(1000).alias("u"), (F.col("id") + 1001).alias("v"))
    got = {r.node: r.component for r in components.components(chain.unionByName(star)).collect()}
    assert got == {i: 0 for i in range(n)} | {i: 1000 for i in range(1000, 1051)}
    assert components.components(chain.limit(0)).count() == 0


def test_similar_documents_like_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 260))]
        texts.append(words)
        for _ in range(4):
            other = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 60)):
                other[rng.randrange(len(other))] = rng.choice(vocabulary)
            texts.append(other)
    texts = [" ".join(t) for t in texts] + ["", " ", "one"]
    sets = [set(simhash.word_shingles(t, 5)) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            joined = len(sets[i] | sets[j])
            if (len(sets[i] & sets[j]) / joined if joined else 1) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    rows = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-similar")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_families_like_brute_force(spark):
    """Six families of 150 documents of 300 words, three to five of them changed: thousands of links on either side of 0.8."""
    rng = random.Random(5)
    texts = []
    for _ in range(6):
        base = [f"w{rng.randrange(5_000)}" for _ in range(300)]
        for _ in range(150):
            words = list(base)
            for _ in range(rng.randint(3, 5)):
                words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    sets = [set(simhash.word_shingles(t, 5)) for t in texts]
    parent = list(range(900))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for i in range(900):
        for j in range(i // 150 * 150, i):
            common = len(sets[i] & sets[j])
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8:
                links += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert links > 10_000 and 50 < len({find(i) for i in range(900)}) < 300
    rows = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-families")
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()} == {i: find(i) for i in range(900)}


@pytest.mark.parametrize("tile", [32_768, 400])
def test_pairs_amid_a_template(spark, tile):
    """1,400 documents of one template, at 0.70 of each other and so not alike, and among them 60 pairs at 0.84."""
    template = [f"t{i}" for i in range(164)]
    texts = [template + [f"d{n}-{i}" for i in range(35)] for n in range(1_400)]
    texts += [t[:-17] + [f"e{n}-{i}" for i in range(17)] for n, t in enumerate(texts[:60])]
    rows = stored(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), "test-template")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows, tile_rows=tile).collect()}
    prints = np.array([simhash.fingerprint(" ".join(t), 5, 128) for t in texts], np.uint64)
    near = np.bitwise_count(prints[:60] ^ prints[1_400:]).sum(axis=1) <= simhash.radius_for(0.8, 128)
    assert near.sum() >= 55 and got == {i: i - 1_400 if i >= 1_400 and near[i - 1_400] else i for i in range(1_460)}


def test_copies_with_repeated_lines(spark):
    """A line that stands once or twenty times makes no difference to sets."""
    rng = random.Random(3)
    texts = []
    for n in range(40):
        words = [f"w{n}-{rng.randrange(10**6)}" for _ in range(300)]
        line = [f"line{n}-{i}" for i in range(25)]
        texts += [" ".join(words + line * k) for k in (1, 5, 10, 20)]
    sets = [set(simhash.word_shingles(t, 5)) for t in texts]
    assert all(len(sets[i // 4 * 4] & s) / len(sets[i // 4 * 4] | s) > 0.98 for i, s in enumerate(sets))
    rows = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-repeats")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert got == {i: i // 4 * 4 for i in range(160)}


def test_equal_fingerprints_prove_nothing(spark, monkeypatch):
    """Where all fingerprints are equal, sets alone decide."""
    real = simhash.fingerprints
    monkeypatch.setattr(simhash, "fingerprints", lambda *a, **b: real(*a, **b).withColumns({"f0": F.lit(0).cast("long"), "f1": F.lit(0).cast("long")}))
    texts = [[f"w{n}-{i}" for i in range(90)] for n in range(60)]
    texts = [" ".join(t) for t in texts] + [" ".join(["other", *t]) for t in texts] + [" ".join(texts[7]) + "\n"]
    rows = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-equal")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows, tile_rows=50).collect()}
    assert got == {i: i % 60 for i in range(120)} | {120: 7}


def test_short_texts_are_exact(spark):
    """2,000 pairs of 9 words and the first 8 of them: similarity 0.8, and one fingerprint in thirty is over 32 bits off."""
    texts = [" ".join(f"w{n}-{i}" for i in range(k)) for n in range(2_000) for k in (9, 8)]
    rows = stored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "test-short")
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(rows).collect()}
    assert got == {i: i // 2 * 2 for i in range(4_000)} and simhash.most_exact(0.8) == 8


def test_repeated_rows_leave_one(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    near, alone = (1, " ".join(words)), (3, "a text with no copy of any kind")
    rows = spark.createDataFrame([near, near, near, (2, " ".join(words + ["more"])), alone, alone, (4, None), (4, None)], "doc_id long, text string")
    out = corpus_pipeline.drop_near_copies(spark, stored(rows, "test-rows"), "")
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [near, alone, (4, "")] and out.columns == ["doc_id", "text"]
    many = spark.range(4_000).select(F.lit(1).alias("doc_id"), F.lit("one row again and again").alias("text"), "id")
    assert corpus_pipeline.drop_near_copies(spark, stored(many, "test-rows"), "").count() == 1
