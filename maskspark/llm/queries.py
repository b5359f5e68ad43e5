"""One query per operator, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, exactdedup, gif, langid, packing, sharding, simhash, tokencount, tokenfile, warc
from .common import delete_path, documents, new_path, stored, text_or_empty


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as segmented WARC records and read back from the archives."""
    path = new_path(spark, "warc")
    warc.write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = warc.read_archives(spark, path)
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat_ws(" ", "record_id", "error"))).otherwise(F.col("type"))
    page_of = lambda c: F.expr(f"try_cast(split({c}, ':')[2] as bigint)")
    small = stored(records.select("record_id", "refers_to", checked.alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest"), "warc-records")
    delete_path(spark, path)
    responses = small.where("record_type = 'response'")
    target = responses.select(F.col("record_id").alias("target"), F.col("payload_bytes").alias("n"), F.col("payload_digest").alias("d"))
    again = small.where("record_type = 'revisit'").join(target, F.col("refers_to") == F.col("target"), "left")
    again = again.select(page_of("record_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", page_of("refers_to").alias("refers_to"))
    return responses.select(page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("bigint").alias("refers_to")).unionByName(again)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and their decoding, as digests."""
    encoded = bytebpe.encode(documents(spark, sf_dir))
    encoded = encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bytebpe.decode(encoded, keep=("n_tokens", "ids_sha256")).select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 256 to 2048 tokens."""
    pieces = packing.pack_documents(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return tokencount.count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > 1024)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for white space."""
    return exactdedup.deduplicate(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by a network learned from two thirds of the documents."""
    docs = documents(spark, sf_dir)
    third = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    net = langid.fit(docs.where(third != 1))
    return langid.predict(docs.withColumn("held_out", third == 1), net, keep=("held_out",))


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as GIF frames, read back, with features of the frames."""
    media = gif.store_texts(documents(spark, sf_dir))
    media = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    found = gif.media_columns(media, keep=("doc_id", "n_bytes", "media_bytes", "media_sha256"), pixels=False)
    total = F.expr("aggregate(frames, array_repeat(0L, 64), (a, f) -> zip_with(a, f.histogram, (x, y) -> x + y))")
    bins = F.expr("array_join(filter(transform(bins, (n, i) -> if(n > 0, concat(i, ':', n), null)), x -> x is not null), ' ')")
    feature = F.concat(F.lit("frames="), F.size("frames"), F.lit(";ms="), F.expr("aggregate(frames, 0, (a, f) -> a + f.delay_ms)"), F.lit(";bins="), bins)
    return found.withColumn("bins", total).select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -64, 64)).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written to Parquet list columns and read back."""
    path = new_path(spark, "token-files")
    tokenfile.write_token_files(documents(spark, sf_dir), path)
    found = stored(tokenfile.with_crc32(tokenfile.read_token_files(spark, path), ("doc_id", "start", "n_tokens")), "token-sums")
    delete_path(spark, path)
    return found.withColumn("n_tokens", F.col("n_tokens").cast("long"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A uniform shuffle of all documents into 40 shards of equal counts."""
    text = text_or_empty()
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.shuffled_shards(docs, 40, "doc_id", "text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked by SimHash fingerprints at most 3 bits apart."""
    found = simhash.near_duplicates(documents(spark, sf_dir), words=3, bits=64, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_language_id": op6_language_id,
    "op7_gif": op7_gif,
    "op8_token_files": op8_token_files,
    "op9_sharding": op9_sharding,
    "op10_simhash": op10_simhash,
}

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {1 + 10 * k}, 10))::BIGINT >> {35 - 5 * j}) & 31)::INT, 1)" for k in range(4) for j in range(8)
)

ORACLE: dict[str, str] = {
    "op1_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
        g AS (SELECT t, max(page_id) AS last FROM p GROUP BY t)
        SELECT page_id, strlen(p.t)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
        FROM p JOIN g ON p.t = g.t""",
    "op5_exact_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(t) DESC, doc_id) AS keep_id FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)""",
}
