import base64
import gzip
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskspark.llm import gif, langid, warc
from maskspark.llm.common import new_path, stored


@pytest.mark.parametrize("alphabet", [1, 2, 5, 256])
def test_lzw_round_trip(alphabet):
    rng = random.Random(alphabet)
    for n in (0, 1, 2, 63, 300, 5_000, 70_000):
        data = bytes(rng.randrange(alphabet) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode(data)) == data


def test_known_gif_file():
    """The three-colour sample picture of the format's common tutorial: ten by ten, in code sizes of two bits."""
    raw = bytes.fromhex(
        "47494638396 10A000A00910000FFFFFFFF00000000FF00000021F90400000000002C000000000A000A0000021 68C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B".replace(" ", "")
    )
    width, height, (frame,) = gif.decode(raw)
    assert (width, height) == (10, 10) and frame.samples[0].tolist() == [1, 1, 1, 1, 1, 2, 2, 2, 2, 2]
    assert frame.canvas[0, 0].tolist() == [255, 0, 0, 255] and frame.canvas[0, 9].tolist() == [0, 0, 255, 255]


def two_frames(disposal, transparent):
    """A red square under a smaller picture of one blue and one transparent pixel."""
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 0, 255)
    raw = bytearray(gif.encode([(np.full((2, 2), 1, np.uint8), 5), (np.array([[2, 0]], np.uint8), 7), (np.array([[2]], np.uint8), 9)], palette, disposal))
    if transparent:
        at = -1
        while (at := raw.find(b"\x21\xf9\x04", at + 1)) >= 0:
            raw[at + 3] |= 1
    return gif.decode(bytes(raw))[2]


@pytest.mark.parametrize(("disposal", "corner"), [(1, [255, 0, 0, 255]), (2, [0, 0, 0, 0]), (3, [0, 0, 0, 0])])
def test_disposal_and_transparency(disposal, corner):
    first, second, third = two_frames(disposal, True)
    assert (first.delay_ms, second.delay_ms, third.delay_ms) == (50, 70, 90)
    assert second.canvas[0, 0].tolist() == [0, 0, 255, 255] and third.canvas[1, 1].tolist() == corner and second.canvas[0, 1].tolist() == corner
    assert gif.histogram(first.canvas)[0b110000] == 4


def test_damaged_files():
    whole = gif.text_to_gif(b"hello")
    for raw in (b"", b"GIF", b"PNG" + whole[3:], whole[:-20], whole[:820]):
        with pytest.raises(ValueError):
            gif.decode(raw)


def test_media_columns(spark, docs, empty, awkward):
    media = gif.store_texts(docs)
    rows = gif.media_columns(media, keep=("doc_id", "n_bytes")).collect()
    want = sorted((i or 0, len((t or "").encode()), (t or "").encode()) for i, t in awkward)
    for (i, n, raw), r in zip(want, sorted(rows, key=lambda r: (r.doc_id or 0, r.n_bytes, bytes(r.samples))), strict=True):
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r.doc_id or 0, r.n_bytes, bytes(r.samples)) == (i, n, padded) and r.width == 64
        assert sum(f.width * f.height for f in r.frames) == len(padded) and sum(r.frames[0].histogram) == 64 * r.frames[0].height and len(r.frames[0].pixels) == 4 * 64 * r.height
    assert gif.media_columns(gif.store_texts(empty)).count() == 0
    assert gif.media_columns(spark.createDataFrame([(None,)], "media binary")).head().frames is None


LATIN = {"aa": "lorem ipsum dolor sit amet", "bb": "über straße größe müßig schön", "cc": "zxq wvk jjq kxz qqw"}


def test_language_network(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(LATIN[lang].split()) for _ in range(rng.randint(20, 200))), lang) for i in range(240) for lang in [rng.choice(list(LATIN))]]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 ... 😀", "cc"), (903, "lorem ipsum lorem", None), (None, "zxq wvk", "cc"), (904, "größe " * 20_000, None), (904, "größe " * 20_000, None)]
    table = stored(spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")), "test-languages")
    net = langid.fit(table.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 != 1), docs_per_language=40)
    got = langid.predict(table, net).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in rows[:240] if __import__("zlib").crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 50 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[903].lang_pred == "aa" and by[904].lang_pred == "bb"
    assert langid.fit(table.where("lang is null")) is None and langid.predict(table, None).where("lang_pred <> 'und'").count() == 0
    assert langid.predict(table.limit(0), net).count() == 0


def test_both_ways_to_predict_agree():
    net = langid.ByteConvNet(["x", "y"], length=32)
    x = np.random.default_rng(1).integers(0, 200, (50, 32)).astype(np.uint8)
    features, _ = net._maxima(x)
    assert np.allclose(net.predict(x, block=7), langid.softmax(features @ net.dense + net.offset), atol=1e-5)


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (7, "http://a/7\r\nX: y", "<p>same</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 3000), (6, "u", "x"), (7, "http://a/7", "<p>same</p>"), (None, "u", "orphan"), (None, "u", "<p>same</p>")]


def pages_table(spark, rows):
    return stored(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash")), "test-pages")


def test_warc_round_trip(spark):
    path = new_path(spark, "test-warc")
    warc.write_pages(pages_table(spark, PAGES), path, segment_bytes=700, chunk_bytes=100, records_per_file=4)
    rows = warc.read_archives(spark, path).collect()
    assert len(rows) == len(PAGES) and not [r for r in rows if r.error]
    page = lambda x: x.split(":")[2] or None
    responses = {r.record_id: r for r in rows if r.type == "response"}
    same = [r for r in responses.values() if r.payload == b"<p>same</p>"]
    assert len(same) == 1 and page(same[0].record_id) == "7"
    again = [r for r in rows if r.type == "revisit"]
    assert sorted(page(r.record_id) or "" for r in again if r.refers_to == same[0].record_id) == ["", "1", "2", "7"]
    whole = {page(r.record_id): r for r in responses.values()}
    assert whole["5"].payload.decode() == PAGES[5][2] and whole["5"].payload_digest == base64.b32encode(hashlib.sha1(PAGES[5][2].encode()).digest()).decode()
    assert {page(r.record_id) for r in responses.values() if r.payload == b""} == {"4"}
    small = new_path(spark, "test-warc")
    warc.write_pages(pages_table(spark, PAGES), small, least_revisit_bytes=50)
    assert warc.read_archives(spark, small).where("type = 'revisit'").count() == 0
    none = new_path(spark, "test-warc")
    warc.write_pages(pages_table(spark, PAGES).limit(0), none)
    assert warc.read_archives(spark, none).count() == 0


def gzip_members(n):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 1_900
    made = [gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(block), block), 1) for i in range(4)]
    return b"".join(made * (n // 4)), block


def test_reading_grows_with_the_members():
    """A member for each record, 16,000 of them: reading one takes no longer than in a short file."""
    took = {}
    for n in (2_000, 16_000):
        raw, block = gzip_members(n)
        began = time.perf_counter()
        assert sum(b == block and e is None for _, b, e in warc.records_in(raw)) == n
        took[n] = time.perf_counter() - began
    assert took[16_000] < 8 * 3 * took[2_000] + 1


def test_large_records_pass_in_pieces():
    body = random.Random(1).randbytes(3_000_000) + b"\r\n\r\nWARC/1.1\r\n" + b"\0" * 9_000_000
    raw = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    for data in (raw, gzip.compress(raw, 1), gzip.compress(raw[:5], 1) + gzip.compress(raw[5:70_000], 1) + gzip.compress(raw[70_000:], 1)):
        assert [(b == body, e) for _, b, e in warc.records_in(data)] == [(True, None)]
    assert list(warc.records_in(b"")) == [] and list(warc.records_in(b"\r\n\r\n")) == []


def damaged(kind):
    """An archive whose second of three records is damaged, and what is wrong with it."""
    good = lambda i: b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nContent-Length: 24\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody%d\r\n\r\n" % (i, i)
    one, two, three = map(good, (1, 2, 3))
    if kind == "cut member":
        return gzip.compress(one) + gzip.compress(two * 50)[:40] + gzip.compress(three), "a member is damaged"
    if kind == "flipped member":
        raw = bytearray(gzip.compress(two * 50))
        raw[20] ^= 0xFF
        return gzip.compress(one) + bytes(raw) + gzip.compress(three), None
    wrong = {
        "bad length": (two.replace(b"Length: 24", b"Length: many"), "Content-Length missing or no number"), "no length": (two.replace(b"Content-Length: 24\r\n", b""), "Content-Length missing or no number"),
        "long length": (two.replace(b"Length: 24", b"Length: 99999"), "the record ends early"), "short length": (two.replace(b"Length: 24", b"Length: 20"), "no record where one should begin"),
        "negative length": (two.replace(b"Length: 24", b"Length: -4"), "Content-Length missing or no number"), "no record": (b"nothing of the kind\r\n\r\n", "no record where one should begin"),
        "bad segment": (two.replace(b"Content-", b"WARC-Segment-Number: x\r\nContent-"), "warc-segment-number is no number"),
    }
    raw, error = wrong[kind]
    return one + raw + three, error


@pytest.mark.parametrize("kind", ["cut member", "flipped member", "bad length", "no length", "long length", "short length", "negative length", "no record", "bad segment"])
def test_damage_becomes_rows(spark, tmp_path, kind):
    raw, error = damaged(kind)
    (tmp_path / "a.warc").write_bytes(raw)
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    payloads = {r.record_id: bytes(r.payload) for r in rows if r.error is None}
    assert payloads.get("<1>") == b"body1" and payloads.get("<3>") == b"body3"
    errors = [r.error for r in rows if r.error is not None]
    assert errors and (error is None or error in errors)


def test_archives_cut_short():
    raw, _ = gzip_members(8)
    whole = sum(1 for _ in warc.records_in(raw))
    for cut in (5, 9, 30, len(raw) // 2 + 7, len(raw) - 3):
        found = list(warc.records_in(raw[:cut]))
        assert found[-1][2] is not None
        assert sum(e is None for _, _, e in found) <= whole
    plain = gzip.decompress(raw)
    assert [e for _, _, e in warc.records_in(plain[:-500])][-1] == "the record ends early"
    assert [e for _, _, e in warc.records_in(plain[:40])] == ["a record ends within its headers"]


def test_warc_damage(spark, tmp_path):
    def record(kind, name, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": name, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
        return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"

    body = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n3;x=y\r\nefg\r\n0\r\n\r\n"
    parts = [
        record("warcinfo", "<i>", b"x"), record("continuation", "<1b>", body[30:], WARC_Segment_Origin_ID="<1>", WARC_Segment_Number=2, WARC_Segment_Total_Length=len(body)),
        record("response", "<1>", body[:30], WARC_Segment_Number=1), record("response", "<2>", body[:30], WARC_Segment_Number=1), record("continuation", "<2b>", body[30:], WARC_Segment_Origin_ID="<2>", WARC_Segment_Number=2, WARC_Segment_Total_Length=7),
        record("continuation", "<3b>", body, WARC_Segment_Origin_ID="<3>", WARC_Segment_Number=2, WARC_Segment_Total_Length=9), record("response", "<4>", b"HTTP/1.1 200 OK\r\n\r\nplain"), record("response", "<5>", body[:-12]),
        record("response", "<6>", body, WARC_Payload_Digest="sha1:AAAA"), record("response", "<7>", b"no headers"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))  # a member for each record
    (tmp_path / "b.warc").write_bytes(record("response", "<8>", body))
    got = {r.record_id: (None if r.payload is None else bytes(r.payload), r.error) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got["<1>"] == got["<8>"] == (b"abcdefg", None) and got["<4>"] == (b"plain", None)
    assert [got[k][1] for k in ("<2>", "<3b>", "<6>", "<7>")] == ["total length wrong", "origin record missing", "payload digest wrong", "HTTP headers missing"] and got["<5>"][1]
