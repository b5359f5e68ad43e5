"""GIF files as columns: LZW code streams, palettes, transparency, disposal, timed frames.

decode() reads any GIF87a or GIF89a file; media_columns() does so for a column of files
and gives, for each, its frames with their delays and colour histograms. encode()
writes one, and store_texts() keeps texts in files of 64 samples a row.

LZW codes of one run (between two clear codes) have widths that depend on nothing but
their place, so a run's codes are cut from the stream by numpy at once.

Edge cases: a null text counts as empty and is stored as 64 zero bytes; null media give
null columns; a damaged file raises ValueError; equal files give equal columns;
repeated rows and ids give a row each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import no_gc

TABLE = 4096
WIDTH, FRAME_ROWS, DELAY_CS = 64, 256, 10


def _widths(first: int, n: int) -> np.ndarray:
    """Bits of the first n codes of a run whose table begins with `first` entries."""
    known = np.minimum(first - 1 + np.arange(n), TABLE - 1)
    known[0] = first - 1
    return np.frexp(known.astype(np.float64))[1].astype(np.int64)


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    runs: list[list[int]] = []
    codes = [clear]
    table: dict[int, int] = {}
    known, get = end + 1, table.get
    if data:
        stream = iter(data)
        prefix = next(stream)
        put = codes.append
        for b in stream:
            key = prefix << 8 | b
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix)
            if known < TABLE:
                table[key] = known
                known += 1
            else:
                put(clear)
                runs.append(codes)
                codes = []
                put = codes.append
                table.clear()
                known = end + 1
            prefix = b
        put(prefix)
    codes.append(end)
    runs.append(codes)
    # The stream's first clear code stands before the first run, with the least width.
    widths = [np.array([bits + 1], np.int64)]
    for k, run in enumerate(runs):
        widths.append(_widths(end + 1, len(run) - (k == 0)))
    values = np.array([c for run in runs for c in run], np.int64)
    width = np.concatenate(widths)
    place = np.arange(12)
    out = (values[:, None] >> place & 1).astype(np.uint8)[place < width[:, None]]
    return np.packbits(out, bitorder="little").tobytes()


def lzw_decode(data: bytes, bits: int = 8, most: int | None = None) -> bytes:
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    words = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = 8 * len(data)
    run_widths = _widths(end + 1, TABLE + 2)
    run_ends = np.cumsum(run_widths)
    base = [bytes([b]) for b in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at, length = 0, 0
    table, prev, skipped, bit_base = base.copy(), None, 0, 0  # skipped: codes of this run so far
    while at < total:
        # the codes from here on, as if no clear code came
        if skipped < TABLE:
            ends = run_ends[skipped:] - (run_ends[skipped - 1] if skipped else 0)
            widths = run_widths[skipped:]
        else:
            widths = np.full(TABLE, 12)
            ends = np.cumsum(widths)
        n = int(np.searchsorted(ends, total - at, side="right"))
        if not n:
            break
        starts = at + ends[:n] - widths[:n]
        codes = words[starts >> 3] >> (starts & 7).astype(np.uint32) & ((1 << widths[:n]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        upto = int(stops[0]) if len(stops) else n
        known = len(table)
        for c in codes[:upto].tolist():
            if c < known:
                entry = table[c]
            elif c == known and prev is not None:
                entry = prev + prev[:1]
            else:
                raise ValueError("the code stream is damaged")
            if prev is not None and known < TABLE:
                table.append(prev + entry[:1])
                known += 1
            out.append(entry)
            prev = entry
        if not len(stops):
            at += int(ends[n - 1])
            skipped += n
            continue
        at += int(ends[upto])
        if codes[upto] == end:
            break
        table, prev, skipped = base.copy(), None, 0
    return b"".join(out)


@dataclass
class Frame:
    delay_ms: int
    disposal: int
    transparent: int | None
    left: int
    top: int
    samples: np.ndarray  #: palette indices, (rows, columns)
    canvas: np.ndarray  #: the picture shown, RGBA, (height, width, 4)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames, each with the whole canvas as it is shown."""
    try:
        return _decode(data)
    except IndexError as e:
        raise ValueError("the file ends early") from e


def _decode(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    at, general = 13, None

    def palette(at: int, flags: int) -> tuple[np.ndarray, int]:
        n = 2 << (flags & 7)
        table = np.full((256, 4), 255, np.uint8)
        table[:n, :3] = np.frombuffer(data[at : at + 3 * n], np.uint8).reshape(-1, 3)
        return table, at + 3 * n

    if flags & 0x80:
        general, at = palette(at, flags)
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h = (int.from_bytes(data[at + 1 + 2 * k : at + 3 + 2 * k], "little") for k in range(4))
        local, colours = data[at + 9], general
        at += 10
        if local & 0x80:
            colours, at = palette(at, local)
        if colours is None:
            raise ValueError("no palette")
        bits = data[at]
        stream, at = _blocks(data, at + 1)
        flat = np.frombuffer(lzw_decode(stream, bits), np.uint8)
        if len(flat) < w * h:
            raise ValueError("too few samples")
        samples = flat[: w * h].reshape(h, w)
        if local & 0x40:  # interlaced: rows in four passes
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + h, left : left + w]
        shown = samples[: region.shape[0], : region.shape[1]]
        if transparent is None:
            region[:] = colours[shown]
        else:
            solid = shown != transparent
            region[solid] = colours[shown[solid]]
        frames.append(Frame(delay, disposal, transparent, left, top, samples, canvas.copy()))
        if disposal == 2:
            region[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    return width, height, frames


def encode(frames: list[tuple[np.ndarray, int]], palette: np.ndarray, disposal: int = 2) -> bytes:
    """A GIF89a file of (samples, delay in 1/100 s) over one palette of 256 colours."""
    height = max(f.shape[0] for f, _ in frames)
    width = max(f.shape[1] for f, _ in frames)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), b"\xf7\0\0", palette.astype(np.uint8).tobytes()]
    for samples, delay in frames:
        h, w = samples.shape
        out.append(b"\x21\xf9\x04" + bytes([disposal << 2]) + delay.to_bytes(2, "little") + b"\0\0")
        out.append(b"\x2c\0\0\0\0" + w.to_bytes(2, "little") + h.to_bytes(2, "little") + b"\0\x08")
        stream = lzw_encode(samples.tobytes())
        for at in range(0, len(stream), 255):
            part = stream[at : at + 255]
            out += (bytes([len(part)]), part)
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


GREY = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, axis=1)


def text_to_gif(raw: bytes) -> bytes:
    """A payload as grey samples, 64 a row, 256 rows a frame; zero bytes fill its last row."""
    raw += b"\0" * (-len(raw) % WIDTH if raw else WIDTH)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, WIDTH)
    return encode([(rows[at : at + FRAME_ROWS], DELAY_CS) for at in range(0, len(rows), FRAME_ROWS)], GREY)


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of 64 colour bins, two bits a channel, of the pixels that show."""
    r, g, b, alpha = (canvas[..., k] for k in range(4))
    bins = (r >> 6 << 4 | g >> 6 << 2 | b >> 6)[alpha > 0]
    return np.bincount(bins, minlength=64)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, media binary)."""
    rows = df.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                with no_gc():
                    raw = part.column(1).to_pylist()
                    media = [text_to_gif(x) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_bytes long, media binary")


FRAME_TYPE = pa.struct([("delay_ms", pa.int32()), ("disposal", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int32())), ("pixels", pa.binary())])
FRAME_DDL = "struct<delay_ms: int, disposal: int, left: int, top: int, width: int, height: int, histogram: array<int>, pixels: binary>"


def media_columns(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = (), pixels: bool = True) -> DataFrame:
    """(keep..., width, height, samples binary, frames array of structs), a row per file.

    samples: the palette indices of all frames in turn. A frame's pixels are its whole
    RGBA canvas after transparency and disposal (null without `pixels`); its histogram
    is that canvas's.
    """
    rows = df.select(*keep, F.col(media_col).alias("_media"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]), "width int", "height int", "samples binary", f"frames array<{FRAME_DDL}>"])
    names = [*keep, "width", "height", "samples", "frames"]

    def columns(media: bytes | None) -> tuple:
        if media is None:
            return None, None, None, None
        width, height, frames = decode(media)
        shown = [{"delay_ms": f.delay_ms, "disposal": f.disposal, "left": f.left, "top": f.top, "width": f.samples.shape[1], "height": f.samples.shape[0], "histogram": histogram(f.canvas).tolist(), "pixels": f.canvas.tobytes() if pixels else None} for f in frames]
        return width, height, b"".join(f.samples.tobytes() for f in frames), shown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                with no_gc():
                    found = [columns(m) for m in part.column(part.num_columns - 1).to_pylist()]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.list_(FRAME_TYPE))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], names=names)

    return rows.mapInArrow(run, ddl)
