"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames.

``store_texts`` keeps any bytes losslessly as 8-bit samples of an animated GIF and reads
them back from the file; ``decode_frames`` turns a column of GIF files into one row per
timed frame, rendered by the disposal and transparency rules, with colour histograms.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import column, emit_rows, map_columns, without

WIDTH = 64
FRAME_ROWS = 1024
#: A file that declares a larger canvas or frame is not decoded.
MAX_PIXELS = 1 << 26
DELAY_CS = 10
GREY = bytes(x for i in range(256) for x in (i, i, i))
_BITS = np.arange(12, dtype=np.uint16)


@cache
def _schedule(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code until the table is full, and their bit offsets."""
    clear = 1 << least
    entries = np.arange(clear + 1, 4096)
    entries = np.concatenate(([clear + 2], entries[1:]))
    widths = np.minimum(12, np.maximum(least + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))
    return widths, np.concatenate(([0], np.cumsum(widths)))


def lzw_encode(samples: bytes) -> bytes:
    """LZW code stream of 8-bit samples, table cleared when full."""
    codes = [256]
    emit, table = codes.append, {}
    find, new = table.get, 258
    if samples:
        it = iter(samples)
        prefix = next(it)
        for b in it:
            key = prefix << 8 | b
            code = find(key)
            if code is not None:
                prefix = code
                continue
            emit(prefix)
            table[key] = new
            new += 1
            if new == 4096:
                emit(256)
                table.clear()
                new = 258
            prefix = b
        emit(prefix)
    emit(257)
    widths = _schedule(8)[0]
    n = len(codes) - 1
    width = np.concatenate(([9], np.resize(widths, n))) if n else np.array([9])
    bits = (np.array(codes, dtype=np.uint16)[:, None] >> _BITS) & 1
    return np.packbits(bits.astype(np.uint8)[_BITS < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, least: int) -> bytes:
    """Samples of an LZW code stream with ``least`` bits per sample.

    A stream may clear its table at any time, or leave it full; one that ends early
    gives what it holds.
    """
    clear, stop = 1 << least, (1 << least) + 1
    widths, offsets = _schedule(least)
    data = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    total, pos = 8 * len(stream), 0
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table, last, full = base[:], None, False
    while True:
        if full:
            n = min(4096, (total - pos) // 12)
            at, width = pos + 12 * np.arange(n), np.full(n, 12)
        else:
            n = int(np.searchsorted(offsets, total - pos, side="right")) - 1
            n = min(n, len(widths))
            at, width = pos + offsets[:n], widths[:n]
        if n <= 0:
            return b"".join(out)
        byte = at >> 3
        codes = ((data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (at & 7).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        end = int(marks[0]) if len(marks) else n
        for c in codes[:end].tolist():
            if last is None:
                entry = table[c] if c < clear else b""
            elif c < len(table):
                entry = table[c]
            elif c == len(table) and not full:
                entry = last + last[:1]
            else:
                raise ValueError("a code that is not in the table")
            if last is not None and len(table) < 4096:
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
        if end < n:
            if codes[end] == stop:
                return b"".join(out)
            pos = int(at[end] + width[end])
            table, last, full = base[:], None, False
        else:
            pos = int(at[-1] + width[-1])
            if not full and n < len(widths):
                return b"".join(out)
            full = True


@dataclass
class Frame:
    """One image of a file: its samples as stored and how to show them."""

    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    palette: bytes
    samples: bytes


def write_gif(frames: list[Frame], width: int, height: int) -> bytes:
    """A GIF89a file; the first frame's palette is the global one."""
    palette = frames[0].palette if frames else GREY
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        flags = f.disposal << 2 | (f.transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", flags, f.delay_cs, f.transparent or 0, 0))
        own = b"" if f.palette == palette else f.palette
        out.append(b"\x2c" + struct.pack("<HHHHB", f.left, f.top, f.width, f.height, 0x87 if own else 0) + own + b"\x08")
        stream = lzw_encode(f.samples)
        for at in range(0, len(stream), 255):
            part = stream[at : at + 255]
            out += (bytes((len(part),)), part)
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


def read_gif(file: bytes, max_pixels: int = MAX_PIXELS) -> tuple[int, int, list[Frame]]:
    """Width, height and frames of a GIF file; ``ValueError`` if it is none, or declares a larger image."""
    if file[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = struct.unpack_from("<HHB", file, 6)
    if width * height > max_pixels:
        raise ValueError("a canvas beyond the limit")
    at, shared = 13, b""
    if flags & 0x80:
        size = 3 << (flags & 7) + 1
        shared, at = file[at : at + size], at + size
    frames, control = [], (0, 0, None)

    def blocks(at):
        parts = []
        while n := file[at]:
            parts.append(file[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    while file[at] != 0x3B:
        if file[at] == 0x21:
            kind = file[at + 1]
            body, at = blocks(at + 2)
            if kind == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", body)
                control = (packed >> 2 & 7, delay, index if packed & 1 else None)
            continue
        left, top, w, h, flags = struct.unpack_from("<HHHHB", file, at + 1)
        if w * h > max_pixels:
            raise ValueError("a frame beyond the limit")
        at, palette = at + 10, shared
        if flags & 0x80:
            size = 3 << (flags & 7) + 1
            palette, at = file[at : at + size], at + size
        least = file[at]
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, least)[: w * h].ljust(w * h, b"\0")
        if flags & 0x40:  # interlaced: rows were stored in four passes
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = {y: samples[i * w : i * w + w] for i, y in enumerate(order)}
            samples = b"".join(rows[y] for y in range(h))
        frames.append(Frame(left, top, w, h, control[1], control[0], control[2], palette, samples))
        control = (0, 0, None)
    return width, height, frames


def render(width: int, height: int, frames: list[Frame]):
    """The canvas (rows, columns, RGBA) as it is shown at each frame.

    Transparent samples leave what is below; disposal 2 clears the frame's area, 3 puts
    back what was there before.
    """
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        samples = np.frombuffer(f.samples, dtype=np.uint8).reshape(f.height, f.width)[: area.shape[0], : area.shape[1]]
        colours = np.zeros((256, 4), dtype=np.uint8)
        rgb = np.frombuffer(f.palette, dtype=np.uint8).reshape(-1, 3)
        colours[: len(rgb), :3] = rgb
        colours[:, 3] = 255
        shown = samples != f.transparent if f.transparent is not None else np.ones(samples.shape, dtype=bool)
        area[shown] = colours[samples[shown]]
        yield canvas.copy()
        if f.disposal == 2:
            area[:] = 0
        elif before is not None:
            canvas = before


def text_payload(text: str | None) -> bytes:
    """A text's UTF-8 with bytes 0 appended up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def payload_gif(payload: bytes) -> bytes:
    """The payload as grey samples, 64 to a row, 1024 rows to a timed frame."""
    size = WIDTH * FRAME_ROWS
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    frames = [Frame(0, 0, WIDTH, len(p) // WIDTH, DELAY_CS, 1, None, GREY, p) for p in parts]
    return write_gif(frames, WIDTH, frames[0].height)


def shown_frames(file: bytes, max_pixels: int = MAX_PIXELS):
    """Frame, milliseconds at which it is shown, canvas and 16-bin histograms of red, green, blue.

    Fully transparent pixels count in no histogram.
    """
    width, height, frames = read_gif(file, max_pixels)
    start = 0
    for frame, canvas in zip(frames, render(width, height, frames)):
        seen = canvas[canvas[:, :, 3] > 0] >> 4
        yield frame, start, canvas, [np.bincount(seen[:, c], minlength=16).tolist() for c in range(3)]
        start += 10 * frame.delay_cs


def gif_payload(file: bytes) -> bytes:
    """The payload read back: the red of each frame's own area, as it is shown."""
    return b"".join(canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes() for f, _, canvas, _ in shown_frames(file))


def store_texts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, gif, payload, frames``; payload and frames are read back from ``gif``.

    A null or empty text is one row of zeros. Long texts take more frames, never a cut.
    The file is decoded and rendered: ``frames`` has ``start_ms, delay_ms, hist_r, hist_g,
    hist_b`` of each timed frame, 16 bins a colour. Columns of these names are replaced,
    others stay; nothing depends on other rows; an empty table gives none.
    """
    docs = without(docs, "n_bytes", "gif", "payload", "frames")
    schema = T.StructType.fromDDL("n_bytes long, gif binary, payload binary, frames array<struct<start_ms: long, delay_ms: long, hist_r: array<long>, hist_g: array<long>, hist_b: array<long>>>")
    fields, kinds = schema.fields, to_arrow_schema(schema).types

    def make():
        def f(batch):
            out: list[list] = [[], [], [], []]
            for text in column(batch, text_col):
                file, parts, shown = payload_gif(text_payload(text)), [], []
                for x, start, canvas, (r, g, b) in shown_frames(file):
                    parts.append(canvas[x.top : x.top + x.height, x.left : x.left + x.width, 0].tobytes())
                    shown.append({"start_ms": start, "delay_ms": 10 * x.delay_cs, "hist_r": r, "hist_g": g, "hist_b": b})
                for held, value in zip(out, (len((text or "").encode("utf-8", "surrogatepass")), file, b"".join(parts), shown)):
                    held.append(value)
            return [pa.array(x, k) for x, k in zip(out, kinds)]

        return f

    return map_columns(docs, make, fields, docs.columns)


FRAME_FIELDS = "frame int, start_ms long, delay_ms long, disposal int, width int, height int, rgba binary, hist_r array<long>, hist_g array<long>, hist_b array<long>, error string"


def decode_frames(files: DataFrame, *, id_col: str = "doc_id", gif_col: str = "gif", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per frame of each GIF: when it is shown, its rendered pixels, 16-bin colour histograms.

    Fully transparent pixels count in no histogram. A null file has no frames. An empty
    or broken file, or one that declares more than ``max_pixels``, has a row with ``error``
    after the frames before it. Other columns are not read; an empty table gives none.
    """
    schema = T.StructType([files.schema[id_col], *T.StructType.fromDDL(FRAME_FIELDS)])
    kinds = to_arrow_schema(T.StructType.fromDDL(FRAME_FIELDS)).types

    def make():
        def f(batch):
            for key, file in zip(batch.column(batch.schema.get_field_index(id_col)), column(batch, gif_col)):
                if file is None:
                    continue
                found, i = shown_frames(file, max_pixels), 0
                while True:
                    try:
                        frame, start, canvas, hists = next(found)
                        row = [i, start, 10 * frame.delay_cs, frame.disposal, canvas.shape[1], canvas.shape[0], canvas.tobytes(), *hists, None]
                    except StopIteration:
                        break
                    except (ValueError, IndexError, struct.error) as e:
                        row = [i, *[None] * 9, str(e) or type(e).__name__]
                    yield [pa.array([key.as_py()], key.type), *(pa.array([v], k) for v, k in zip(row, kinds))]
                    if row[-1] is not None:
                        break
                    i += 1

        return f, None

    return emit_rows(files.select(id_col, gif_col), make, schema, rows=64)
