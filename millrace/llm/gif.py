"""GIF media columns: a complete decoder, a writer for byte payloads, and colour-histogram columns."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_texts, tune

WIDTH = 192  # samples in a row, the unit to which payloads are padded
BAND, CANVAS = 256, 4096  # rows of one frame and of the canvas
CLEAR, STOP, FIRST, MOST = 256, 257, 258, 4096
DELAY_CS = 10
#: Of a canvas, and bytes of pixels of one medium and of the rows that a task hands on at once.
MOST_PIXELS, MOST_BYTES, HELD_BYTES = 1 << 26, 1 << 30, 8 << 20


def _schedule(first: int, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Widths of the codes after a clear code and the bits before each, for any least code size."""
    following = first + np.maximum(np.arange(2 * MOST) - 1, 0)
    w = np.clip(np.floor(np.log2(following)).astype(np.int64) + 1, start, 12)
    return w, np.concatenate(([0], np.cumsum(w)[:-1]))


#: By least code size.
_SCHEDULES = {size: _schedule((1 << size) + 2, size + 1) for size in range(2, 9)}


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples. The table is cleared when it is full."""
    codes: list[int] = [CLEAR]
    emit = codes.append
    runs = [1]  # codes at each width schedule, the clear code that begins the first excepted
    table: dict[int, int] = {}
    get, following = table.get, FIRST
    it = iter(data)
    p = next(it)
    for b in it:
        c = get(k := p << 8 | b)
        if c is None:
            emit(p)
            if following < MOST:
                table[k] = following
                following += 1
            else:
                emit(CLEAR)
                runs.append(len(codes))
                table.clear()
                following = FIRST
            p = b
        else:
            p = c
    emit(p)
    emit(STOP)
    runs.append(len(codes))
    widths = np.concatenate([[9], *(_SCHEDULES[8][0][: b - a] for a, b in zip(runs, runs[1:], strict=False))])
    ends = np.cumsum(widths)
    flat = np.repeat(np.asarray(codes, dtype=np.uint16), widths)
    shift = (np.arange(ends[-1]) - np.repeat(ends - widths, widths)).astype(np.uint16)
    return np.packbits((flat >> shift).astype(np.uint8) & 1, bitorder="little").tobytes()


#: Codes behind a table that is full and has not been cleared: all 12 bits wide.
_FULL = (np.full(2 * MOST, 12, dtype=np.int64), 12 * np.arange(2 * MOST))


def lzw_decode(stream: bytes, size: int, most: int) -> bytes:
    """Samples of a code stream with least code size `size`; no more than `most`, what a frame can hold.

    The table may stay full for as long as the encoder likes (a deferred clear); its codes then go on at 12 bits.
    """
    clear, stop = 1 << size, (1 << size) + 1
    raw = np.frombuffer(stream + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    bits, at, made = 8 * len(stream), 0, 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table: list[bytes] | None = None  # none behind a clear code
    prev = b""
    while at < bits and made < most:
        widths, before = _SCHEDULES[size] if table is None else _FULL
        n = int(np.searchsorted(before + widths, bits - at, side="right"))
        where = at + before[:n]
        byte = where >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (where & 7).astype(np.uint32)) & ((1 << widths[:n]) - 1).astype(np.uint32)
        marks = np.flatnonzero((codes == clear) | (codes == stop))
        used = int(marks[0]) if len(marks) else n
        run, had = codes[:used].tolist(), len(out)
        if run and table is None:
            if run[0] >= clear:
                raise ValueError("a code stream begins with a code that has no entry")
            table, prev = roots[:], roots[run[0]]
            out.append(prev)
            del run[0]
        if run:
            grow, put = table.append, out.append
            for c in run:
                if c < len(table):
                    cur = table[c]
                elif c == len(table) and c < MOST:
                    cur = prev + prev[:1]
                else:
                    raise ValueError(f"code {c} has no entry")
                put(cur)
                if len(table) < MOST:
                    grow(prev + cur[:1])
                prev = cur
        made += sum(map(len, out[had:]))
        if len(marks):
            at += int(before[used] + widths[used])
            if codes[used] == stop:
                break
            table = None
        elif n < len(widths):
            break  # the stream ends without a stop code
        else:
            at += int(before[-1] + widths[-1])
    return b"".join(out)[:most]


@dataclass
class Frame:
    """One timed frame: where it was drawn, how long it stays, and the canvas as shown meanwhile."""

    x: int
    y: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int
    canvas: np.ndarray  # rows x columns x RGBA, a view that is valid until the next frame is asked for

    def shown(self) -> np.ndarray:
        return self.canvas[self.y : self.y + self.height, self.x : self.x + self.width]


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise ValueError("sub-blocks without an end")
        n = data[at]
        if n == 0:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    rgb = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
    table = np.zeros((256, 4), dtype=np.uint8)
    table[:n, :3], table[:n, 3] = rgb, 255
    return table, at + 3 * n


#: Pixels that a byte of a code stream can stand for at most: codes of 12 bits, none longer than the table.
EXPANSION = MOST * 8 // 12 + 1


def frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF in order, each composed by the palette, disposal and transparency rules.

    A frame that claims more pixels than its stored bytes can hold is refused before anything is allocated for it,
    and so is a canvas of more than most_pixels.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF signature")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    if width * height > most_pixels:
        raise ValueError(f"a canvas of {width} x {height} pixels, more than {most_pixels}")
    canvas = np.zeros((height, width, 4), dtype=np.uint8)
    delay = disposal = 0
    transparent = -1
    while True:
        if at >= len(data):
            raise ValueError("no trailer")
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1]
            body, at = _blocks(data, at + 2)
            if label == 0xF9:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"block {kind:#x} is unknown")
        x, y, w, h, bits = struct.unpack_from("<HHHHB", data, at + 1)
        at += 10
        palette = common
        if bits & 0x80:
            palette, at = _palette(data, at, bits)
        if palette is None:
            raise ValueError("a frame without a palette")
        size = data[at]
        stream, at = _blocks(data, at + 1)
        if not 2 <= size <= 8:
            raise ValueError(f"least code size {size}")
        if w * h > EXPANSION * len(stream):
            raise ValueError("a frame with more pixels than its bytes can hold")
        samples = np.frombuffer(lzw_decode(stream, size, w * h), dtype=np.uint8)
        if len(samples) < w * h:
            raise ValueError("a frame with too few samples")
        samples = samples.reshape(h, w)
        if bits & 0x40:  # interlaced
            order = [r for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(first, h, step)]
            rows = np.empty_like(samples)
            rows[order] = samples
            samples = rows
        area = canvas[y : y + h, x : x + w]
        kept = area.copy() if disposal == 3 else None
        samples = samples[: area.shape[0], : area.shape[1]]
        drawn = palette[samples]
        if transparent >= 0:
            seen = samples != transparent
            area[seen] = drawn[seen]
        else:
            area[:] = drawn
        yield Frame(x, y, area.shape[1], area.shape[0], delay, disposal, transparent, canvas)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            area[:] = kept
        delay, disposal, transparent = 0, 0, -1


_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def padded(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of WIDTH."""
    return data + b" " * (-len(data) % WIDTH or (0 if data else WIDTH))


def write_gif(payload: bytes) -> bytes:
    """A GIF whose frames, bands of WIDTH columns drawn one after another, hold the payload's bytes as grey samples."""
    rows = len(payload) // WIDTH
    if not rows or len(payload) % WIDTH:
        raise ValueError(f"a payload is a positive multiple of {WIDTH} bytes")
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, CANVAS), 0xF7, 0, 0), _GREY]
    for first in range(0, rows, BAND):
        n = min(BAND, rows - first)
        stream = lzw_encode(payload[first * WIDTH : (first + n) * WIDTH])
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, DELAY_CS, 0, 0), b"\x2c", struct.pack("<HHHHB", 0, first % CANVAS, WIDTH, n, 0), b"\x08"]
        for k in range(0, len(stream), 255):
            part = stream[k : k + 255]
            out += [bytes([len(part)]), part]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every whole text's UTF-8 bytes, padded, as a GIF.

    A null text counts as empty and gives one row of spaces. Equal texts give equal media; repeated rows and
    null keys are kept; an empty table gives an empty one. Other columns are not read.
    """

    def build():
        def step(texts: list) -> list:
            raw = [(t or "").encode() for t in texts]
            return [list(map(len, raw)), pa.array([write_gif(padded(r)) for r in raw], pa.binary())]

        return step

    return map_texts(docs, build, "n_bytes long, media binary", key, text)


FRAME = "struct<start_ms:int,delay_ms:int,x:int,y:int,width:int,height:int,disposal:int,transparent:int,colours:array<int>>"


def decode_column(df: DataFrame, key: str = "doc_id", media: str = "media", others: tuple[str, ...] = (), channels: int = 3, most_pixels: int = MOST_PIXELS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, *others, frames, pixels, greys, error): each GIF's timed frames and histograms.

    frames: when each begins and how long it stays, its place, disposal and transparent index, and colours: how many
    pixels of its area, as shown, fall into each of 64 colours (two bits of red, green, blue). pixels: what the frames'
    areas show, row by row, frame after frame, with the first `channels` of RGBA; greys: how many of these pixels
    fall into each of 16 levels of grey. Media that is null or can't be decoded, whose canvas has more than most_pixels
    or whose frames show more than most_bytes gives nulls and says why in error. A task holds the pixels of one
    medium and of about HELD_BYTES more, however much the format packs.
    """
    tune(df.sparkSession)
    df = df.select(key, *others, media)
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *others))
    schema = f"{head}, frames array<{FRAME}>, pixels binary, greys array<long>, error string"
    kind = pa.list_(pa.struct([*((n, pa.int32()) for n in ("start_ms", "delay_ms", "x", "y", "width", "height", "disposal", "transparent")), ("colours", pa.list_(pa.int32()))]))

    def one(data: bytes | None) -> tuple:
        if data is None:
            return None, None, None, "null"
        try:
            found, parts, start, size = [], [], 0, 0
            greys = np.zeros(16, np.int64)
            for f in frames(data, most_pixels):
                rgba = f.shown().reshape(-1, 4)
                size += channels * len(rgba)
                if size > most_bytes:
                    raise ValueError(f"more than {most_bytes} bytes of pixels")
                r, g, b = rgba[:, 0], rgba[:, 1], rgba[:, 2]
                colours = np.bincount((r >> 6) << 4 | (g >> 6) << 2 | b >> 6, minlength=64).tolist()
                found.append({"start_ms": start, "delay_ms": 10 * f.delay_cs, "x": f.x, "y": f.y, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "colours": colours})
                start += 10 * f.delay_cs
                parts.append(np.ascontiguousarray(rgba[:, :channels]).tobytes())
                greys += np.bincount(((r.astype(np.uint16) + g + b) // 48).astype(np.uint8), minlength=16)
            return found, b"".join(parts), greys.tolist(), None
        except (ValueError, IndexError, MemoryError, struct.error) as e:
            return None, None, None, str(e)

    made = (kind, pa.binary(), pa.list_(pa.int64()), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, rows, held = 0, [], 0

            def flush(end: int) -> pa.RecordBatch:
                columns = [c.slice(first, end - first) for c in batch.columns[:-1]]  # noqa: B023
                return pa.RecordBatch.from_arrays(columns + [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), made, strict=True)], [key, *others, "frames", "pixels", "greys", "error"])  # noqa: B023

            for k, media in enumerate(batch.column(batch.num_columns - 1)):
                rows.append(one(media.as_py()))
                held += len(rows[-1][1] or b"")
                if held >= HELD_BYTES or len(rows) >= 256:
                    yield flush(k + 1)
                    first, rows, held = k + 1, [], 0
            if rows:
                yield flush(batch.num_rows)

    return df.mapInArrow(run, schema)


def frame_rows(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each frame of decoded media: (key, frame, start_ms, delay_ms, place, disposal, transparent, colours)."""
    return decoded.select(key, F.posexplode("frames").alias("frame", "f")).select(key, "frame", "f.*")
