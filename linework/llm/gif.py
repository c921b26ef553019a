"""GIF media columns: LZW code streams, palettes, interlacing, disposal and transparency, timed frames, colour histograms.

encode() makes a GIF of 8-bit samples; decode() reads any GIF87a or GIF89a. Decoding works on whole arrays: between two
clear codes an entry of the code table is the text already put out at one earlier place plus the byte after it, so a code
stream is a set of copies from its own output, which pointer doubling resolves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linework.llm.common import documents
from linework.llm.kernels import tidied

WIDTH = 64
#: Rows of a frame that encode() makes: 16 KB.
ROWS = 256
DELAY = 4  # hundredths of a second
TABLE = 4096
HISTOGRAM_BINS = 16


#: Pixels of a screen that decode() composes, at most: a header of a few bytes may ask for four thousand million.
MOST_PIXELS = 1 << 26
#: Frames that a batch of results holds.
BATCH_FRAMES = 1024


class GifError(ValueError):
    """Not a GIF, cut off, or of a screen beyond MOST_PIXELS."""


def _widths(n: int, size: int) -> np.ndarray:
    """Bits of the first n codes after a clear code, as a decoder reads them."""
    made = np.minimum(np.maximum(np.arange(n) - 1, 0) + (1 << size) + 2, TABLE - 1)
    return np.maximum(np.floor(np.log2(made)).astype(np.int64) + 1, size + 1)


_schedules: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _schedule(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and bit offset of each code after a clear code, while the table grows; then codes keep 12 bits."""
    if size not in _schedules:
        w = _widths(TABLE + 1, size)
        _schedules[size] = w, np.concatenate([[0], np.cumsum(w)])
    return _schedules[size]


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """LZW code stream of samples below 2 ** size; a clear code comes first and whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    codes: list[int] = [clear]
    cuts: list[int] = [0]  # where the clear codes are
    put = codes.append
    table: dict[int, int] = {}
    known = table.get
    free = end + 1
    it = iter(samples)
    code = next(it, -1)
    for x in it:
        key = code << 8 | x
        if (found := known(key)) is not None:
            code = found
            continue
        put(code)
        code = x
        if free < TABLE - 1:
            table[key] = free
            free += 1
        else:
            cuts.append(len(codes))
            put(clear)
            table.clear()
            free = end + 1
    if code >= 0:
        put(code)
    put(end)
    values = np.array(codes, np.uint32)
    bounds = [*cuts, len(codes)]
    widths = np.empty(len(codes), np.int64)
    grow, _ = _schedule(size)
    for a, b in zip(bounds, bounds[1:], strict=False):
        # The clear code has the width in force before it; the codes after it start anew.
        widths[a] = size + 1 if a == 0 else grow[a - last - 1]
        widths[a + 1 : b] = grow[: b - a - 1]
        last = a
    at = np.cumsum(widths) - widths
    bits = np.zeros(int(at[-1] + widths[-1]) + 16, np.uint8)
    for k in range(12):
        live = widths > k
        bits[at[live] + k] = values[live] >> np.uint32(k) & np.uint32(1)
    return np.packbits(bits[: int(at[-1] + widths[-1])], bitorder="little").tobytes()


def lzw_decode(stream: bytes, size: int, expected: int) -> np.ndarray:
    """The first `expected` samples of a code stream; short streams leave zeros, as viewers show them."""
    samples = lzw_samples(stream, size, expected)
    return np.concatenate([samples, np.zeros(expected - len(samples), np.uint8)]) if len(samples) < expected else samples


def lzw_samples(stream: bytes, size: int, expected: int) -> np.ndarray:
    """The samples that a code stream has, of `expected` at most."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(8, np.uint8)]).astype(np.uint32)
    total_bits = 8 * len(stream)
    grow, at = _schedule(size)
    out: list[np.ndarray] = []
    made = bit = 0
    done = False
    while made < expected and not done and bit < total_bits:
        n = int(np.searchsorted(at, total_bits - bit, side="right")) - 1
        n = min(n, TABLE)
        if n <= 0:
            break
        codes = _codes(raw, bit + at[:n], grow[:n])
        stops = np.flatnonzero((codes == clear) | (codes == end))
        if len(stops):
            k = int(stops[0])
            done = codes[k] == end
            used, codes = int(at[k + 1]), codes[:k]
        else:
            used = int(at[n])
            if n == TABLE:  # the table is full: 12-bit codes follow until a clear code
                more = [codes]
                while bit + used + 12 <= total_bits:
                    m = min(1 << 14, (total_bits - bit - used) // 12)
                    part = _codes(raw, bit + used + 12 * np.arange(m), np.full(m, 12))
                    stops = np.flatnonzero((part == clear) | (part == end))
                    if len(stops):
                        k = int(stops[0])
                        done = part[k] == end
                        more.append(part[:k])
                        used += 12 * (k + 1)
                        break
                    more.append(part)
                    used += 12 * m
                codes = np.concatenate(more)
        bit += used
        if len(codes):
            piece = _expanded(codes, size)[: expected - made]
            out.append(piece)
            made += len(piece)
    return np.concatenate(out) if out else np.zeros(0, np.uint8)


def _codes(raw: np.ndarray, bits: np.ndarray, widths: np.ndarray) -> np.ndarray:
    byte = bits >> 3
    word = raw[byte] | raw[byte + 1] << np.uint32(8) | raw[byte + 2] << np.uint32(16)
    return (word >> (bits & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)).astype(np.int64)


def _expanded(codes: np.ndarray, size: int) -> np.ndarray:
    """Samples of the codes between two clear codes."""
    first = (1 << size) + 2
    n = len(codes)
    entry = codes - first  # entry j is what code j put out, plus one sample
    copies = entry >= 0
    bad = copies & (entry >= np.arange(n))
    if bad.any():  # a code that the table doesn't have yet ends the picture
        n = int(np.argmax(bad))
        codes, entry, copies = codes[:n], entry[:n], copies[:n]
    if not n:
        return np.zeros(0, np.uint8)
    # Lengths: one more than the entry's own code, down to a plain sample.
    length = np.ones(n, np.int64)
    to = np.where(copies, entry, -1)
    length[copies] = 2
    step = np.where(copies, 1, 0)
    while (live := to >= 0).any():
        seen = to[live]
        step[live] += step[seen]
        to[live] = to[seen]
    length = step + 1
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    owner = np.repeat(np.arange(n), length)
    source = np.arange(total)
    copied = copies[owner]
    by = owner[copied]
    source[copied] += start[entry[by]] - start[by]
    while True:
        further = source[source]
        if np.array_equal(further, source):
            break
        source = further
    root = owner[source]
    return codes[root].astype(np.uint8)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREY = bytes(x for v in range(256) for x in (v, v, v))


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF89a whose frames hold the samples (a positive multiple of width) as palette indices of a grey ramp.

    Every frame is of the full height or the last one's, placed at the top left and left in place.
    """
    height = min(rows, len(samples) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), GREY]
    for i in range(0, len(samples), width * rows):
        part = samples[i : i + width * rows]
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 1 << 2, delay, 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0))
        out.append(b"\x08" + _blocks(lzw_encode(part)))
    out.append(b";")
    return b"".join(out)


@dataclass
class Frame:
    """One timed frame: where it lies, its indices and what the screen shows while it is up."""

    left: int
    top: int
    delay: int
    disposal: int
    transparent: int  # palette index, or -1
    indices: np.ndarray  # rows x columns
    palette: np.ndarray  # entries x 3
    screen: np.ndarray | None  # rows x columns x 4 (RGBA)


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while _within(data, at, 1)[at]:
        _within(data, at, 1 + data[at])
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _within(data: bytes, at: int, n: int) -> bytes:
    """data, if n bytes from at on are there."""
    if at + n > len(data):
        raise GifError("cut off")
    return data


def _row_order(height: int) -> np.ndarray:
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, screens: bool = True) -> Iterator[Frame]:
    """Frames in order. screens: also compose what is shown, by disposal and transparency.

    A file that is cut off anywhere, or has a picture of fewer samples than its size, raises GifError when that place is met.
    """
    if data[:3] != b"GIF" or len(data) < 13:
        raise GifError("no GIF header")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13
    shared = np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(_within(data, at, 3 * n), np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    if screens and height * width > MOST_PIXELS:
        raise GifError(f"a screen of {width} by {height}")
    canvas = np.zeros((height, width, 4), np.uint8) if screens else None
    delay = disposal = 0
    transparent = -1
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = _within(data, at, 1)[at]
            body, at = _sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise GifError(f"unknown block {kind:#x}")
        left, top, w, h, local = struct.unpack("<HHHHB", _within(data, at, 9)[at : at + 9])
        at += 9
        palette = shared
        if local & 0x80:
            n = 2 << (local & 7)
            palette = np.frombuffer(_within(data, at, 3 * n), np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        size = _within(data, at, 1)[at]
        if not 1 <= size <= 8:
            raise GifError(f"samples of {size} bits")
        stream, at = _sub_blocks(data, at + 1)
        samples = lzw_samples(stream, size, w * h)  # grows with the stream, whatever the size says
        if len(samples) < w * h:
            raise GifError("a picture is cut off")
        indices = samples.reshape(h, w)
        if local & 0x40:
            straight = np.empty_like(indices)
            straight[_row_order(h)] = indices
            indices = straight
        screen = None
        if canvas is not None:
            before = canvas.copy() if disposal == 3 else None
            rows, cols = max(0, min(h, height - top)), max(0, min(w, width - left))
            part = indices[:rows, :cols]
            full = np.zeros((256, 4), np.uint8)
            full[: len(palette), :3] = palette[:256]
            full[: len(palette), 3] = 255
            area = canvas[top : top + rows, left : left + cols]
            shown = part != transparent if transparent >= 0 else np.ones(part.shape, bool)
            area[shown] = full[part[shown]]
            screen = canvas.copy()
            if disposal == 2:
                area[:] = 0
            elif before is not None:
                canvas = before
        yield Frame(left, top, delay, disposal, transparent, indices, palette, screen)
        delay = disposal = 0
        transparent = -1
    raise GifError("no end")


def histogram(screen: np.ndarray, bins: int = HISTOGRAM_BINS) -> np.ndarray:
    """Visible pixels by level, `bins` each of red, green and blue."""
    seen = screen[screen[..., 3] > 0]
    return np.stack([np.bincount(seen[:, c].astype(np.int64) * bins >> 8, minlength=bins) for c in range(3)])


def payload(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\0" * (-len(raw) % 64 or 64 * (not raw))


FRAMES = "doc_id long, frame int, at_ms long, delay_ms int, disposal int, width int, height int, red array<long>, green array<long>, blue array<long>"


def frames(media: DataFrame) -> DataFrame:
    """Timed frames of (doc_id, media binary) with histogram columns; null media give no rows, media that are cut or broken raise GifError.

    Rows that repeat a doc_id give their frames each; extra columns are ignored; an empty table gives no rows. What is held is
    one file's bytes, one screen and the rows of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

        for batch in batches:
            for name, data in zip(batch.column("doc_id").to_pylist(), batch.column("media"), strict=True):
                if not data.is_valid:
                    continue
                at = 0
                for k, f in enumerate(decode(data.as_py())):
                    rows.append((name, k, at, 10 * f.delay, f.disposal, f.screen.shape[1], f.screen.shape[0], *histogram(f.screen).tolist()))
                    at += 10 * f.delay
                    if len(rows) == BATCH_FRAMES:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    names = [x.split()[0] for x in FRAMES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3]
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    return media.select("doc_id", "media").mapInArrow(tidied(run), FRAMES)


def encoded(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each whole text as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, 1), pa.array([encode(payload(batch.column("text")[i].as_py() or ""))], pa.binary())], ["doc_id", "media"])

    return documents(docs).mapInArrow(tidied(run), "doc_id long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames int, duration_ms long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in DIGEST.split(", ")]
    for batch in batches:
        rows = []
        for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = text.as_py() or ""
            n_bytes = len(text.encode())
            media = encode(payload(text))
            back, counts, shown, duration = [], np.zeros((3, HISTOGRAM_BINS), np.int64), 0, 0
            for f in decode(media):
                back.append(f.palette[:, 0][f.indices].tobytes())  # a grey ramp: a sample is its palette entry's red
                counts += histogram(f.screen)
                shown += 1
                duration += 10 * f.delay
            stored = b"".join(back)
            feature = ":".join([str(shown), *map(str, counts.ravel().tolist())])
            rows.append((name, n_bytes, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, shown, duration))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def text_media(docs: DataFrame) -> DataFrame:
    """Every whole text through a GIF and back: digests of payload and file, frame count, duration, histogram feature.

    The feature is the number of frames and the sums of the red, green and blue histograms of what each frame shows.
    Null text counts as empty; rows that repeat a doc_id, null ones too, are stored each; a very long text is one file of many
    frames, held whole; extra columns are ignored; an empty table gives no rows.
    """
    return documents(docs).mapInArrow(tidied(_digests), DIGEST)
