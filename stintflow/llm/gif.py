"""GIF media columns: LZW streams, palettes, disposal, transparency, timed frames, colour histograms.

Files are parsed one by one, but the LZW streams of a whole batch advance in lockstep: step k reads the k-th code of
every stream with array operations, so no pixel is touched by a Python loop.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 24
CELL = SIDE * SIDE
DELAY_CS = 4
#: Red, green (3 bits each) and blue (2 bits) of a sample: 256 different colours, so a sample can be read back.
PALETTE = np.stack([(np.arange(256) >> 5) * 255 // 7, ((np.arange(256) >> 2) & 7) * 255 // 7, (np.arange(256) & 3) * 85], 1).astype(np.uint8)


@dataclass
class Image:
    left: int
    top: int
    width: int
    height: int
    interlaced: bool
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay_cs: int
    min_code: int
    data: bytes
    indices: np.ndarray | None = None


@dataclass
class Gif:
    width: int
    height: int
    background: int
    palette: np.ndarray | None
    images: list[Image] = field(default_factory=list)


def _colours(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(-1, 3)


def _blocks(b: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(b) and b[at]:
        out.append(b[at + 1 : at + 1 + b[at]])
        at += 1 + b[at]
    return b"".join(out), at + 1


def parse(b: bytes) -> Gif:
    """Blocks of a GIF87a or GIF89a file, code streams still packed. Bytes after a cut-off block are left out."""
    if b[:6] not in (b"GIF87a", b"GIF89a") or len(b) < 13:
        raise ValueError("not a GIF")
    w, h, flags, background, _ = struct.unpack_from("<HHBBB", b, 6)
    at, table = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        table, at = _colours(b[at : at + n]), at + n
    gif = Gif(w, h, background, table)
    disposal, delay, transparent = 0, 0, None
    while at < len(b):
        kind = b[at]
        if kind == 0x21 and at + 1 < len(b):
            label = b[at + 1]
            body, at = _blocks(b, at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = (body[0] >> 2) & 7, struct.unpack_from("<H", body, 1)[0]
                transparent = body[3] if body[0] & 1 else None
        elif kind == 0x2C and at + 10 < len(b):
            left, top, iw, ih, iflags = struct.unpack_from("<HHHHB", b, at + 1)
            at += 10
            own = table
            if iflags & 0x80:
                n = 3 << ((iflags & 7) + 1)
                own, at = _colours(b[at : at + n]), at + n
            code = b[at]
            body, at = _blocks(b, at + 1)
            gif.images.append(Image(left, top, iw, ih, bool(iflags & 0x40), own if own is not None else np.zeros((256, 3), np.uint8), transparent, disposal, delay, code, body))
            disposal, delay, transparent = 0, 0, None
        else:
            break
    return gif


def lzw_decode(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    """Indices of each (packed codes, minimum code size, number of pixels); missing pixels of a cut-off stream are 0.

    A dictionary string is always a run of what the stream has put out already, so an entry is a start and a length.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(streams)
    order = sorted(range(len(streams)), key=lambda k: streams[k][2])
    at = 0
    while at < len(order):
        size, end = 1, at + 1
        while end < len(order) and (end - at + 1) * min(4096, 258 + streams[order[end]][2]) <= 8_000_000:
            end += 1
        size = end - at
        part = order[at : at + size]
        for k, got in zip(part, _lockstep([streams[k] for k in part]), strict=True):
            out[k] = got
        at = end
    return out


def _lockstep(streams: list[tuple[bytes, int, int]]) -> list[np.ndarray]:
    n = len(streams)
    sizes = np.array([len(s[0]) for s in streams], np.int64)
    data = np.frombuffer(b"".join(s[0] + b"\0\0\0\0" for s in streams), np.uint8)
    base = (np.cumsum(sizes + 4) - sizes - 4) * 8
    stop = base + sizes * 8
    small = np.array([s[1] for s in streams], np.int64)
    pixels = np.array([s[2] for s in streams], np.int64)
    first_out = np.cumsum(pixels) - pixels
    out = np.zeros(int(pixels.sum()), np.uint8)
    cap = int(min(4096, pixels.max(initial=0) + 258))
    entries = np.zeros(n * cap, np.int64)  # start of the string in out, and in the low 24 bits its length
    live = np.flatnonzero(pixels > 0)
    bit, width, following = base.copy(), small + 1, (1 << small) + 2
    before_at, before_len, put = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    while len(live):
        w = width[live]
        pos = bit[live]
        live_ok = pos + w <= stop[live]
        if not live_ok.all():
            live, w, pos = live[live_ok], w[live_ok], pos[live_ok]
            if not len(live):
                break
        byte = pos >> 3
        code = ((data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16) >> (pos & 7)) & ((1 << w) - 1)
        bit[live] = pos + w
        clear = 1 << small[live]
        is_clear = code == clear
        if is_clear.any():
            c = live[is_clear]
            width[c], following[c], before_len[c] = small[c] + 1, (1 << small[c]) + 2, 0
        go = ~is_clear & (code != clear + 1)
        ended = code == clear + 1
        f, code, clear = live[go], code[go], clear[go]
        had, nxt = before_len[f], following[f]
        literal = code < clear
        known = code < nxt
        bad = (~known & ((had == 0) | (code > nxt))) | (~literal & (had == 0))
        entry = entries[f * cap + np.minimum(code, cap - 1)]
        src = np.where(known, entry >> 24, before_at[f])
        length = np.where(literal, 1, np.where(known, entry & 0xFFFFFF, had + 1))
        length = np.minimum(np.where(bad, 0, length), pixels[f] - put[f])
        to = first_out[f] + put[f]
        out[to[literal & (length > 0)]] = code[literal & (length > 0)]
        copied = np.flatnonzero(~literal & (length > 0))
        if len(copied):
            m = length[copied]
            inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            period = np.where(known[copied], 1 << 30, np.maximum(had[copied], 1))
            out[np.repeat(to[copied], m) + inner] = out[np.repeat(src[copied], m) + inner % np.repeat(period, m)]
        grows = (had > 0) & (nxt < 4096) & ~bad
        g = f[grows]
        fits = nxt[grows] < cap
        entries[g[fits] * cap + nxt[grows][fits]] = (before_at[g[fits]] << 24) | (had[grows][fits] + 1)
        following[g] += 1
        wider = (following[g] == 1 << width[g]) & (width[g] < 12)
        width[g[wider]] += 1
        before_at[f], before_len[f] = to, length
        put[f] += length
        alive = np.ones(len(live), bool)
        alive[ended] = False
        alive[np.flatnonzero(go)[bad | (put[f] >= pixels[f])]] = False
        live = live[alive]
    return [out[a : a + p] for a, p in zip(first_out.tolist(), pixels.tolist(), strict=True)]


def lzw_encode(frames: np.ndarray, min_code: int = 8) -> list[bytes]:
    """Packed code streams of the rows of a (frames, pixels) array of indices below 1 << min_code."""
    n, pixels = frames.shape
    if not n:
        return []
    room = max(1, min(n, 8_000_000 // (1 << min(pixels, 3838).bit_length())))
    out: list[bytes] = []
    for at in range(0, n, room):
        out += _encode(frames[at : at + room], min_code)
    return out


def _encode(frames: np.ndarray, min_code: int) -> list[bytes]:
    n, pixels = frames.shape
    clear = 1 << min_code
    # One open-addressing table a frame: 20 bits of (prefix code, sample), 12 bits of the code that they got.
    slots = 1 << min(pixels, 3838).bit_length()
    shift = np.uint64(32 - slots.bit_length() + 1)
    free = np.uint32(0xFFFFFFFF)
    table = np.full(n * slots, free, np.uint32)
    codes = np.zeros((n, pixels + pixels // 3000 + 3), np.int16)
    widths = np.zeros(codes.shape, np.int8)
    count, width, following = np.ones(n, np.int64), np.full(n, min_code + 1, np.int64), np.full(n, clear + 2, np.int64)
    codes[:, 0], widths[:, 0] = clear, min_code + 1
    samples = np.ascontiguousarray(frames.T).astype(np.uint32)
    current = samples[0]
    everyone = np.arange(n)
    base = everyone * slots
    for k in range(1, pixels):
        px = samples[k]
        key = (current << np.uint32(8)) | px
        at = base + (((key.astype(np.uint64) * np.uint64(2654435761)) & np.uint64(0xFFFFFFFF)) >> shift).astype(np.int64)
        held = table[at]
        hit = held >> np.uint32(12) == key
        look = np.flatnonzero(~hit & (held != free))
        while len(look):
            at[look] = base[look] + ((at[look] - base[look] + 1) & (slots - 1))
            there = table[at[look]]
            same = there >> np.uint32(12) == key[look]
            held[look], hit[look] = there, same
            look = look[~same & (there != free)]
        current = np.where(hit, held & np.uint32(4095), px)
        new = np.flatnonzero(~hit)
        if not len(new):
            continue
        codes[new, count[new]], widths[new, count[new]] = key[new] >> 8, width[new]
        count[new] += 1
        table[at[new]] = (key[new] << np.uint32(12)) | following[new].astype(np.uint32)
        wider = following[new] == 1 << width[new]
        width[new[wider]] += 1
        following[new] += 1
        full = new[following[new] >= 4094]
        if len(full):
            codes[full, count[full]], widths[full, count[full]] = clear, width[full]
            count[full] += 1
            table.reshape(n, slots)[full] = free
            width[full], following[full] = min_code + 1, clear + 2
    codes[everyone, count], widths[everyone, count] = current, width
    wider = (following == 1 << width) & (width < 12)
    count += 1
    codes[everyone, count], widths[everyone, count] = clear + 1, width + wider
    count += 1
    used = np.arange(codes.shape[1])[None, :] < count[:, None]
    offsets = np.cumsum(np.where(used, widths, 0), axis=1)
    nbytes = (offsets[:, -1] + 7) // 8
    base = (np.cumsum(nbytes) - nbytes) * 8
    bits = np.zeros(int(nbytes.sum()) * 8, np.uint8)
    flat, wide = codes[used].astype(np.int32), widths[used]
    pos = (offsets - widths + base[:, None])[used]
    for b in range(int(wide.max())):
        on = wide > b
        bits[pos[on] + b] = (flat[on] >> b) & 1
    packed = np.packbits(bits, bitorder="little").tobytes()
    return [packed[a : a + m] for a, m in zip((base // 8).tolist(), nbytes.tolist(), strict=True)]


def build(width: int, height: int, palette: np.ndarray, streams: list[bytes], delay_cs: int, min_code: int = 8) -> bytes:
    """A GIF89a file of full-size opaque frames that stay in place (disposal 1)."""
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | 7, 0, 0) + palette.tobytes()
    frame = b"\x21\xf9\x04\x04" + struct.pack("<H", delay_cs) + b"\0\0\x2c" + struct.pack("<HHHHB", 0, 0, width, height, 0) + bytes([min_code])
    body = b"".join(frame + b"".join(bytes([len(c)]) + c for c in (s[k : k + 255] for k in range(0, len(s), 255))) + b"\0" for s in streams)
    return head + body + b"\x3b"


def fill(gifs: list[Gif]) -> None:
    """Decode the code streams of all images of all files together."""
    images = [i for g in gifs for i in g.images]
    for image, got in zip(images, lzw_decode([(i.data, i.min_code, i.width * i.height) for i in images]), strict=True):
        got = got.reshape(image.height, image.width)
        if image.interlaced:
            rows = [*range(0, image.height, 8), *range(4, image.height, 8), *range(2, image.height, 4), *range(1, image.height, 2)]
            straight = np.empty_like(got)
            straight[rows] = got
            got = straight
        image.indices = got


def composite(gif: Gif) -> Iterator[tuple[np.ndarray, Image]]:
    """The RGBA canvas that each image leaves on screen. Disposal 2 clears the image's area, 3 brings back what was there
    before it, 0 and 1 leave it; transparent indices keep what lies below; parts outside the screen are cut off."""
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    for i in gif.images:
        h, w = max(0, min(i.height, gif.height - i.top)), max(0, min(i.width, gif.width - i.left))
        area = canvas[i.top : i.top + h, i.left : i.left + w]
        saved = area.copy() if i.disposal == 3 else None
        idx = i.indices[:h, :w]
        seen = idx < len(i.palette)
        if i.transparent is not None:
            seen &= idx != i.transparent
        area[seen] = np.concatenate([i.palette[idx[seen]], np.full((int(seen.sum()), 1), 255, np.uint8)], axis=1)
        yield canvas.copy(), i
        if i.disposal == 2:
            area[:] = 0
        elif saved is not None:
            area[:] = saved


def _plain(g: Gif) -> bool:
    return all((i.left, i.top, i.width, i.height) == (0, 0, g.width, g.height) and i.transparent is None and len(i.palette) == 256 for i in g.images)


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 64 colour cells, two bits a channel, of an (n, 3) array."""
    q = rgb.astype(np.int64) >> 6
    return np.bincount(q[:, 0] * 16 + q[:, 1] * 4 + q[:, 2], minlength=64)


def gif_histogram(g: Gif) -> np.ndarray:
    """Colour counts over all composited frames; see-through pixels don't count."""
    if g.images and _plain(g):
        total = np.zeros(64, np.int64)
        shared = g.images[0].palette
        if all(i.palette is shared for i in g.images):
            q = shared.astype(np.int64) >> 6
            counts = np.bincount(np.concatenate([i.indices.ravel() for i in g.images]), minlength=256)
            np.add.at(total, q[:, 0] * 16 + q[:, 1] * 4 + q[:, 2], counts)
            return total
    return sum((histogram(c[c[..., 3] > 0][:, :3]) for c, _ in composite(g)), np.zeros(64, np.int64))


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A GIF for each payload of a multiple of 576 bytes: 24 x 24 frames of one sample a pixel."""
    frames = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, CELL)
    streams = lzw_encode(frames)
    out, at = [], 0
    for p in payloads:
        n = len(p) // CELL
        out.append(build(SIDE, SIDE, PALETTE, streams[at : at + n], DELAY_CS))
        at += n
    return out


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, gif): each whole text, padded with bytes 255 to frames of 576 samples, as an animated GIF.

    A null text counts as empty and gives one blank frame. Long texts only make more frames; a batch is worked off in
    slices of about 4 MB, so memory doesn't follow the table.
    """

    def run(batches):
        for b in batches:
            for ids, raws in _slices(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(r) for r in raws], pa.int64()), pa.array(encode_payloads([pad(r) for r in raws]), pa.binary())], ["id", "n_bytes", "gif"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, gif binary")


def pad(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % CELL if raw else CELL)


def _slices(b: pa.RecordBatch, most: int = 4_000_000):
    texts, at = b.column(1), 0
    while at < len(texts):
        raws, total, k = [], 0, at
        while k < len(texts) and (not raws or total < most):
            raws.append((texts[k].as_py() or "").encode("utf-8", "replace"))
            total += len(raws[-1])
            k += 1
        yield b.column(0).slice(at, k - at), raws
        at = k


def timed_frames(media: DataFrame, id_col: str = "id", gif_col: str = "gif", max_pixels: int = 1 << 24) -> DataFrame:
    """(id, frame, start_ms, duration_ms, width, height, rgba, histogram) of every frame of a column of GIF files.

    A null or unreadable file has no rows, and neither has one whose header asks for a screen of over max_pixels. rgba is
    the composited screen, row by row.
    """

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 64):
                part = b.slice(k, 64)
                rows = []
                good = [(i, g) for i, g in zip(range(len(part)), map(_try_parse, part.column(1).to_pylist()), strict=True) if g and g.width * g.height <= max_pixels]
                fill([g for _, g in good])
                for i, g in good:
                    clock = 0
                    for n, (canvas, image) in enumerate(composite(g)):
                        rows.append((i, n, clock, image.delay_cs * 10, g.width, g.height, canvas.tobytes(), histogram(canvas[canvas[..., 3] > 0][:, :3]).tolist()))
                        clock += image.delay_cs * 10
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["id", "frame", "start_ms", "duration_ms", "width", "height", "rgba", "histogram"])

    kind = media.schema[id_col].dataType.simpleString()
    return media.select(F.col(id_col).alias("id"), F.col(gif_col).alias("gif")).mapInArrow(run, f"id {kind}, frame int, start_ms long, duration_ms long, width int, height int, rgba binary, histogram array<long>")


def _try_parse(b: bytes | None) -> Gif | None:
    try:
        return parse(b) if b else None
    except (ValueError, IndexError, struct.error):
        return None


def digests(media: DataFrame) -> DataFrame:
    """Contract columns of stored texts (id, n_bytes, gif), all taken from the stored bytes read back."""

    def run(batches):
        for b in batches:
            for k in range(0, len(b), 512):
                part = b.slice(k, 512)
                files = part.column(2).to_pylist()
                gifs = [parse(f) for f in files]
                fill(gifs)
                back = [b"".join(i.indices.tobytes() for i in g.images) for g in gifs]
                cols = [
                    part.column(0), part.column(1),
                    pa.array([len(p) for p in back], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in back]), pa.array([zlib.crc32(p[-32:]) for p in back], pa.int64()),
                    pa.array([len(f) for f in files], pa.int64()), pa.array([hashlib.sha256(f).hexdigest() for f in files]), pa.array([",".join(map(str, gif_histogram(g).tolist())) for g in gifs]), pa.array([len(g.images) for g in gifs], pa.int32()), pa.array([sum(i.delay_cs for i in g.images) * 10 for g in gifs], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_ms"])

    kind = media.schema["id"].dataType.simpleString()
    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long")


def op3_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
