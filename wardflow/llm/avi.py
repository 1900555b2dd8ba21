"""Media columns: AVI with motion JPEG, and the shots in it.

Payloads are stored without loss: each 192 bytes are a 16 x 12 grey frame in JPEG's lossless process (SOF3, prediction from the left).
The Huffman code of a difference of c bits is 9 - c bits long, so every sample takes 9 bits and whole frames are packed and
unpacked as arrays; a decoder that follows the standard reads them too. Frames of other tables are decoded bit by bit.

Reading walks the RIFF chunks, takes the frames' places from the index (or, without one, from the chunks), and decodes each frame by itself.
A shot ends where the difference of neighbouring frames' 16-bin histograms exceeds the mean of the last 8 differences in the
shot by 3 standard deviations and a fixed rest; a cut's own difference belongs to no shot. A shot's first difference has none before it
and ends the shot above FIRST, which is beyond what chance gives two frames of one scene. The clips between are timed by the stream's frame time.

A very long text is one file in one task, which is packed and read some thousand frames at a time.

Nulls: a null text is empty; an empty payload is padded to one frame. A null media value gives no clips and null results; one that is no AVI file, is cut off or otherwise damaged, or holds frames of another process than
the lossless one gives a row with the reason in `error`, and no clips. Entries of other streams than the first video stream are not read. Equal
payloads give equal files. Repeated rows are each returned. An empty table gives an empty result; other columns pass or are not read.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wardflow.llm.common import table

WIDTH, HEIGHT, FRAME, USEC = 16, 12, 192, 40_000
BINS, RECENT, REST, FIRST = 16, 8, 40, 96
#: Frames that are packed and placed at once.
CHUNK = 4096

# ---- lossless JPEG ----

_HEAD = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0) + b"\xff\xc4" + struct.pack(">HB", 28, 0) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)) + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
_END = b"\xff\xd9"


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """9-bit code of each difference from -255 to 255, and back."""
    enc, dec = np.zeros(511, ">u2"), np.full(512, 1 << 14, np.int32)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        prefix = (1 << (9 - c)) - 2  # ones, then a zero
        code = prefix << c | (d if d >= 0 else d + (1 << c) - 1)
        enc[d + 255], dec[code] = code, d
    return enc, dec


_ENC, _DEC = _codes()


def _packed(samples: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes, not yet stuffed, of frames (n, HEIGHT, WIDTH)."""
    s = samples.astype(np.int16)
    d = s.copy()
    d[:, :, 1:] -= s[:, :, :-1]
    d[:, 1:, 0] -= s[:, :-1, 0]
    d[:, 0, 0] -= 128
    bits = np.unpackbits(_ENC[d.reshape(-1, FRAME) + 255].view(np.uint8).reshape(-1, FRAME, 2), axis=2)[:, :, 7:]
    return np.packbits(bits.reshape(len(s), FRAME * 9), axis=1)


def _unpacked(data: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(data), FRAME, 16), np.uint8)
    bits[:, :, 7:] = np.unpackbits(data, axis=1).reshape(-1, FRAME, 9)
    d = _DEC[np.packbits(bits, axis=2).view(">u2")[:, :, 0]].reshape(-1, HEIGHT, WIDTH)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 255).astype(np.uint8)


def decode_frame(jpeg: bytes) -> np.ndarray:
    """Any one-component 8-bit lossless frame of any size and Huffman table, prediction 1; bit by bit."""
    at, table, shape = 2, {}, None
    while True:
        marker, n = struct.unpack_from(">HH", jpeg, at)
        body = jpeg[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xFFC3:
            shape = struct.unpack_from(">HH", body, 1)
        elif marker == 0xFFC4:
            code, k = 0, 17
            for length, m in enumerate(body[1:17], 1):
                for _ in range(m):
                    table[length, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xFFDA:
            break
        elif 0xFFC0 <= marker <= 0xFFCF:
            raise MediaError("only the lossless process is decoded")
    raw = jpeg[at : jpeg.rindex(_END)].replace(b"\xff\x00", b"\xff")
    bits, pos = "".join(f"{x:08b}" for x in raw), 0
    out = np.zeros(shape, np.int64)
    for y in range(shape[0]):
        for x in range(shape[1]):
            length = 1
            while (length, int(bits[pos : pos + length], 2)) not in table:
                length += 1
                if length > 16:
                    raise MediaError("no such code")
            c = table[length, int(bits[pos : pos + length], 2)]
            pos += length
            v = int(bits[pos : pos + c], 2) if c else 0
            pos += c
            guess = out[y, x - 1] if x else out[y - 1, 0] if y else 128
            out[y, x] = guess + (v if not c or v >> (c - 1) else v - (1 << c) + 1)
    return (out & 255).astype(np.uint8)


# ---- AVI ----


def write_avi(payload: bytes) -> bytes:
    """The file of a payload whose length is a positive multiple of FRAME."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)
    n, head = len(frames), np.frombuffer(_HEAD, np.uint8)
    data = np.concatenate([_packed(frames[a : a + CHUNK]) for a in range(0, n, CHUNK)])
    width = data.shape[1]
    full = data == 255
    extra = full.sum(1)
    size = len(_HEAD) + width + extra + 2  # of a frame's JPEG
    step = 8 + size + (size & 1)
    start = np.cumsum(step) - step
    movi = np.zeros(int(step.sum()), np.uint8)
    for a in range(0, n, CHUNK):  # the places of some frames' bytes at a time, as each takes 8 bytes itself
        at, own = start[a : a + CHUNK, None], size[a : a + CHUNK]
        movi[at + np.arange(4)] = np.frombuffer(b"00dc", np.uint8)
        movi[at + np.arange(4, 8)] = own.astype("<u4").view(np.uint8).reshape(-1, 4)
        movi[at + 8 + np.arange(len(head))] = head
        shift = np.cumsum(full[a : a + CHUNK], axis=1) - full[a : a + CHUNK]
        movi[at + 8 + len(head) + np.arange(width) + shift] = data[a : a + CHUNK]
        movi[at + (8 + own - 2)[:, None] + np.arange(2)] = np.frombuffer(_END, np.uint8)
    index = np.zeros(n, [("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 16, start + 4, size
    chunk = lambda k, *x: k + struct.pack("<I", sum(map(len, x))) + b"".join(x)
    most = int(size.max())
    avih = struct.pack("<14I", USEC, most * 25, 0, 16, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, USEC, 1_000_000, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl", chunk(b"strh", strh), chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl", chunk(b"avih", avih), strl)
    return chunk(b"RIFF", b"AVI ", hdrl, chunk(b"LIST", b"movi", movi.tobytes()), chunk(b"idx1", index.tobytes()))


class MediaError(ValueError):
    """A file that is no AVI, is damaged, or holds frames that are not decoded."""


INDEX = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])


def _chunks(media: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(id, first byte, bytes) of the chunks between two places."""
    while at + 8 <= end:
        n = struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + n > end:
            raise MediaError(f"chunk at byte {at} ends beyond byte {end}")
        yield media[at : at + 4], at + 8, n
        at += 8 + n + (n & 1)


def _frame_places(media: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """First bytes and sizes of the first video stream's frames, and microseconds of each. The index's places count from the list of frames or, in some files, from the file's start."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI " or len(media) < 12:
        raise MediaError("no AVI file")
    usec, movi, index, kinds = USEC, None, None, []
    for k, at, n in _chunks(media, 12, len(media)):
        if k == b"LIST" and media[at : at + 4] == b"hdrl":
            for k2, at2, n2 in _chunks(media, at + 4, at + n):
                if k2 == b"avih" and n2 >= 4:
                    usec = struct.unpack_from("<I", media, at2)[0]
                elif k2 == b"LIST" and media[at2 : at2 + 4] == b"strl":
                    kinds += [media[x : x + 4] for k3, x, _ in _chunks(media, at2 + 4, at2 + n2) if k3 == b"strh"]
        elif k == b"LIST" and media[at : at + 4] == b"movi":
            movi = (at, n)
        elif k == b"idx1":
            index = np.frombuffer(media, INDEX, n // 16, at)
    if movi is None:
        raise MediaError("no frames")
    stream = b"%02d" % (kinds.index(b"vids") if b"vids" in kinds else 0)
    names = (stream + b"dc", stream + b"db")
    if index is None:
        found = [(at, n) for k, at, n in _chunks(media, movi[0] + 4, movi[0] + movi[1]) if k in names]
        start, size = np.array(found, np.int64).reshape(-1, 2).T
        return start, size, usec
    index = index[np.isin(index["id"], names)]
    start, size = index["at"].astype(np.int64) + 8, index["size"].astype(np.int64)
    if len(index) and media[(at := movi[0] + int(index["at"][0])) : at + 4] in names:
        start += movi[0]
    elif len(index) and media[(at := int(index["at"][0])) : at + 4] not in names:
        raise MediaError("the index points at no frame")
    if len(index) and int((start + size).max()) > len(media):
        raise MediaError("the index points beyond the file")
    return start, size, usec


def read_avi(media: bytes) -> tuple[np.ndarray, int]:
    """Frames (n, height, width) and microseconds of each. What is no such file, or is damaged, is a MediaError."""
    try:
        return _read_avi(media)
    except (struct.error, IndexError, ValueError, KeyError) as e:
        raise e if isinstance(e, MediaError) else MediaError(f"damaged frames: {e}") from e


def _read_avi(media: bytes) -> tuple[np.ndarray, int]:
    start, size, usec = _frame_places(media)
    raw = np.frombuffer(media, np.uint8)
    head = np.frombuffer(_HEAD, np.uint8)
    if not len(start):
        return np.zeros((0, HEIGHT, WIDTH), np.uint8), usec
    if int(size.min()) < len(head) or not all((raw[start[a : a + CHUNK, None] + np.arange(len(head))] == head).all() for a in range(0, len(start), CHUNK)):
        return np.stack([decode_frame(media[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]), usec
    out = [_read_frames(raw, start[a : a + CHUNK] + len(head), size[a : a + CHUNK] - len(head) - 2) for a in range(0, len(start), CHUNK)]
    return np.concatenate(out), usec


def _read_frames(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Frames whose entropy-coded bytes lie at start, size bytes each."""
    at = np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)
    b = raw[at]
    stuffed = np.zeros(len(b), bool)
    stuffed[1:] = (b[:-1] == 255) & (b[1:] == 0)
    return _unpacked(b[~stuffed].reshape(len(start), FRAME * 9 // 8))


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    n = len(frames)
    if not n:
        return []
    size = frames[0].size
    flat = frames.reshape(n, -1)
    part = lambda f: np.bincount((np.arange(len(f))[:, None] * BINS + (f >> 4)).ravel(), minlength=len(f) * BINS).reshape(-1, BINS)
    h = np.concatenate([part(flat[a : a + CHUNK]) for a in range(0, n, CHUNK)])
    d = np.abs(np.diff(h, axis=0)).sum(1) * FRAME // size
    sums, squares = np.r_[0, np.cumsum(d)].tolist(), np.r_[0, np.cumsum(d * d)].tolist()
    cuts, first = [], 0
    for i, x in enumerate(d.tolist()):
        low = max(i - RECENT, first)
        m, most = i - low, FIRST
        if m:
            mean = (sums[i] - sums[low]) / m
            most = mean + 3 * math.sqrt(max((squares[i] - squares[low]) / m - mean * mean, 0)) + REST
        if x > most:
            first = i + 1
            cuts.append(first)
    return list(zip([0, *cuts], [*(c - 1 for c in cuts), n - 1]))


# ---- columns ----


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (bytes held, values) as batches of some MB."""
    held, got = 0, []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got), types)], names)
    for n, row in rows:
        got.append(row)
        held += n
        if held >= most or len(got) >= 2000:
            yield pack()
            held, got = 0, []
    if got:
        yield pack()


def stored_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media) of every text."""

    def run(batches):
        def rows():
            for b in batches:
                for k, t in zip(b.column(0), b.column(1)):
                    n, payload = padded(t.as_py())
                    media = write_avi(payload)
                    yield len(media), (k.as_py(), n, media)

        yield from _batched(rows(), [key, "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])

    return docs.select(key, text).mapInArrow(run, f"`{key}` long, n_bytes long, media binary")


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """A row for each shot: key, clip, first and last frame, start_ms, end_ms (end exclusive); for a file that can't be read, a row with nulls and the reason in error."""

    def run(batches):
        def rows():
            for b in batches:
                for k, m in zip(b.column(0), b.column(1)):
                    if m.as_py() is None:
                        continue
                    try:
                        frames, usec = read_avi(m.as_py())
                    except MediaError as e:
                        yield 100, (k.as_py(), *[None] * 5, str(e))
                        continue
                    for i, (a, z) in enumerate(shots(frames)):
                        yield 100, (k.as_py(), i, a, z, a * usec // 1000, (z + 1) * usec // 1000, None)

        yield from _batched(rows(), [key, "clip", "first_frame", "last_frame", "start_ms", "end_ms", "error"], [pa.int64()] * 6 + [pa.string()])

    return media.select(key, column).mapInArrow(run, f"`{key}` long, clip long, first_frame long, last_frame long, start_ms long, end_ms long, error string")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for b in batches:
            for k, n, m in zip(b["doc_id"], b["n_bytes"], b["media"]):
                media = m.as_py()
                try:
                    frames, usec = read_avi(media or b"")
                except MediaError as e:
                    held = (None, None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest(), f"error: {e}")
                    yield 500, (k.as_py(), n.as_py(), None, None, None, *held)
                    continue
                payload = frames.tobytes()
                said = ",".join(f"{a * usec // 1000}-{(z + 1) * usec // 1000}" for a, z in shots(frames))
                yield 500 + len(said), (k.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(frames)} frames; clips ms {said}")

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    yield from _batched(rows(), names, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.mapInArrow(_features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
