"""Media columns: signature sniffing.

`store` writes a payload losslessly as a small media file: 8-bit samples of RIFF/WAVE, or 8-bit grey pixels, 64 in a
row, of BMP or PNG. `sniff` trusts no declared type: an Aho-Corasick automaton finds every magic number in the bytes, a
validator for each format walks its structure and lengths, and what passes gives the true type
and the extent of the file and of files embedded in it, which can be carved out.

Bytes full of magic numbers take no more than their length: validators share the places of closing marks, and each
chain of chunks is walked once, whichever headers lead there.

Defined results. Null text: the payload of an empty one. Empty bytes or bytes without a valid
signature: type `application/octet-stream`, nothing carved. Overlapping files: the leftmost
wins, and of those that start together the longest. Equal inputs give equal values; rows are
independent, so repeated rows, empty tables, null ids and extra columns need no special care. A very long text is one
file of its size; PNG and BMP hold up to 2 GB.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from braidwork.llm.scratch import small_batches

UNKNOWN = "application/octet-stream"


class Blob:
    """Bytes under test, with what validators have learnt about them."""

    def __init__(self, data: bytes):
        self.data = data
        self._places: dict[bytes, list[int]] = {}
        self._ends: dict[str, dict[int, int | None]] = {}

    def after(self, mark: bytes, at: int) -> int:
        """The first place of a mark at or after `at`, or -1; the bytes are searched once for each mark."""
        if mark not in self._places:
            self._places[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        found = self._places[mark]
        i = bisect_left(found, at)
        return found[i] if i < len(found) else -1

    def chain(self, name: str, at: int, step: Callable[[int], tuple[bool, int | None]]) -> int | None:
        """Where a succession of chunks ends, or None. `step` gives (False, next place) or (True, the end)."""
        ends = self._ends.setdefault(name, {})
        path, over, end = [], False, at
        while not over:
            at = end
            if at in ends:
                end = ends[at]
                break
            path.append(at)
            over, end = step(at)
        ends.update(dict.fromkeys(path, end))
        return end


def _png(x: Blob, at: int) -> int | None:
    b = x.data
    sound = lambda p, end: zlib.crc32(memoryview(b)[p + 4 : end - 4]) == int.from_bytes(b[end - 4 : end], "big")
    if b[at + 8 : at + 16] != b"\x00\x00\x00\x0dIHDR" or at + 33 > len(b) or not sound(at + 8, at + 33):
        return None

    def structure(p: int) -> tuple[bool, int | None]:
        end = p + 12 + int.from_bytes(b[p : p + 4], "big")
        if p + 12 > len(b) or end > len(b):
            return True, None
        return (True, end) if b[p + 4 : p + 8] == b"IEND" else (False, end)

    def checked(p: int) -> tuple[bool, int | None]:
        over, end = structure(p)
        return (over, end) if sound(p, end) else (True, None)

    # checksums only where the lengths lead to an end
    return x.chain("png", at + 33, checked) if x.chain("png lengths", at + 33, structure) is not None else None


def _gif(x: Blob, at: int) -> int | None:
    b = x.data
    if at + 13 > len(b):
        return None
    colours = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def block(p: int) -> tuple[bool, int | None]:
        if p >= len(b):
            return True, None
        return (True, p + 1) if b[p] == 0 else (False, p + 1 + b[p])

    def part(p: int) -> tuple[bool, int | None]:
        if p < len(b) and b[p] == 0x3B:
            return True, p + 1
        if p < len(b) and b[p] == 0x21:
            after = x.chain("gif blocks", p + 2, block)
        elif p + 10 <= len(b) and b[p] == 0x2C:
            after = x.chain("gif blocks", p + 11 + colours(b[p + 9]), block)
        else:
            return True, None
        return after is None, after

    return x.chain("gif", at + 13 + colours(b[at + 10]), part)


def _jpeg(x: Blob, at: int) -> int | None:
    b = x.data

    def segment(p: int) -> tuple[bool, int | None]:
        size = int.from_bytes(b[p + 2 : p + 4], "big")
        if p + 4 > len(b) or b[p] != 0xFF or size < 2:
            return True, None
        after = p + 2 + size
        if b[p + 1] != 0xDA:
            return False, after
        while (after := b.find(b"\xff", after)) >= 0 and after + 1 < len(b):  # coded data up to the next real marker
            mark = b[after + 1]
            if mark == 0xD9:
                return True, after + 2
            if mark not in (0, 0xFF) and not 0xD0 <= mark <= 0xD7:
                return False, after
            after += 1 if mark == 0xFF else 2
        return True, None

    return x.chain("jpeg", at + 2, segment)


def _bmp(x: Blob, at: int) -> int | None:
    b = x.data
    if at + 54 > len(b):
        return None
    size, reserved, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    good = reserved == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and height and width > 0
    if not good or not 14 + header <= start <= size or at + size > len(b):
        return None
    plain = struct.unpack_from("<I", b, at + 30)[0] == 0  # not compressed: the pixels have a known size
    return at + size if not plain or start + (width * bits + 31) // 32 * 4 * abs(height) <= size else None


def _riff(x: Blob, at: int) -> int | None:
    b = x.data
    if at + 12 > len(b):
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    kind = b[at + 8 : at + 12]
    if end > len(b) or kind not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        size = int.from_bytes(b[pos + 4 : pos + 8], "little")
        seen.add(b[pos : pos + 4])
        pos += 8 + size + (size & 1)
    if pos != end or (kind == b"WAVE" and not {b"fmt ", b"data"} <= seen):
        return None
    return end


def _zip(x: Blob, at: int) -> int | None:
    b = x.data
    tail = x.after(b"PK\x05\x06", at)
    if tail < 0 or tail + 22 > len(b):
        return None
    _, start, note = struct.unpack_from("<IIH", b, tail + 12)
    end = tail + 22 + note
    fits = at + start <= tail and b[at + start : at + start + 4] in (b"PK\x01\x02", b"PK\x05\x06")
    size = struct.unpack_from("<I", b, tail + 12)[0]
    return end if fits and at + start + size == tail and end <= len(b) else None


def _gzip(x: Blob, at: int) -> int | None:
    b = x.data
    box = zlib.decompressobj(31)
    pos, step = at, 512
    try:
        while not box.eof and pos < len(b):  # in growing pieces: a false start costs little, a small input can't fill the memory
            part = b[pos : pos + step]
            pos, step = pos + len(part), min(2 * step, 65536)
            data = box.decompress(part, 1 << 20)
            while box.unconsumed_tail and data:
                data = box.decompress(box.unconsumed_tail, 1 << 20)
    except zlib.error:
        return None
    return pos - len(box.unused_data) if box.eof else None


def _pdf(x: Blob, at: int) -> int | None:
    if not x.data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    end = x.after(b"%%EOF", at)
    return end + 5 if end > 0 and at < x.after(b"startxref", at) < end else None


def _flac(x: Blob, at: int) -> int | None:
    b = x.data
    if b[at + 4 : at + 5] not in (b"\x00", b"\x80") or int.from_bytes(b[at + 5 : at + 8], "big") != 34:
        return None

    def block(p: int) -> tuple[bool, int | None]:
        after = p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
        if p + 4 > len(b) or after > len(b):
            return True, None
        return (True, len(b)) if b[p] & 0x80 else (False, after)  # frames run to the end: FLAC states no total

    return x.chain("flac", at + 4, block)


#: Magic bytes, type and validator. The magic numbers are fixed values of the formats.
FORMATS: tuple[tuple[bytes, str, Callable[[Blob, int], int | None]], ...] = (
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "riff", _riff),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
)
_RIFF = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Part(NamedTuple):
    offset: int
    length: int
    kind: str


def automaton():
    """The Aho-Corasick automaton of all magic numbers."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), i)
    found.make_automaton()
    return found


def sniff(blob: bytes, machine=None) -> list[Part]:
    """All valid media files in the bytes, from the left, without overlaps."""
    machine = machine or automaton()
    parts: list[Part] = []
    known = Blob(blob)
    for last, i in machine.iter(blob.decode("latin-1")):
        magic, kind, valid = FORMATS[i]
        at = last - len(magic) + 1
        if (parts and at < parts[-1].offset + parts[-1].length and at != parts[-1].offset) or (end := valid(known, at)) is None:
            continue
        part = Part(at, end - at, _RIFF[blob[at + 8 : at + 12]] if kind == "riff" else kind)
        if parts and parts[-1].offset == at:
            if part.length > parts[-1].length:
                parts[-1] = part
        else:
            parts.append(part)
    return parts


def embedded(blob: bytes, outer: Part, machine=None) -> list[Part]:
    """Files inside a file: carved from the bytes after its own magic number."""
    inner = blob[outer.offset + 4 : outer.offset + outer.length]
    return [Part(outer.offset + 4 + p.offset, p.length, p.kind) for p in sniff(inner, machine)]


def found(blob: bytes, machine=None) -> tuple[Part | None, list[Part]]:
    """The file that the bytes are, if they are one, and the files embedded in it (in the bytes, if they are none)."""
    parts = sniff(blob, machine)
    whole = next((p for p in parts if p.offset == 0), None)
    return whole, embedded(blob, whole, machine) if whole else parts


def padded(data: bytes, unit: int = 64) -> bytes:
    return data + bytes(-len(data) % unit if data else unit)


ROW = 64


def wav(samples: bytes, rate: int = 8000) -> bytes:
    """Bytes as unsigned 8-bit samples of one channel; chunks have an even length."""
    pad = bytes(len(samples) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def wav_samples(blob: bytes) -> bytes:
    """The samples, read back by walking the chunks."""
    pos = 12
    while pos + 8 <= len(blob):
        size = int.from_bytes(blob[pos + 4 : pos + 8], "little")
        if blob[pos : pos + 4] == b"data":
            return blob[pos + 8 : pos + 8 + size]
        pos += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def bmp(pixels: bytes) -> bytes:
    """Bytes as rows of 8-bit grey pixels, the first row first."""
    palette = b"".join(bytes((g, g, g, 0)) for g in range(256))
    start = 54 + len(palette)
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", start + len(pixels), 0, start, 40, ROW, -(len(pixels) // ROW), 1, 8, 0, len(pixels), 0, 0, 256, 0)
    return head + palette + pixels


def bmp_pixels(blob: bytes) -> bytes:
    """The pixels, found by the header's offset and dimensions."""
    start, _, width, height = struct.unpack_from("<IIii", blob, 10)
    return blob[start : start + width * abs(height)]


def png(pixels: bytes) -> bytes:
    """Bytes as rows of 8-bit grey pixels without a filter, in stored deflate blocks."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = np.zeros((len(pixels) // ROW, ROW + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(pixels, np.uint8).reshape(-1, ROW)
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 0)) + chunk(b"IEND", b"")


def png_pixels(blob: bytes) -> bytes:
    """The pixels of such a file."""
    pos, packed, width = 8, [], 0
    while pos + 12 <= len(blob):
        size, kind = struct.unpack_from(">I4s", blob, pos)
        if kind == b"IHDR":
            width = int.from_bytes(blob[pos + 8 : pos + 12], "big")
        if kind == b"IDAT":
            packed.append(blob[pos + 8 : pos + 8 + size])
        pos += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


#: Types that `store` writes, with their writers and readers.
CONTAINERS: tuple[tuple[str, Callable[[bytes], bytes], Callable[[bytes], bytes]], ...] = (
    ("audio/wav", wav, wav_samples), ("image/bmp", bmp, bmp_pixels), ("image/png", png, png_pixels),
)
_READERS = {kind: read for kind, _, read in CONTAINERS}


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, declared, media): each text as a media file, and the type that its table would declare.

    The checksum of the payload chooses the container. Documents declare no type, so the length in bytes stands in for a
    careless publisher: it names one of the containers, the wrong one for two texts of three.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(x.as_py() or "").encode("utf-8", "surrogatepass") for x in batch.column(1)]
            payloads = [padded(x) for x in raw]
            media = [CONTAINERS[zlib.crc32(x) % len(CONTAINERS)][1](x) for x in payloads]
            declared = [CONTAINERS[len(x) % len(CONTAINERS)][0] for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "declared", "media"])

    return docs.select(id_col, text_col).mapInArrow(stored, f"{id_col} {kind}, n_bytes long, declared string, media binary")


def describe(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What the stored bytes are: true type, extent, carved files, and digests of the payload read back.

    `feature` is "true type<declared type;right or corrected;file bytes;carved type@offset+length,...". A file of a type that
    `store` writes is read by its format, other bytes are their own payload.
    """
    small_batches(media.sparkSession)
    kind = dict(media.dtypes)[id_col]
    out = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_embedded int"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for n, declared, blob in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                blob, declared = blob.as_py() or b"", declared.as_py()
                whole, inner = found(blob, machine)
                true = whole.kind if whole else UNKNOWN
                payload = _READERS[true](blob[: whole.length]) if true in _READERS else blob
                carved = ",".join(f"{p.kind}@{p.offset}+{p.length}" for p in inner)
                feature = f"{true}<{declared};{'right' if true == declared else 'corrected'};{whole.length if whole else 0};{carved}"
                rows.append((n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), feature, len(inner)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, *(x.split()[0] for x in out.split(", "))])

    return media.select(id_col, "n_bytes", "declared", "media").mapInArrow(described, f"{id_col} {kind}, {out}")


def carve(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, offset, kind, media): one row per file embedded in a stored file."""
    kind = dict(media.dtypes)[id_col]

    def carved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column(0), batch.column(1), strict=True):
                blob = blob.as_py() or b""
                for i, p in enumerate(found(blob, machine)[1]):
                    rows.append((key.as_py(), i, p.offset, p.kind, blob[p.offset : p.offset + p.length]))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [batch.column(0).type, pa.int32(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "part", "offset", "kind", "media"])

    return media.select(id_col, "media").mapInArrow(carved, f"{id_col} {kind}, part int, offset long, kind string, media binary")
