"""Media columns: baseline JPEG with one payload byte in each 8x8 block, and DC-only luminance thumbnails.

The decoder reads baseline JPEG in general: it parses the markers, Huffman-decodes the scan and rebuilds only the DC term of
the luminance blocks, which is the image at an eighth of its size. Restart intervals are independent, so all intervals of
all images of a batch that share their tables are decoded in lockstep, one numpy step for each symbol.

The encoder stores bytes without loss in what this decoder keeps: each byte is the flat grey of one block (the DC quantiser
is 8, so that a DC step is one grey level), 64 blocks to a row, a row to a restart interval. Rows beyond what one image can
hold go to further images, one after the other.

Defined results: null and empty texts have a payload of 64 zero bytes; equal texts have equal media; media that is not
baseline JPEG, is damaged or is null gives null results and a reason, and does not stop the job; texts of any length make as many images as they need; repeated
rows each get their media; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeline.llm.bytes import pieces, utf8

ROW = 64
#: 65535 lines at most, 8 to a block.
MAX_ROWS = 8191
PIECE = 2 << 20

# Fixed values of the format: the usual Huffman table of luminance DC differences (codes of each length from 1, and symbols).
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
# AC terms never occur: the only symbol is end of block, and its code is one bit.
AC_COUNTS, AC_SYMBOLS = bytes([1, *[0] * 15]), bytes([0])


def canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(code, length, symbol) of a Huffman table as JPEG transmits it."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((code, length, symbols[k]))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """For each 16 next bits: length << 8 | symbol; 0 where no code fits."""
    table = np.zeros(1 << 16, np.int64)
    for code, length, symbol in canonical(counts, symbols):
        table[code << 16 - length : code + 1 << 16 - length] = length << 8 | symbol
    return table


# ------------------------------------------------------------------ encoder


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        _segment(0xDB, bytes([0, 8, *[1] * 63])),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
        _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", ROW)),
        _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """Bits and their number for each DC difference from -255 on, with the end-of-block bit."""
    codes = {symbol: (code, length) for code, length, symbol in canonical(DC_COUNTS, DC_SYMBOLS)}
    bits, sizes = [], []
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, length = codes[n]
        bits.append((code << n | (d if d >= 0 else d + (1 << n) - 1)) << 1)
        sizes.append(length + n + 1)
    return np.array(bits, np.int32), np.array(sizes, np.int32)


_BITS, _SIZES = _difference_codes()
_HEAD = len(_header(1))


def payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts padded with zero bytes to a positive multiple of 64, and the offsets of their rows."""
    n = np.diff(offsets)
    rows = np.maximum(1, -(-n // ROW))
    at = np.concatenate([[0], np.cumsum(rows)])
    out = np.zeros(at[-1] * ROW, np.uint8)
    out[np.arange(len(data)) + np.repeat(at[:-1] * ROW - offsets[:-1], n)] = data
    return out.reshape(-1, ROW), at


def encode(rows: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Media of each run of rows at[i]:at[i+1] of 64 bytes."""
    m = len(rows)
    step = np.diff(rows.astype(np.int16), axis=1, prepend=np.int16(128))
    sizes = _SIZES[step + 255]
    ends = np.cumsum(sizes, axis=1, dtype=np.int32)
    length = (ends[:, -1] + 7) >> 3
    base = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
    flat = np.zeros(base[-1] + 3, np.uint8)
    for k in range(ROW):
        begin = ends[:, k] - sizes[:, k]
        window = _BITS[step[:, k] + 255] << (24 - sizes[:, k] - (begin & 7))
        to = base[:-1] + (begin >> 3)
        flat[to] |= (window >> 16).astype(np.uint8)
        flat[to + 1] |= (window >> 8 & 255).astype(np.uint8)
        flat[to + 2] |= (window & 255).astype(np.uint8)
    # The third byte of a row's last window is always zero bits, so rows don't touch each other. A row's end is filled with ones.
    flat = flat[: base[-1]]
    flat[base[1:] - 1] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)
    full = flat == 255
    stuffed = np.concatenate([[0], np.cumsum(full)])
    image_rows = np.concatenate([np.arange(a, b, MAX_ROWS) for a, b in zip(at[:-1], at[1:], strict=True)]) if len(at) > 1 else np.zeros(0, np.int64)
    image_end = np.append(image_rows[1:], m)
    head = np.zeros(m, np.int64)
    head[image_rows] = _HEAD
    size = length + stuffed[base[1:]] - stuffed[base[:-1]] + 2
    start = np.concatenate([[0], np.cumsum(size + head)])
    out = np.zeros(start[-1], np.uint8)
    row_of = np.repeat(np.arange(m), length)
    place = np.arange(len(flat)) + stuffed[:-1] + (start[:-1] + head - base[:-1] - stuffed[base[:-1]])[row_of]
    out[place] = flat
    mark = start[1:] - 2
    out[mark] = 0xFF
    out[mark + 1] = 0xD0 + ((np.arange(m) - np.repeat(image_rows, image_end - image_rows)) & 7)
    out[mark[image_end - 1] + 1] = 0xD9
    heads: dict[int, np.ndarray] = {}
    for a, b in zip(image_rows.tolist(), image_end.tolist(), strict=True):
        n = b - a
        if n not in heads:
            heads[n] = np.frombuffer(_header(n), np.uint8)
        out[start[a] : start[a] + _HEAD] = heads[n]
    raw = out.tobytes()
    return [raw[a:b] for a, b in zip(start[at[:-1]].tolist(), start[at[1:]].tolist(), strict=True)]


# ------------------------------------------------------------------ decoder


@dataclass
class Frame:
    """What the markers of one image say."""

    width: int = 0
    height: int = 0
    parts: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal and vertical sampling, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # of DC
    tables: dict[int, bytes] = field(default_factory=dict)  # by class << 4 | id: counts, then symbols
    used: list[tuple[int, int]] = field(default_factory=list)  # DC and AC table of each part
    interval: int = 0
    scan: int = 0

    @property
    def mcu(self) -> tuple[int, int]:
        """Least common size of all parts' sampling: MCUs across and down."""
        if len(self.parts) == 1:
            return -(-self.width // 8), -(-self.height // 8)
        h, v = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        return -(-self.width // (8 * h)), -(-self.height // (8 * v))

    @property
    def blocks(self) -> list[int]:
        """For each block of an MCU, in order, its part."""
        return [0] if len(self.parts) == 1 else [k for k, p in enumerate(self.parts) for _ in range(p[1] * p[2])]


_heads: dict[bytes, Frame] = {}


def parse(media: bytes, at: int = 0) -> Frame:
    """Markers of the image that starts at ``at``, up to its scan."""
    if media[at : at + 2] != b"\xff\xd8":
        raise ValueError("no start of image")
    frame, at = Frame(), at + 2
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("markers end")
        marker = media[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", media, at + 2)[0]
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.quantisers[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1):
            depth, frame.height, frame.width, n = struct.unpack_from(">BHHB", body)
            if depth != 8 or not frame.width or not frame.height:
                raise ValueError("not 8 bits deep, or without a size")
            frame.parts = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not baseline")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                frame.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif marker == 0xDD:
            frame.interval = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            if body[0] != len(frame.parts):
                raise ValueError("scans of single components aren't supported")
            frame.used = [(body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            frame.scan = at
            return frame


def _scan_end(data: np.ndarray, marks: np.ndarray, begin: int) -> tuple[int, np.ndarray]:
    """End of the scan that begins there, and the positions of its restart markers. marks: 0xFF not followed by 0 or 0xFF."""
    k = int(np.searchsorted(marks, begin))
    kinds = data[marks[k:] + 1]
    other = np.flatnonzero((kinds < 0xD0) | (kinds > 0xD7))
    if not len(other):
        raise ValueError("the scan doesn't end")
    return int(marks[k + other[0]]), marks[k : k + other[0]]


def decode(medias: list[bytes | None]) -> list[list[tuple[Frame, np.ndarray]] | str]:
    """Of each media its images (markers, DC-only luminance thumbnail), or why it can't be read."""
    out: list = [[] for _ in medias]
    jobs: dict[tuple, list] = {}
    for i, media in enumerate(medias):
        if not media:
            out[i] = "no media"
            continue
        data = np.frombuffer(media, np.uint8)
        full = np.flatnonzero(data[:-1] == 255)
        marks = full[(data[full + 1] != 0) & (data[full + 1] != 255)]
        at = 0
        try:
            while at < len(media):
                frame = parse(media, at)
                end, restarts = _scan_end(data, marks, frame.scan)
                key = (tuple(frame.parts), tuple(sorted(frame.tables.items())), tuple(frame.used))
                jobs.setdefault(key, []).append((i, len(out[i]), frame, data[frame.scan : end], restarts - frame.scan))
                out[i].append(None)
                if data[end + 1] != 0xD9:
                    raise ValueError("more than one scan")
                at = end + 2
        except (ValueError, IndexError, KeyError, struct.error) as e:
            out[i] = str(e) or type(e).__name__
    for work in jobs.values():
        work = [w for w in work if not isinstance(out[w[0]], str)]
        for (i, k, frame, _, _), thumb in zip(work, _luminance(work), strict=True):
            if isinstance(out[i], list):
                if thumb is None:
                    out[i] = "damaged scan"
                else:
                    out[i][k] = (frame, thumb)
    return out


def _luminance(work: list) -> list[np.ndarray | None]:
    """Thumbnails of images that share components and tables."""
    if not work:
        return []
    first: Frame = work[0][2]
    blocks = first.blocks
    try:
        dc = [lookup(t[:16], t[16:]) for t in (first.tables[u[0]] for u in first.used)]
        ac = [lookup(t[:16], t[16:]) for t in (first.tables[0x10 | u[1]] for u in first.used)]
    except KeyError:
        return [None] * len(work)
    begins, counts, owner, chunks, base = [], [], [], [], 0
    for j, (_, _, frame, scan, restarts) in enumerate(work):
        across, down = frame.mcu
        total = across * down
        interval = frame.interval or total
        n = -(-total // interval)
        gone = np.zeros(len(scan), bool)
        if len(scan) > 1:
            gone[1:] = (scan[1:] == 0) & (scan[:-1] == 255)
        gone[restarts] = gone[restarts + 1] = True
        kept = np.cumsum(~gone)
        starts = np.concatenate([[0], kept[restarts + 1]])
        starts = np.concatenate([starts, np.full(max(0, n - len(starts)), kept[-1] if len(kept) else 0)])[:n]
        begins.append(starts + base)
        counts.append(np.minimum(interval, total - np.arange(n) * interval))
        owner.append(np.full(n, j))
        chunks.append(scan[~gone])
        base += len(chunks[-1])
    flat = np.concatenate([*chunks, np.zeros(8, np.uint8)])
    words = flat[:-3].astype(np.uint32) << 24 | flat[1:-2].astype(np.uint32) << 16 | flat[2:-1].astype(np.uint32) << 8 | flat[3:]
    words = words.astype(np.int64)
    last = len(words) - 1
    begins, counts, owner = map(np.concatenate, (begins, counts, owner))
    position = begins * 8
    steps = int(counts.max())
    mine = [k for k, part in enumerate(blocks) if part == 0]
    values = np.zeros((len(mine), steps, len(counts)), np.int32)
    level = np.zeros((len(first.parts), len(counts)), np.int64)
    damaged = np.zeros(len(counts), bool)

    def ahead(at: np.ndarray) -> np.ndarray:
        """The next 25 bits or more, from bit 31 down."""
        return words[np.minimum(at >> 3, last)] << (at & 7) & 0xFFFFFFFF

    even = bool((counts == steps).all())
    for s in range(steps):
        live = slice(None) if even else np.flatnonzero(counts > s)
        where = position[live]
        for b, part in enumerate(blocks):
            bits = ahead(where)
            entry = dc[part][bits >> 16]
            where = where + (entry >> 8)
            n = entry & 255
            bits = ahead(where)
            raw = bits >> (32 - n)
            where += n
            step = np.where(raw < (1 << n) >> 1, raw - (1 << n) + 1, raw)
            level[part, live] += step
            damaged[live] |= (entry == 0) | (n > 11)
            if part == 0:
                values[mine.index(b), s, live] = level[0, live]
            left, k = np.arange(len(where)), np.ones(len(where), np.int64)
            while len(left):
                entry = ac[part][ahead(where[left]) >> 16]
                symbol = entry & 255
                where[left] += (entry >> 8) + (symbol & 15)
                k[left] += (symbol >> 4) + 1
                if (entry == 0).any():
                    damaged[np.arange(len(counts))[live][left[entry == 0]]] = True
                left = left[(symbol != 0) & (entry != 0) & (k[left] < 64)] if symbol.any() else left[:0]
        position[live] = where
    out: list = []
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(work)))])
    for j, (_, _, frame, _, _) in enumerate(work):
        low, high = at[j], at[j + 1]
        if damaged[low:high].any():
            out.append(None)
            continue
        across, down = frame.mcu
        h, v = (frame.parts[0][1], frame.parts[0][2]) if len(frame.parts) > 1 else (1, 1)
        grid = values[:, :, low:high]
        grid = grid.transpose(2, 1, 0).reshape(-1, len(mine))[: across * down] if (counts[low:high] == steps).all() else np.concatenate([grid[:, : counts[low + k], k].T for k in range(high - low)])
        grid = grid.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        most = max(p[1] for p in frame.parts), max(p[2] for p in frame.parts)
        wide = -(-frame.width * (h if len(frame.parts) > 1 else 1) // (8 * (most[0] if len(frame.parts) > 1 else 1)))
        high_ = -(-frame.height * (v if len(frame.parts) > 1 else 1) // (8 * (most[1] if len(frame.parts) > 1 else 1)))
        q = frame.quantisers.get(frame.parts[0][3], 1)
        out.append(np.clip(np.rint(grid[:high_, :wide] * (q / 8) + 128), 0, 255).astype(np.uint8))
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which cells of an 8x8 grid of means are above their mean."""
    r, c = (np.arange(8) * n // 8 for n in thumb.shape)
    sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), r, axis=0), c, axis=1)
    n = np.outer(*(np.maximum(1, np.diff(np.append(x, size))) for x, size in zip((r, c), thumb.shape, strict=True)))
    means = sums / n
    return np.packbits(means > means.mean()).tobytes().hex()


def below(thumbs: list[np.ndarray]) -> np.ndarray:
    """One thumbnail of all, each below the one before; narrower ones are filled up with black."""
    wide = max(t.shape[1] for t in thumbs)
    return thumbs[0] if len(thumbs) == 1 else np.concatenate([np.pad(t, ((0, 0), (0, wide - t.shape[1]))) for t in thumbs])


# ------------------------------------------------------------------ columns


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as UTF-8, padded and stored as JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text_col, PIECE):
            data, offsets = utf8(part.column(text_col))
            media = encode(*payloads(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, reason of stored media.

    ``feature``: pixels across and down of all images, one below the other, number of images, and the hash of their thumbnails
    in the same order.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "reason"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "media", PIECE):
            medias = part.column("media").to_pylist()
            rows = []
            for media, images in zip(medias, decode(medias), strict=True):
                whole = (len(media), hashlib.sha256(media).hexdigest()) if media is not None else (None, None)
                if isinstance(images, str):
                    rows.append((None, None, None, *whole, None, images))
                    continue
                payload = b"".join(thumb.tobytes() for _, thumb in images)
                across, down = max(frame.width for frame, _ in images), sum(frame.height for frame, _ in images)
                feature = f"{across}x{down}*{len(images)}:{average_hash(below([thumb for _, thumb in images]))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *whole, feature, None))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds[2:], strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, reason string")
